"""Cosine, the calibration table, fitting, benchmark scoring and the embedding store."""

import math
import random

import pytest
from pyspark.sql import functions as F
from rows import on

from bhashya.functions import similarity as S
from bhashya.operators import calibration as C
from bhashya.operators import embedding as V
from bhashya.operators import evaluate as E
from bhashya.sources import datasets as D


def test_table():
    assert len(C.TABLE) == 15 and {lang for _, lang in C.TABLE} == set(C.LANGUAGES)
    assert sum(c.roc_auc >= 0.7 for c in C.TABLE.values()) == 6 and sum(c.roc_auc > 0.5 for c in C.TABLE.values()) == 9
    assert sum(bool(c.warnings) for c in C.TABLE.values()) == 4 and all(c.accuracy_at_threshold >= c.accuracy_at_default and c.n_cases in (9, 10) for c in C.TABLE.values())
    c = C.get_threshold("intfloat/multilingual-e5-base", "en")
    assert (c.threshold, c.accuracy_at_threshold, c.roc_auc) == (0.8811413049697876, 0.9, 0.86)
    with pytest.raises(KeyError, match="known"):
        C.get_threshold("x", "en")


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 2.0], [-2.0, -4.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = on(spark, rows, "a array<float>, b array<float>", S.cosine_similarity("a", "b"))
    assert [round(x, 9) for x in got] == [1.0, 0.0, -1.0, 0.0]


def similar(spark, rows, **kw):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, r string, x array<double>, y array<double>, l string")
    return [r["similarity"] for r in sorted(S.calibrated_similarity(d, "g", "r", "x", "y", "l", **kw).collect(), key=lambda r: r["i"])]


def unit(cosine):
    return [1.0, 0.0], [cosine, math.sqrt(1 - cosine * cosine)]


def test_thresholds_and_labels(spark):
    rows = [("g", "r", *unit(0.9), "en"), ("g", "r", *unit(0.8), "en"), ("g", "r", *unit(0.42), "hinglish"), (" ", "r", *unit(1.0), "xx"), ("g", None, None, None, "en"), ("g", "r", *unit(-0.5), "hi")]
    got = similar(spark, rows)
    assert [g["label"] for g in got] == ["similar", "dissimilar", "similar", "empty", "empty", "dissimilar"]
    assert got[5]["score"] == 0.0 and got[5]["detail"]["raw_cosine_similarity"] == 0.0 and round(got[5]["detail"]["unclamped_cosine_similarity"], 6) == -0.5
    assert got[0]["detail"]["calibrated"] and got[3]["detail"]["encoder"] is None and got[3]["score"] == 0.0


def test_weak_and_unknown_encoders(spark):
    rows = [("g", "r", *unit(0.9), "en"), ("g", "r", *unit(0.3), "hi")]
    weak = similar(spark, rows, encoder="sentence-transformers/LaBSE")
    assert [(g["label"], g["passed"], round(g["score"], 6)) for g in weak] == [("low_discrimination", False, 0.9), ("low_discrimination", False, 0.3)]
    assert weak[0]["detail"]["roc_auc"] == 0.06999999999999998
    assert [g["label"] for g in similar(spark, rows, encoder="sentence-transformers/LaBSE", min_auc=0.0)] == ["similar", "dissimilar"]
    assert [g["label"] for g in similar(spark, rows, encoder="new")] == ["similar_uncalibrated", "dissimilar_uncalibrated"]
    with pytest.raises(ValueError, match="allow_muril"):
        similar(spark, rows, encoder=C.MURIL)


def test_bad_input_raises(spark):
    with pytest.raises(Exception, match="unsupported language"):
        similar(spark, [("g", "r", *unit(0.9), "fr")])
    with pytest.raises(Exception, match="NaN"):
        similar(spark, [("g", "r", [math.nan], [1.0], "en")])
    with pytest.raises(Exception, match="no vector"):
        similar(spark, [("g", "r", None, [1.0], "en")])


def plain_fit(right, wrong):
    best = max(sorted({*right, *wrong}), key=lambda t: (sum(x >= t for x in right) + sum(x < t for x in wrong), -t))
    acc = lambda t: (sum(x >= t for x in right) + sum(x < t for x in wrong)) / (len(right) + len(wrong))
    auc = sum((r > w) + (r == w) / 2 for r in right for w in wrong) / (len(right) * len(wrong))
    return best, acc(best), acc(0.5), min(len(right), len(wrong)), auc


@pytest.mark.parametrize("n", [1, 4, 60, 900])
def test_fit_equals_a_plain_sweep(spark, n):
    rng = random.Random(n)
    right, wrong = ([round(rng.gauss(m, 0.3), 2) for _ in range(n)] for m in (0.6, 0.4))
    rows = [(x, True) for x in right] + [(x, False) for x in wrong]
    d = spark.createDataFrame(rows, "score double, is_correct boolean")
    r = C.calibrate(d).first()
    want = plain_fit(right, wrong)
    assert (r["threshold"], r["accuracy_at_threshold"], r["accuracy_at_default"], r["n_cases"]) == want[:4] and abs(r["roc_auc"] - want[4]) < 1e-12
    grouped = C.calibrate(d.withColumn("k", F.lit("a")).union(d.withColumn("k", F.lit("b"))), by=["k"]).collect()
    assert len(grouped) == 2 and all(g["threshold"] == want[0] for g in grouped)


def test_fit_warnings_and_errors(spark):
    frame = lambda right, wrong: spark.createDataFrame([(float(x), True) for x in right] + [(float(x), False) for x in wrong], "score double, is_correct boolean")
    assert C.calibrate(frame([0.9], [0.1])).first()["warnings"] == ["fewer than 5 cases on a side"]
    w = C.calibrate(frame([0.1] * 5 + [1.5], [0.1] * 6 + [0.2] * 6)).first()["warnings"]
    assert w == ["a score lies outside [-1, 1]"]
    assert C.calibrate(frame([0.0] * 5, [1.0] * 5)).first()["warnings"] == [C.AT_CHANCE]
    for right, wrong in (([], [0.1]), ([0.1], []), ([math.nan], [0.1])):
        with pytest.raises(Exception, match="both sides|NaN"):
            C.calibrate(frame(right, wrong)).collect()


def test_benchmark_buckets_and_agreement(spark):
    rows = [("a", "en", "correct", 0.9), ("b", "en", "wrong_subtle", 0.7), ("c", "hi", "wrong_hard", 0.1)]
    d = spark.createDataFrame(rows, "case_id string, language string, label string, s double")
    assert [r["is_correct"] for r in E.scored_for_calibration(d, "s").orderBy("case_id").collect()] == [True, False, False]
    assert E.scored_for_calibration(d, F.col("s") * 2, language="en").count() == 2
    t = spark.createDataFrame([(3, "x", "correct", "correct", "correct", True), (1, "y", "wrong", "correct", "wrong", False), (2, "z", "wrong", "correct", "correct", False)], "o int, i string, v string, g1 string, g2 string, holdout boolean")
    r = E.judge_agreement(t, "v", "g1", "g2").first()
    assert (r["n"], round(r["agreement_grader1"], 6), round(r["agreement_grader2"], 6)) == (3, 0.333333, 0.666667)
    odd = lambda *a: [r["id"] for r in E.judge_disagreements(t, "v", "g1", "g2", "i", "o", *a).orderBy("ord").collect()]
    assert odd() == ["y", "z"] and odd(F.col("holdout")) == []
    assert tuple(E.judge_agreement(t, "v", "g1", "g2", F.col("holdout")).first()) == (1, 1.0, 1.0) and tuple(E.judge_agreement(t.limit(0), "v", "g1", "g2").first()) == (0, 0.0, 0.0)


def test_embedding_store(spark, tmp_path):
    store, asked = f"{tmp_path}/store", str(tmp_path / "asked")

    def encode(texts):
        with open(asked, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    first = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    out = D.embed(first, store, encode).collect()
    assert sorted((r["text"], list(r["embedding"])) for r in out if r["text"]) == [("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("bb", [2.0, 1.0])]
    D.embed(spark.createDataFrame([("bb",), ("ccc",)], "text string"), store, encode).collect()
    assert sorted(open(asked).read().split()) == ["a", "bb", "ccc"]
    kept = spark.read.parquet(store)
    assert tuple(D.cache_stats(first, kept).first()) == (3, 0, 1.0) and tuple(D.cache_stats(first, kept, is_query=True).first()) == (0, 3, 0.0)
    assert tuple(D.cache_stats(first.limit(0), kept).first()) == (0, 0, 0.0)


def test_roles_pooling_and_keys(spark, monkeypatch, tmp_path):
    e5 = "intfloat/multilingual-e5-base"
    assert on(spark, ["x"], "t string", S.prepared("t", e5, True), S.prepared("t", e5, False), S.prepared("t", "other", True)) == [("query: x", "passage: x", "x")]
    a, b = on(spark, ["x"], "t string", S.cache_key("t", True), S.cache_key("t", False))[0]
    assert a != b and len(a) == 64
    pooled = on(spark, [([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0]], [0])], "v array<array<float>>, m array<int>", S.mean_pool("v", "m"))
    assert pooled == [pytest.approx([0.6, 0.8]), [0.0]]
    assert V.mean_pool([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]], [[1, 1, 0]])[0] == pytest.approx([0.6, 0.8]) and V.mean_pool([[[1.0]]], [[0]]).tolist() == [[0.0]]
    monkeypatch.setenv("BHASHYA_CACHE_DIR", str(tmp_path))
    assert D.store_root(spark) == f"file://{tmp_path}"
    spark.conf.set("spark.bhashya.embedding.store", "/shared/vectors/")
    assert D.store_root(spark) == "/shared/vectors"
    spark.conf.unset("spark.bhashya.embedding.store")


def test_a_model_is_loaded_once_and_missing_libraries_are_named():
    loads = []
    load = lambda name, revision: loads.append(name) or (lambda texts: [[1.0]] * len(texts))
    for _ in range(3):
        assert V.model_of("m", "r1", load)(["a"]) == [[1.0]]
    V.model_of("m", "r2", load)
    assert loads == ["m", "m"] and V.Encoder("m", "r1").ident == "m@r1" and V.Encoder("m", "r1")(["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(ImportError):
        V.Encoder("sentence-transformers/none")(["a"])
    with pytest.raises(ValueError, match="allow_muril"):
        V.with_vectors(None, C.MURIL)


def test_vectors_of_cases_by_encoder_and_role(spark, tmp_path):
    cases = spark.createDataFrame([(1, "g", "rr"), (2, "", "g"), (3, "rr", "g")], "id int, gold string, response string")
    of = lambda k: {r["id"]: (r["gold_vector"], r["response_vector"]) for r in V.with_vectors(cases, V.Encoder("e", str(k)), store=f"{tmp_path}/s", encode=lambda ts: [[float(len(t) * k)] for t in ts]).collect()}
    assert of(1) == {1: ([1.0], [2.0]), 2: (None, None), 3: ([2.0], [1.0])} and of(3) == {1: ([3.0], [6.0]), 2: (None, None), 3: ([6.0], [3.0])}
    assert of(1)[1] == ([1.0], [2.0])  # revisions don't mix
