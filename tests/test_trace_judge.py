"""Trace check, judge parsing, gate, prompts, providers, and the split by need."""

import hashlib
import random

import pytest
from rows import on

from bhashya.functions import judge as J
from bhashya.functions import trace as R
from bhashya.operators import judging
from bhashya.sources import datasets as D

SEA = "समुद्र तल पर पानी किस तापमान पर उबलता है?"


def labels(spark, rows, terms=None):
    got = on(spark, rows, "s string, t string", R.check_trace("s", "t", terms))
    return [(g["label"], [f["term"] for f in g["detail"]["flagged_terms"] or []]) for g in got]


def test_dictionary(spark):
    terms = R.default_terms()
    assert len(terms) == 69 and all(t.reading_a and t.reading_b for t in terms) and len({t.term for t in terms}) == 69
    assert D.load_terms(spark).count() == 69 and D.collect_terms(D.load_terms(spark)) == list(terms)
    with pytest.raises(ValueError, match="join"):
        D.collect_terms(D.load_terms(spark), most=5)


def test_readings(spark):
    t = [R.AmbiguousTerm("कल", "tomorrow (future)", "yesterday"), R.AmbiguousTerm("समुद्र तल", "sea level", "sea floor")]
    rows = [
        ("कल आओ", "they mean YESTERDAY"), ("कल आओ", "yesterday or tomorrow"), ("कलम कहाँ", "yesterday"), ("सकल लाभ", "yesterday"), ("कल। आओ", "yesterday"), ("कल आओ", "yesterdays"), (SEA, "the sea floor"), (SEA, "sea floor, no: sea level"),
        ("कल " + SEA, "yesterday at the sea floor"), (None, "x"), ("कल", " "), ("no term", "yesterday"),
    ]
    bad, good = "misread_detected", "no_misread_detected"
    assert labels(spark, rows, t) == [
        (bad, ["कल"]), (good, []), (good, []), (good, []), (bad, ["कल"]), (good, []), (bad, ["समुद्र तल"]), (good, []), (bad, ["कल", "समुद्र तल"]), ("empty", []), ("empty", []), (good, []),
    ]
    assert labels(spark, [(SEA, "boils at the sea floor")])[0][0] == bad


def test_a_dictionary_must_hold_terms(spark):
    with pytest.raises(TypeError):
        R.check_trace("s", "t", ["कल"])
    assert labels(spark, [("कल", "yesterday")], []) == [("no_misread_detected", [])]
    odd = R.AmbiguousTerm("क(ल", "a+b", "c*d (note)")
    assert labels(spark, [("क(ल", "c*d"), ("क(ल", "cd")], [odd])[1][0] == "no_misread_detected"


def test_dictionary_as_a_table(spark):
    """The same flags as the unrolled form, over random dictionaries, in the dictionary's order."""
    rng = random.Random(5)
    words, glosses = ["कल", "कलम", "ATM कल", "तल", "समुद्र तल", "ATM", "a.b", "x\\Ey", "वर्ग", "(क)", "$1", "कल-तल"], ["tomorrow", "yesterday", "sea level", "sea floor (bottom)", "pen", "C++", "a|b", "Square", "é"]
    for _ in range(4):
        terms = [R.AmbiguousTerm(rng.choice(words), rng.choice(glosses), rng.choice(glosses)) for _ in range(9)]
        rows = [(i, " ".join(rng.choice([*words, "और", "।"]) for _ in range(rng.randrange(6))), ", ".join(rng.choice(glosses).upper() for _ in range(rng.randrange(4)))) for i in range(60)] + [(60, None, "pen"), (61, "कल", None), (62, "कल", " ")]
        df = spark.createDataFrame(rows, "k int, s string, t string")
        table = spark.createDataFrame([(i, t.term, t.reading_a, t.reading_b) for i, t in enumerate(terms)], "ord int, term string, reading_a string, reading_b string")
        plain = df.select("k", R.check_trace("s", "t", terms)["detail"]["flagged_terms"].alias("flagged_terms"))
        flags = lambda d: {r["k"]: [tuple(f) for f in r["flagged_terms"] or ()] for r in d.collect()}
        assert flags(R.check_trace_with(df, "s", "t", table, "k")) == flags(plain)
    assert len(flags(R.check_trace_with(df, "s", "t", table.limit(0), "k"))) == 63


RAW = {
    '{"score": 5, "confidence": "high", "reasoning": "r"}': (1.0, "high"), '{"score": 4}': (0.75, "low"), '```json\n{"score": 3, "confidence": "HIGH"}\n```': (0.5, "high"), 'I think {not json} then {"score": 2}': (0.25, "low"),
    '{"score": 5, "confidence": "medium"}': (1.0, "low"), '{"score": 5.4}': (1.0, "low"), '{"score": 4.5}': (0.75, "low"), '{"score": 3.5}': (0.75, "low"), '{"score": 0.6}': (0.0, "low"), '{"a": {"score": 5}}': None,
    '{"score": 0.5}': None, '{"score": "5"}': None, '{"score": true}': None, '{"score": false}': None, '{"score": 0}': None, '{"score": -1}': None, '{"score": 6}': None, '{"score": Infinity}': None, '{"score": -Infinity}': None, '{"score": NaN}': None,
    '{"score": 1' + "0" * 400 + "}": None, "": None, "no json": None, "[5]": None, '{"confidence": "high"}': None, '{"score": null}': None, '{"text": "a } b", "score": 1}': (0.0, "low"),
}


def test_parse(spark):
    got = on(spark, [*RAW, None], "r string", J.parse_judge("r"))
    assert [(g["score"], g["confidence"]) if g["score"] is not None else None for g in got] == [*RAW.values(), None]
    assert got[4]["raw_confidence"] == "medium"


def test_the_first_object_wherever_it_stands():
    assert J.first_object('x {"a": {"b": "}"}} {') == {"a": {"b": "}"}} and J.first_object('{"a" {"b": 1}') == {"b": 1}
    assert J.first_object("```json\n{}\n``` {\"a\": 1}") == {} and J.first_object("``` x ``` {\"a\": 1}") is None and J.first_object("{" * 5000) is None and J.first_object(None) is None
    assert J.first_object('{"a":' * 3000) is None


def test_gate_and_families(spark):
    rows = [(1.0, "high"), (0.75, "high"), (1.0, "low"), (0.8, "high")]
    assert on(spark, rows, "s double, c string", J.judge_passes("s", "c")) == [True, False, False, True]
    ids = [("openai/gpt-oss-120b", "openai/gpt-oss-20b", True), ("gpt-4o", "gpt-4o-mini", False), ("llama-3-8b", "llama-3-70b", True), ("m-7b", None, False), ("m-7b", " ", False), ("gpt-4", "gpt", True)]
    got = on(spark, [r[:2] for r in ids], "a string, b string", J.same_family_warning("a", "b"))
    assert [g is not None for g in got] == [r[2] for r in ids]


def test_prompts_hold_the_texts_as_they_are(spark):
    p = on(spark, [("q § {x}", "a §q", "g")], "q string, a string, g string", J.build_prompt("reference_based", "q", "a", "g"), J.build_prompt("reference_free", "q", "a"), J.build_prompt("reference_free_en", "q", "a") if "reference_free_en" in J.TEMPLATES else J.build_prompt("trace", None, "a", "g"))[0]
    assert all("<<<a §q>>>" in x for x in p) and "<<<g>>>" in p[0] and "<<<q § {x}>>>" in p[1]


def test_providers():
    j = judging.make_judge(" Groq :my-model")
    assert (j.provider, j.model_id) == ("groq", "my-model") and judging.make_judge("openai").model_id == "gpt-4o"
    for spec in ("litellm", "nobody:x"):
        with pytest.raises(ValueError):
            judging.make_judge(spec)
    assert judging.make_judge("litellm:a/b:c").model_id == "a/b:c"


def test_a_missing_key_is_named(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        judging.make_judge("openai").call("x")


def test_judge_asks_only_where_it_must(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Counting:
        model_id = "c-1b"

        def call(self, prompt):
            with open(log, "a") as f:
                f.write("x")
            return "broken" if "BAD" in prompt else '{"score": 5, "confidence": "high"}' if "good" in prompt else '{"score": 2, "confidence": "Sure"}'

    rows = [(1, "q", "good answer", None), (2, "q", "good answer", None), (3, "q", "a  b", "a b"), (4, "", "x", None), (5, "q", "BAD", None), (6, "q", "wrong", "the reference"), (7, "q", None, "g")]
    df = spark.createDataFrame(rows, "id int, q string, a string, g string")
    got = {r["id"]: r["judge"] for r in judging.judge_answers(df, "q", "a", "g", Counting(), answering_model_id=F_lit("c-9b")).collect()}
    assert {k: v["label"] for k, v in got.items()} == {1: "matched", 2: "matched", 3: "matched", 4: "empty", 5: "judge_error", 6: "flagged", 7: "empty"}
    assert got[3]["detail"]["aligned"] and got[3]["detail"]["reasoning"] and got[3]["detail"]["judge_reasoning"] is None and got[1]["detail"]["reasoning"] is None and got[6]["score"] == 0.25 and got[6]["detail"]["mode"] == "reference_based" and got[6]["detail"]["raw_confidence"] == "Sure"
    assert got[5]["detail"]["raw_response"] == "broken" and got[1]["detail"]["self_enhancement_bias_warning"] and got[4]["detail"]["mode"] is None
    assert len(open(log).read()) == 3  # rows 1 and 2 share a prompt


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_replay(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id int, q string, a string")
    prompt = on(spark, [("q", "a")], "q string, a string", J.build_prompt("reference_free", "q", "a"))[0]
    answers = spark.createDataFrame([(hashlib.sha256(prompt.encode()).hexdigest(), '{"score": 5, "confidence": "high"}')], "prompt_sha256 string, raw string")
    r = judging.judge_answers(df, "q", "a", None, judging.ReplayJudge(answers)).first()["judge"]
    assert (r["label"], r["score"], r["detail"]["mode"]) == ("matched", 1.0, "reference_free")


def test_trace_fallback(spark):
    class Says:
        model_id = "s"

        def call(self, prompt):
            return '{"misread": false, "confidence": "High"}' if "fine" in prompt else '{"misread": "false", "confidence": "high"}' if "string" in prompt else "?"

    t = [R.AmbiguousTerm("कल", "tomorrow", "yesterday")]
    df = spark.createDataFrame([(1, "कल", "yesterday"), (2, "", "x"), (3, "same words", "same  words"), (4, "src", "fine"), (5, "src", "string"), (6, "src", "odd")], "id int, s string, t string")
    got = {r["id"]: r["trace_check"] for r in judging.check_trace_with_judge(df, "s", "t", Says(), terms=t).collect()}
    bad, good = "misread_detected", "no_misread_detected"
    assert {k: v["label"] for k, v in got.items()} == {1: bad, 2: "empty", 3: good, 4: good, 5: bad, 6: bad}
    assert got[3]["detail"]["aligned"] and got[4]["detail"]["llm_fallback_used"] and got[6]["detail"]["confidence"] == "low" and got[1]["detail"]["llm_fallback_used"] is None
