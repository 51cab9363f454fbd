"""Datasets in, evaluation, reports and the command line out."""

import io
import json
import re

import pytest
from pyspark.sql import functions as F

from bhashya import queries as engine
from bhashya.functions import sql
from bhashya.functions import text as X
from bhashya.functions.adherence import prompt_bucket, script_adherence
from bhashya.operators import evaluate as E
from bhashya.operators.progress import Progress
from bhashya.plans import cli
from bhashya.plans import report as R
from bhashya.sources import datasets as D
from bhashya.streaming import checks

#: Five of six replies keep to the script; the one trace misreads a term.
CASES = [
    {"id": "a", "prompt": "Delhi mein mausam kaisa hai?", "response": "Aaj dhoop hai."}, {"id": "b", "question": "दिल्ली कहाँ है?", "answer": "दिल्ली भारत में है।"}, {"id": "c", "input": "Where is Delhi?", "output": "In India."},
    {"id": "d", "query": "दिल्ली कहाँ है?", "completion": "It is in India."}, {"id": "e", "prompt": "வானிலை?", "response": "நன்று"},
    {"id": "f", "prompt": "समुद्र तल क्या है?", "response": "पानी की ऊँचाई", "reasoning": "This asks about the sea floor."},
]


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def loaded(spark, path):
    return [tuple(r)[1:] for r in D.load_cases(spark, str(path)).orderBy("ord").collect()]


def test_json_lines(spark, tmp_path):
    got = loaded(spark, lines(tmp_path / "c.jsonl", CASES))
    assert [g[0] for g in got] == list("abcdef") and got[1][1:3] == ("दिल्ली कहाँ है?", "दिल्ली भारत में है।") and got[5][4] == "This asks about the sea floor."
    odd = tmp_path / "odd.txt"
    odd.write_text('﻿{"ID": 7, " Prompt ": " x ", "prompt": "later", "input": "y"}\n\n  \n{"prompt": 5, "question": " ", "query": "q", "answer": null}\x85{"case_id": "k"}', encoding="utf-8")
    assert loaded(spark, odd) == [("1", "later", "", "", "", ""), ("2", "q", "", "", "", ""), ("k", "", "", "", "", "")]


def test_json(spark, tmp_path):
    p = tmp_path / "c.JSON"
    p.write_text(json.dumps({"cases": [], "data": CASES[:2], "tests": [{}]}), encoding="utf-8")
    assert [g[0] for g in loaded(spark, p)] == ["a", "b"]
    p.write_text(json.dumps([{"output": "r"}]), encoding="utf-8")
    assert loaded(spark, p) == [("1", "", "r", "", "", "")]


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('﻿Name,Question,answer,expected,lang\nk,"two\nlines, ""quoted""",a,,hi\n,q, ,g,\n', encoding="utf-8")
    assert loaded(spark, p) == [("k", 'two\nlines, "quoted"', "a", "", "", "hi"), ("2", "q", "", "g", "", "")]


@pytest.mark.parametrize(("name", "text", "said"), [("x.jsonl", '{"a": 1}\n\n{bad', r"x\.jsonl:3: invalid JSON"), ("x.jsonl", '{"a": 1}\n[1]', "row 2 is not an object"), ("x.json", '{"cases": 5}', "expected a JSON list"), ("x.json", "[1]", "row 1 is not an object")])
def test_malformed_files_name_the_place(spark, tmp_path, name, text, said):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match=said):
        D.load_cases(spark, str(p)).collect()


def test_numbers_by_columns(spark):
    """A first column that holds one value doesn't matter, nor does the layout."""
    d = spark.range(0, 3000, 1, 5).select(F.lit(1).alias("a"), ((F.col("id") * 7919) % 3000).alias("b"), F.lit("p").alias("prompt")).repartition(3)
    got = D.cases_from_columns(d, ["a", "b"]).collect()
    assert sorted(r["ord"] for r in got) == list(range(1, 3001))
    assert all(r["_ord"] == r["b"] + 1 for r in D._numbered_by(d, ["a", "b"]).collect()) and D._numbered_by(d.limit(0), ["a", "b"]).count() == 0
    with pytest.raises(ValueError, match="name the columns"):
        D.cases_from_columns(d)


def test_large_json_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join("\n" * (i % 3) + json.dumps({"prompt": str(i)}) + "\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [(r["ord"], r["id"], r["prompt"]) for r in D.load_cases(spark, f"{tmp_path}/c.jsonl").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [(i + 1, str(i + 1), str(i)) for i in range(5000)]


def test_benchmarks(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('case_id,task_id,language,label,gold_text,answer\n1,t,hi,correct,"g, h",a\n', encoding="utf-8")
    assert tuple(D.load_similarity_benchmark(spark, str(p)).first()) == ("1", "t", "hi", "correct", "g, h", "a")
    q = tmp_path / "j.json"
    q.write_text('[{"trace_id": "t1", "is_holdout": true}, {"trace_id": "t2", "is_holdout": false}]', encoding="utf-8")
    assert D.load_judge_benchmark(spark, str(q)).filter("is_holdout").count() == 1
    t = tmp_path / "terms.csv"
    t.write_text("target_word,suggested_reading_a,suggested_reading_b,source\nकल,tomorrow,yesterday,me\nघर, ,house,me\n", encoding="utf-8")
    assert [r["term"] for r in D.load_terms(spark, str(t)).collect()] == ["कल"]


def test_ids_of_a_distributed_table_are_whole(spark):
    d = spark.range(0, 1000, 1, 7).select(F.lit("p").alias("prompt"))
    assert sorted(int(r["id"]) for r in D.cases_from_columns(d).collect()) == list(range(1, 1001))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    cases = D.load_cases(spark, lines(tmp_path_factory.mktemp("run") / "c.jsonl", CASES))
    metrics = E.with_auto_trace(cases, ["script"])
    long = E.long_results(E.evaluate(cases, metrics), metrics).cache()
    return metrics, long, E.summarize(long)


def test_six_cases(run):
    metrics, long, summary = run
    assert metrics == ["script", "trace"] and long.count() == 12
    got = {r["metric"]: (r["passed"], r["total"], r["skipped"], r["mean_score"]) for r in summary.collect()}
    assert got == {"script": (5, 6, 0, 5 / 6), "trace": (0, 1, 5, 0.0)}
    assert [(r["metric"], r["id"]) for r in E.failures(long).collect()] == [("script", "d"), ("trace", "f")]
    assert {r["metric"] for r in E.gate(summary).collect()} == {"script", "trace"} and [r["metric"] for r in E.gate(summary, 0.8).collect()] == ["trace"]
    assert {(r["metric"], r["label"], r["count"]) for r in E.label_distribution(long).collect()} >= {("script", "matched", 5), ("trace", "misread_detected", 1)}


def test_summary_without_cases(spark):
    cases = D.cases_from_columns(spark.createDataFrame([("p", "r")], "prompt string, response string"))
    r = E.summarize(E.long_results(E.evaluate(cases, ["trace"]), ["trace"])).first()
    assert (r["total"], r["passed"], r["skipped"], r["pass_rate"], r["mean_score"]) == (0, 0, 1, 1.0, 0.0) and E.gate(E.summarize(E.long_results(E.evaluate(cases, ["trace"]), ["trace"]))).isEmpty()


def test_metric_names():
    assert E.parse_metrics(" trace, script,,trace") == ["trace", "script"]
    with pytest.raises(ValueError, match="a, b"):
        E.parse_metrics("b,script,a")


def test_similarity_and_judge_in_a_run(spark):
    class Yes:
        model_id = "yes"

        def call(self, prompt):
            return '{"score": 5, "confidence": "high"}'

    rows = [(1, "1", "p", "r", "g", "", "en", [1.0], [1.0]), (2, "2", "p", "r", "", "", "en", None, None), (3, "3", "p", "r", "g", "", "", [1.0], [1.0]), (4, "4", "p", "r", "", "", "xx", None, None)]
    cases = spark.createDataFrame(rows, "ord long, id string, prompt string, response string, gold string, trace string, language string, gold_vector array<double>, response_vector array<double>")
    s = E.summarize(E.long_results(E.evaluate(cases, ["similarity", "judge"], judge=Yes()), ["similarity", "judge"]))
    assert {r["metric"]: (r["passed"], r["total"], r["skipped"]) for r in s.collect()} == {"similarity": (1, 1, 3), "judge": (4, 4, 0)}
    s = E.summarize(E.long_results(E.evaluate(cases, ["similarity"], language="hi"), ["similarity"]))  # a default for cases without a language
    assert {r["metric"]: (r["passed"], r["total"], r["skipped"]) for r in s.collect()} == {"similarity": (2, 2, 2)}
    with pytest.raises(Exception, match="unsupported language"):
        E.long_results(E.evaluate(cases, ["similarity"], language="fr"), ["similarity"]).collect()
    with pytest.raises(ValueError, match="judge"):
        E.evaluate(cases, ["judge"])


def test_conversation_pairs(spark):
    t = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "assistant", "d"), (1, 4, "user", "x"), (2, 0, "system", "s"), (2, 1, "assistant", "y")]
    got = E.conversation_pairs(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r["prompt"], r["response"]) for r in got] == [("a", "b"), ("", "d")]


def printed(write, *a, **kw):
    out = io.StringIO()
    write(*a, out, **kw)
    return out.getvalue()


def test_reports(run, monkeypatch, tmp_path):
    _, long, summary = run
    rows = summary.orderBy("metric_ord").collect()
    text = printed(R.json_report, long, rows)
    doc = json.loads(text)
    assert text == json.dumps(doc, ensure_ascii=False, indent=2) + "\n"
    script = doc["metrics"]["Script adherence"]
    assert doc["version"] and list(doc["metrics"]) == ["Script adherence", "Trace check"] and [c["id"] for c in script["cases"]] == list("abcdef") and script["pass_rate"] == 5 / 6
    assert doc["metrics"]["Trace check"]["cases"][0]["detail"]["flagged_terms"][0]["term"] == "समुद्र तल" and doc["metrics"]["Trace check"]["skipped"] == 5
    md = printed(R.markdown_report, rows, R.each_failure(long))
    assert "❌ Script adherence | 83.3% | 5/6 | 0 | 0.833" in md and "2 failures" in md
    table = printed(R.table_report, rows, R.each_failure(long))
    assert "83.3%  5/6" in table and "○ skipped 5" in table and "FAILED below 100%: Script adherence, Trace check" in table and "PASSED" in printed(R.table_report, rows[:1], [], fail_under=0.8)
    assert "\x1b[" in printed(R.table_report, rows, R.each_failure(long), style=R.Style(True))
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "s.md"))
    assert R.job_summary_path() == str(tmp_path / "s.md") and R.job_summary_path(False) is None
    R.write_long(long, f"{tmp_path}/long")
    assert long.sparkSession.read.parquet(f"{tmp_path}/long").count() == 12 and (R.gauge(0.5, 4), R.gauge(1.0, 3), R.gauge(0, 2)) == ("██░░", "███", "░░")


def test_every_failure_is_listed_and_counted(spark):
    rows = [(i, f"c{i:03d}|x", "दिल्ली?", "word " * 60) for i in range(130)] + [(900, "ok", "Delhi?", "India")]
    cases = spark.createDataFrame(rows, "ord long, id string, prompt string, response string")
    long = E.long_results(E.evaluate(cases, ["script"]), ["script"])
    summary = E.summarize(long).collect()
    md, table = printed(R.markdown_report, summary, R.each_failure(long)), printed(R.table_report, summary, R.each_failure(long))
    ids = [f"c{i:03d}" for i in range(130)]
    assert "130 failures" in md and re.findall(r"c\d{3}(?=\\\|x)", md) == ids and re.findall(r"✗ (c\d{3})", table) == ids
    assert all(len(x.strip()) <= R.SHOWN + len("response  ") for x in table.splitlines() if "response" in x) and "…" in table
    assert len(json.loads(printed(R.json_report, long, summary))["metrics"]["Script adherence"]["cases"]) == 131
    assert json.loads(printed(R.json_report, long.limit(0), [])) == {"version": R.__version__, "metrics": {}}


def test_tokens_that_are_no_json(spark, tmp_path):
    p = tmp_path / "n.jsonl"
    p.write_text('{"prompt": "a NaN, \\"Infinity\\"", "gold": NaN, "lang": -Infinity}\n{"x": [NaN, 1], "answer": "Infinity"}', encoding="utf-8")
    assert loaded(spark, p) == [("1", 'a NaN, "Infinity"', "", "", "", ""), ("2", "", "Infinity", "", "", "")]
    p.write_text('{"prompt": NaNs}', encoding="utf-8")
    with pytest.raises(Exception, match="invalid JSON"):
        D.load_cases(spark, str(p)).collect()


def test_a_path_may_be_called_exchange(spark, tmp_path):
    d = tmp_path / "Exchange"
    d.mkdir()
    assert len(loaded(spark, lines(d / "Exchange.jsonl", CASES))) == 6


def test_progress_is_reported(spark):
    seen = []
    with Progress(spark, lambda i, n: seen.append((i, n)), every=0.01):
        spark.range(100_000).selectExpr("sum(id)").collect()
    assert seen and all(i <= n for i, n in seen)
    out = io.StringIO()
    with Progress(spark, out, every=0.01):
        pass
    assert out.getvalue().endswith("\r")


def test_sql_functions_say_what_the_columns_say(spark):
    names = sql.register(spark)
    d = spark.createDataFrame([(r[1], r[2]) for r in engine.FIXTURE], "p string, r string")
    odd = d.filter((F.expr("bhashya_script_class(p)") != X.script_class("p")) | (F.expr("bhashya_script_adherence(p, r)") != script_adherence("p", "r")["label"]) | (F.expr("bhashya_prompt_bucket(p)") != prompt_bucket("p")))
    assert odd.count() == 0 and len(names) == len(sql.FUNCTIONS) + 1
    assert spark.sql("SELECT bhashya_normalize_text('Résumé, 1,200.') AS x").first()["x"] == "resume 1.200"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("GITHUB_STEP_SUMMARY", raising=False)
    said = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    assert said("check", "Delhi kahan hai?", "India mein hai")[0] == 0 and said("check", "दिल्ली?", "India")[0] == 1
    code, out = said("check", "Delhi kahan hai?", "It is in India.", "--strict-language", "--json")
    assert code == 1 and json.loads(out)["label"] == "language_mismatch" and json.loads(out)["detail"]["prompt_bucket"] == "code-mixed"
    assert json.loads(said("detect", "aap kaise hain", "--json")[1]) == {"script": "roman", "counts": {"latin": 12}, "hinglish": True} and "(Hinglish)" in said("detect", "aap")[1]
    f = lines(tmp_path / "c.jsonl", CASES)
    assert said("run", f)[0] == 1 and said("run", f, "--no-trace-auto", "--fail-under", "0.8")[0] == 0
    code, out = said("run", f, "-f", "markdown", "-o", str(tmp_path / "o.json"))  # the file is JSON whatever is printed
    assert code == 1 and "| Metric |" in out and json.loads((tmp_path / "o.json").read_text())["metrics"]["Trace check"]["total"] == 1
    assert json.loads(said("run", f, "-f", "json")[1]) == json.loads((tmp_path / "o.json").read_text())
    assert said("run", f, "-f", "markdown", "-m", "trace,script")[1].index("Trace check") >= 0
    for a in (("run", "missing.jsonl"), ("run", f, "-m", "nonsense"), ("run", lines(tmp_path / "e.jsonl", []))):
        with pytest.raises(SystemExit):
            cli.main(list(a), spark)
    (tmp_path / "bad.jsonl").write_text("{")
    assert said("run", str(tmp_path / "bad.jsonl"))[0] == 2 and said("run", f, "-m", "judge", "--judge", "nobody")[0] == 2


def test_a_stream_gets_the_batchs_results(spark, tmp_path):
    cases = D.load_cases(spark, lines(tmp_path / "c.jsonl", CASES)).withColumn("at", F.timestamp_seconds(F.col("ord") * 60))
    cases.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(cases.schema).parquet(f"{tmp_path}/in")
    keep = ("ord", "id", "at")
    q = checks.windowed_pass_rate(checks.stream_results(stream, keep=keep), "at").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = checks.windowed_pass_rate(checks.stream_results(cases, keep=keep), "at")
    order = lambda d: sorted(tuple(r) for r in d.collect())
    assert order(spark.table("rates")) == order(batch) and sum(r[4] for r in order(batch)) == 5
