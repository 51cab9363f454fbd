"""``check``, ``detect`` and ``run`` on the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..functions.adherence import script_adherence
from ..functions.text import detection
from ..operators import evaluate as E
from ..operators.embedding import with_vectors
from ..operators.progress import Progress
from ..operators.calibration import DEFAULT_ENCODER
from ..operators.judging import make_judge
from ..sources.datasets import load_cases
from . import report as R


def session() -> SparkSession:
    return SparkSession.builder.appName("bhashya").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _one(spark: SparkSession, **texts: str) -> DataFrame:
    return spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))


def check(a, spark: SparkSession, out) -> int:
    r = _one(spark, prompt=a.prompt, response=a.response).select(script_adherence("prompt", "response", a.strict_language).alias("r")).first()["r"].asDict(True)
    if a.json:
        r["detail"] = {k: v for k, v in r["detail"].items() if v is not None}
        print(json.dumps(r, ensure_ascii=False, indent=2), file=out)
    else:
        s = R.Style.of(out, a.no_color)
        print(f"{s('32', '✓') if r['passed'] else s('31', '✗')} {r['label']}  {r['reason']}", file=out)
    return 0 if r["passed"] else 1


def detect(a, spark: SparkSession, out) -> int:
    r = _one(spark, text=a.text).select(detection("text").alias("r")).first()["r"].asDict(True)
    if a.json:
        print(json.dumps(r, ensure_ascii=False, indent=2), file=out)
    else:
        counts = ", ".join(f"{k} {v}" for k, v in sorted(r["counts"].items(), key=lambda kv: -kv[1]))
        print(f"{r['script']}  {counts}" + ("  (Hinglish)" if r["script"] == "roman" and r["hinglish"] else ""), file=out)
    return 0


def run(a, spark: SparkSession, out) -> int:
    """Evaluates a file; what is printed has the chosen format, what ``-o`` names is JSON."""
    if not os.path.exists(a.file):
        raise SystemExit(f"no such file: {a.file}")
    try:
        metrics = E.parse_metrics(a.metrics)
    except ValueError as e:
        raise SystemExit(str(e)) from None
    cases = load_cases(spark, a.file).cache()
    if cases.isEmpty():
        raise SystemExit(f"no cases in {a.file}")
    metrics = E.with_auto_trace(cases, metrics, not a.no_trace_auto)
    judge = make_judge(a.judge) if "judge" in metrics else None
    if "similarity" in metrics:
        cases = with_vectors(cases, a.encoder, allow_muril=False)
    style = R.Style.of(out, a.no_color)
    watch = Progress(spark, sys.stderr) if a.format == "table" and style.on else nullcontext()
    with watch:
        done = E.evaluate(cases, metrics, strict_language=a.strict_language, language=a.language, encoder=a.encoder, judge=judge)
        long = E.long_results(done, metrics).cache()
        rows = E.summarize(long).orderBy("metric_ord").collect()
    if a.format == "json":
        R.json_report(long, rows, out)
    elif a.format == "markdown":
        R.markdown_report(rows, R.each_failure(long), out)
    else:
        R.table_report(rows, R.each_failure(long), out, style, a.fail_under)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            R.json_report(long, rows, f)
    summary = R.job_summary_path(not a.no_github_summary)
    if summary:
        with open(summary, "a", encoding="utf-8") as f:
            R.markdown_report(rows, R.each_failure(long), f)
    return 1 if any(r["total"] and r["pass_rate"] < a.fail_under for r in rows) else 0


#: The commands' contract: names, flags and defaults. Fixed values.
COMMANDS = {
    "check": (check, {"prompt": {}, "response": {}, "--strict-language": None, "--json": None}),
    "detect": (detect, {"text": {}, "--json": None}),
    "run": (
        run,
        {
            "file": {}, "-m/--metrics": {"default": "script"}, "-l/--language": {"default": ""}, "--judge": {"default": "groq"}, "--encoder": {"default": DEFAULT_ENCODER}, "--strict-language": None,
            "--fail-under": {"type": float, "default": 1.0}, "-f/--format": {"choices": ("table", "json", "markdown"), "default": "table"}, "-o/--output": {}, "--no-trace-auto": None, "--no-github-summary": None,
        },
    ),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bhashya", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--no-color", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    for name, (do, arguments) in COMMANDS.items():
        c = commands.add_parser(name, help=do.__doc__)
        c.set_defaults(do=do)
        for flags, how in arguments.items():
            c.add_argument(*flags.split("/"), **({"action": "store_true"} if how is None else how))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all passed, 1: the gate failed, 2: malformed input or a missing client library."""
    a = parser().parse_args(argv)
    out = R.utf8()
    try:
        return a.do(a, spark or session(), out)
    except (ValueError, ImportError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if type(e).__module__.startswith("pyspark.errors"):  # raised by a row
            print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            return 2
        raise
