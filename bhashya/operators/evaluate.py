"""Batch evaluation of cases: one wide pass, a long table of results, summaries and the gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.adherence import script_adherence
from ..functions.similarity import calibrated_similarity
from ..functions.text import is_blank
from ..functions.trace import check_trace
from .calibration import DEFAULT_ENCODER
from .judging import judge_answers

METRICS = ("script", "similarity", "judge", "trace")
LONG = "struct<metric:string,metric_ord:int,score:double,passed:boolean,label:string,reason:string,detail:string>"


def parse_metrics(text: str | Iterable[str]) -> list[str]:
    """Names in their order, each once; unknown ones raise."""
    names = [m.strip() for m in (text.split(",") if isinstance(text, str) else text) if m.strip()]
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


def has_traces(cases: DataFrame) -> bool:
    return not cases.filter(~is_blank("trace")).limit(1).isEmpty()


def with_auto_trace(cases: DataFrame, metrics: list[str], auto: bool = True) -> list[str]:
    return [*metrics, "trace"] if auto and "trace" not in metrics and has_traces(cases) else metrics


def evaluate(
    cases: DataFrame, metrics: Iterable[str] = ("script",), *, strict_language: bool = False, language: str = "", encoder: str = DEFAULT_ENCODER, allow_muril: bool = False, judge=None, terms=None,
    vectors: tuple[str, str] = ("gold_vector", "response_vector"),
) -> DataFrame:
    """Adds a column for each metric; null means that the case was skipped.

    Similarity needs a gold text and a language (the case's, else ``language``), trace
    needs a trace. The judge's rows are split by need before any call. Nothing is
    shuffled for the script and trace checks.
    """
    names, d = parse_metrics(metrics), cases
    trace = F.col("trace") != ""
    for m in names:
        if m == "script":
            d = d.withColumn(m, script_adherence("prompt", "response", strict_language))
        elif m == "trace":
            d = d.withColumn(m, F.when(trace, check_trace("prompt", "trace", terms)))
        elif m == "similarity":
            own = F.col("language")
            lang = F.when(own != "", own).otherwise(F.lit(language))
            counts = (F.col("gold") != "") & (lang != "")
            # a skipped case must raise nothing: its gold is blank to the check, and its language known
            d = d.withColumn("_gold", F.when(counts, F.col("gold"))).withColumn("_in", F.when(counts, lang).otherwise("en")).withColumn("_counts", counts)
            d = calibrated_similarity(d, "_gold", "response", *vectors, F.col("_in"), encoder=encoder, allow_muril=allow_muril, out=m)
            d = d.withColumn(m, F.when(F.col("_counts"), F.col(m))).drop("_gold", "_in", "_counts")
        else:
            if judge is None:
                raise ValueError("the judge metric needs a judge")
            d = judge_answers(d, "prompt", "response", "gold", judge, out=m)
    return d


def long_results(evaluated: DataFrame, metrics: Iterable[str], keep: Iterable[str] = ("ord", "id", "prompt", "response")) -> DataFrame:
    """A row for each case and metric; skipped ones have nulls and ``skipped``."""
    each = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("metric_ord"), *[F.col(f"{m}.{c}").alias(c) for c in ("score", "passed", "label", "reason")], F.to_json(F.col(f"{m}.detail")).alias("detail"))
        for k, m in enumerate(parse_metrics(metrics))
    ]
    return evaluated.select(*keep, F.inline(F.array(*[e.cast(LONG) for e in each]))).withColumn("skipped", F.col("label").isNull())


def summarize(long: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Total, passed, skipped, pass rate (1.0 without cases) and mean score (0.0 without)."""
    total, passed = F.count("label"), F.count_if("passed")
    return long.groupBy("metric", "metric_ord", *by).agg(
        total.alias("total"), passed.alias("passed"), F.count_if("skipped").alias("skipped"),
        F.when(total == 0, 1.0).otherwise(passed / total).alias("pass_rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )


def failures(long: DataFrame) -> DataFrame:
    """Cases that didn't pass, by metric and then in the cases' order."""
    return long.filter(~F.col("passed")).orderBy("metric_ord", "ord")


def label_distribution(long: DataFrame) -> DataFrame:
    return long.filter(~F.col("skipped")).groupBy("metric", "label").count()


def gate(summary: DataFrame, fail_under: float = 1.0) -> DataFrame:
    """Metrics with cases and a pass rate below the bar; a run passes if there are none."""
    return summary.filter((F.col("total") > 0) & (F.col("pass_rate") < fail_under))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant's next turn, as cases.

    An equi-join on conversation and turn, not a window: a conversation of very
    many turns isn't sorted in one task.
    """
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(said, ["conv_id", "turn"])


def scored_for_calibration(benchmark: DataFrame, score: Column | str, language: str | None = None, label: str = "label") -> DataFrame:
    """``score, is_correct`` of labelled benchmark rows; every wrong label counts as wrong."""
    d = benchmark if language is None else benchmark.filter(F.col("language") == language)
    return d.select(*[c for c in ("case_id", "language") if c in d.columns], (F.col(score) if isinstance(score, str) else score).cast("double").alias("score"), (F.col(label) == "correct").alias("is_correct"))


def judge_agreement(df: DataFrame, verdict: Column | str, grader1: str, grader2: str, only: Column | None = None) -> DataFrame:
    """One row: ``n`` and the agreement with two graders (0.0 without rows)."""
    d = df if only is None else df.filter(only)
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    d = d.select(v.eqNullSafe(F.col(grader1)).alias("g1"), v.eqNullSafe(F.col(grader2)).alias("g2"))
    share = lambda g: F.coalesce(F.avg(F.col(g).cast("double")), F.lit(0.0))
    return d.agg(F.count("*").alias("n"), share("g1").alias("agreement_grader1"), share("g2").alias("agreement_grader2"))


def judge_disagreements(df: DataFrame, verdict: Column | str, grader1: str, grader2: str, ident: str, order: str, only: Column | None = None) -> DataFrame:
    """``ord, id`` of the rows that differ from either grader: a table, however many there are."""
    d = df if only is None else df.filter(only)
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    odd = ~(v.eqNullSafe(F.col(grader1)) & v.eqNullSafe(F.col(grader2)))
    return d.filter(odd).select(F.col(order).alias("ord"), F.col(ident).cast("string").alias("id"))
