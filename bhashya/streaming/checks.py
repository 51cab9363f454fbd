"""The checks over streams: stateless columns, and running summaries with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import evaluate, long_results


def stream_results(cases: DataFrame, metrics=("script",), keep=("ord", "id", "prompt", "response"), **kw) -> DataFrame:
    """Long results of a streaming (or batch) table of cases; no state."""
    return long_results(evaluate(cases, metrics, **kw), metrics, keep)


def windowed_pass_rate(results: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Cases and passes by metric and time window; late rows are dropped after ``late``."""
    d = results.withWatermark(at, late).filter(~F.col("skipped"))
    return d.groupBy(F.window(at, window).alias("w"), "metric").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).select("w.start", "w.end", "metric", "total", "passed")
