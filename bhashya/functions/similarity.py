"""Calibrated similarity of embedded texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import DEFAULT_ENCODER, DEFAULT_THRESHOLD, LANGUAGES, MURIL, TABLE_SCHEMA, calibration_table
from .adherence import reason_of, result
from .text import column, is_blank

E5 = {"intfloat/multilingual-e5-base"}
REASONS = {
    "empty": "There is no gold text or no response.",
    "similar": "The response is at or above the calibrated threshold.",
    "dissimilar": "The response is below the calibrated threshold.",
    "similar_uncalibrated": "At or above the default threshold; this encoder and language are not calibrated.",
    "dissimilar_uncalibrated": "Below the default threshold; this encoder and language are not calibrated.",
    "low_discrimination": "The encoder tells right from wrong too poorly in this language.",
}


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = column(a).cast("array<double>"), column(b).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def mean_pool(token_vectors: Column | str, mask: Column | str) -> Column:
    """Masked mean of an array of token vectors, of unit length; zeros without any token."""
    v, m = column(token_vectors).cast("array<array<double>>"), column(mask).cast("array<double>")
    add = lambda s, x: F.zip_with(s, x, lambda p, q: p + q)
    weighted = F.zip_with(v, m, lambda x, k: F.transform(x, lambda y: y * k))
    total = F.aggregate(weighted, F.transform(v[0], lambda _: F.lit(0.0)), add)
    n = F.greatest(F.aggregate(m, F.lit(0.0), lambda s, k: s + k), F.lit(1e-9))
    size = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    # the mean's divisor drops out of a vector of unit length; it stays for one without any token
    return F.when(size > 0, F.transform(total, lambda x: x / size)).otherwise(F.transform(total, lambda x: x / n))


def prepared(text: Column | str, encoder: str, is_query: bool) -> Column:
    """What an encoder is given: some want the role in front."""
    t = column(text)
    return F.concat(F.lit("query: " if is_query else "passage: "), t) if encoder in E5 else t


def cache_key(text: Column | str, is_query: bool) -> Column:
    return F.sha2(F.concat(F.lit(("query" if is_query else "passage") + "\0"), column(text)), 256)


def check_encoder(encoder: str, allow_muril: bool) -> None:
    if encoder == MURIL and not allow_muril:
        raise ValueError("this encoder's cosines barely differ; pass allow_muril=True to use it")


def calibrated_similarity(
    df: DataFrame, gold: str, response: str, gold_vector: str, response_vector: str, language: Column | str, *, encoder: str = DEFAULT_ENCODER, allow_muril: bool = False, min_auc: float = 0.7, out: str = "similarity"
) -> DataFrame:
    """Adds the result struct ``out``.

    Gold is embedded as a passage, the response as a query. A blank text is
    ``empty`` before the language is looked at; other languages than the three
    raise, and so do a NaN cosine and a missing vector.
    """
    check_encoder(encoder, allow_muril)
    table = calibration_table(df.sparkSession).filter(F.col("encoder") == encoder).select(F.struct(*[c.split()[0] for c in TABLE_SCHEMA.split(", ")]).alias("_cell"), F.col("language").alias("_lang"))
    d = df.withColumn("_l", column(language))
    d = d.join(F.broadcast(table), F.col("_l") == F.col("_lang"), "left")  # 15 rows at most
    blank = is_blank(gold) | is_blank(response)
    cell = F.col("_cell")
    raw = cosine_similarity(gold_vector, response_vector)
    known = F.col("_l").isin(*LANGUAGES)
    raw = F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce("_l", F.lit("null")))).cast("double")).otherwise(raw)
    raw = F.when(raw.isNull(), F.raise_error(F.lit("a text has no vector")).cast("double")).otherwise(raw)
    raw = F.when(blank, F.lit(None).cast("double")).otherwise(raw)
    raw = F.when(F.isnan(raw), F.raise_error(F.lit("cosine is NaN")).cast("double")).otherwise(raw)
    score = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))  # both skip nulls
    limit = F.coalesce(cell["threshold"], F.lit(DEFAULT_THRESHOLD))
    low = cell["roc_auc"] < min_auc
    above = score >= limit
    label = F.when(blank, "empty").when(F.coalesce(low, F.lit(False)), "low_discrimination")
    label = label.when(cell.isNull(), F.when(above, "similar_uncalibrated").otherwise("dissimilar_uncalibrated")).otherwise(F.when(above, "similar").otherwise("dissimilar"))
    passed = label.isin("similar", "similar_uncalibrated")
    shown = lambda c: F.when(~blank, c)
    detail = F.struct(
        shown(F.lit(encoder)).alias("encoder"), shown(F.col("_l")).alias("language"), shown(limit).alias("threshold"), shown(cell.isNotNull()).alias("calibrated"), raw.alias("unclamped_cosine_similarity"),
        shown(score).alias("raw_cosine_similarity"), shown(cell["accuracy_at_threshold"]).alias("calibration_accuracy_at_threshold"), shown(cell["n_cases"]).alias("calibration_n_cases"),
        shown(cell["warnings"]).alias("calibration_warnings"), F.when(label == "low_discrimination", cell["roc_auc"]).alias("roc_auc"),
    )
    res = result(label, passed, F.coalesce(score, F.lit(0.0)), reason_of(label, REASONS), detail)
    return d.withColumn(out, res).drop("_l", "_lang", "_cell")
