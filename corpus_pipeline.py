"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Language ID, SimHash near-dedup, benchmark decontamination, PII, and
SentencePiece encoding. A stage takes (spark, docs, sf_dir) and returns a
DataFrame; it is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; further columns are left out.

Null and letterless texts go in the first stage. Rows of one id with different texts
are different documents; of rows with the same id and text one stays, with or without
an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashya.llm import common, decontaminate, editsketch, langid, pieces, pii, simhash
from bhashya.llm.queries import TEST_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, no letter, or as near to one language as to any other.

    ``lang`` is filled in where it is null; a label that a document has is kept.
    """
    return langid.accepted(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    SimHash finds copies with few differences in many words; of what it leaves, the
    bands of the edit embedding find those whose differences weigh more.
    """
    left = common.materialise(simhash.deduplicated(docs), "simhash-left")
    return editsketch.deduplicated(left).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten consecutive words of a test item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in every text; ``n_chars`` follows.

    The key comes from ``spark.bhashya.pseudonym.secret`` (a name that Spark redacts);
    only the test tables go with the key of the tests.
    """
    key = spark.conf.get("spark.bhashya.pseudonym.secret", TEST_KEY)
    return pii.apply(docs, key=key, found_col=None).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the proof that they decode to it."""
    out = pieces.encode(docs, decode=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "n_chars_decoded", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("sentencepiece", tokens),
]

#: Cross-parsing and XXH64 have no SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(before)
    return docs
