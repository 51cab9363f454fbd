"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, editsketch, extract, langid, licenses, pieces, pii, simhash, warc
from .common import table


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), decode=True).withColumnRenamed("id", "doc_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editsketch.report(table(spark, sf_dir, "documents"))


def near_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates by the bands of op10."""
    return editsketch.near_report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


#: For the public test tables and their SQL only; data of one's own needs a key of one's own.
TEST_KEY = "the key of the test tables"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), TEST_KEY)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def chat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool-call linking of op5 over a table of calls with several predecessors and many results."""
    return chat.orders_as_calls(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op8_decontaminate": op8_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_langid": op3_langid,
    "op10_edit_fingerprints": op10_edit_fingerprints,
    "near_edits": near_edits,
    "op7_warc": op7_warc,
    "op9_pii": op9_pii,
    "op1_licenses": op1_licenses,
    "op5_chat": op5_chat,
    "chat_orders": chat_orders,
    "op6_simhash": op6_simhash,
    "op4_extract": op4_extract,
}
