"""Datasets of cases in CSV, JSON and JSON lines; labelled benchmarks; the embedding store."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import cache_key
from ..functions.text import is_blank
from ..functions.trace import AmbiguousTerm, default_terms

ALIASES: dict[str, tuple[str, ...]] = {
    "id": ("id", "case_id", "name"),
    "prompt": ("prompt", "question", "input", "user_input", "query"),
    "response": ("response", "answer", "output", "actual_output", "completion"),
    "gold": ("gold", "expected", "expected_output", "reference", "ground_truth"),
    "trace": ("trace", "reasoning", "judge_reasoning"),
    "language": ("language", "lang"),
}
#: Where a line ends beside CR and LF, which the reader sees to, as Python's ``splitlines`` has it.
LINE_END = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: NaN or an infinity that whole strings follow, and no backslash but theirs: it stands outside of strings.
_NOT_FINITE = r'-?\b(?:NaN|Infinity)\b(?=[^"\\]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"\\]*+)*+$)'
SIMILARITY_SCHEMA = "case_id string, task_id string, language string, label string, gold_text string, answer string"
JUDGE_SCHEMA = (
    "trace_id string, question string, answer string, trap_word string, correct_meaning string, wrong_meaning string, ground_truth_answer_type string, "
    "human_verdict_grader1 string, human_verdict_grader2_independent string, is_holdout boolean"
)
CASE_FIELDS = ("id", "prompt", "response", "gold", "trace", "language")


def cases_from_columns(df: DataFrame, order: str | list[str] | None = None) -> DataFrame:
    """Cases out of any table by column aliases.

    The first alias whose column is a string and not blank counts; names are
    compared in lower case without outer blanks, the later of two equal ones
    wins. A missing id becomes the row's number: by ``order`` (a column that holds
    the numbers, or the columns to number by), else as the table is scanned.
    """
    named: dict[str, str] = {f.name.strip().lower(): f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    d = df.withColumn("_ord", F.col(order).cast("long")) if isinstance(order, str) else _numbered_by(df, order) if order else _numbered(df)

    def pick(key: str) -> Column:
        found = [F.when(~is_blank(F.col(f"`{named[a]}`")), F.col(f"`{named[a]}`")) for a in ALIASES[key] if a in named]
        return F.coalesce(*found, F.lit(""))

    ident = F.when(pick("id") != "", pick("id")).otherwise(F.col("_ord").cast("string"))
    return d.select(F.col("_ord").alias("ord"), ident.alias("id"), *[pick(k).alias(k) for k in CASE_FIELDS[1:]])


_PLACE = (1 << 33) - 1


def _bases(counts: DataFrame, names: list[str]) -> DataFrame:
    """``_p, _b0, ...``: how much lies in the parts before each; a row for each part, a few
    numbers each. Spark sees their size and broadcasts them if it fits."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{k}") for k, c in enumerate(names)])


def _operators(plan) -> Iterator[str]:
    """The names of a physical plan's operators."""
    yield plan.nodeName()
    children = plan.children()
    for k in range(children.size()):
        yield from _operators(children.apply(k))
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _operators(plan.inputPlan())


def _numbered(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """``_ord`` from 1, in the order of a scan; of the rows to ``keep`` only, whose number among all is ``_no``.

    Counts of the scan's partitions are prefix-summed: no row is moved. A table
    that was shuffled may lie otherwise the next time, so it is refused.
    """
    if any("Exchange" in name for name in _operators(df._jdf.queryExecution().executedPlan())):
        raise ValueError("a shuffled table has no order of its own: name the columns to number by")
    keep = F.lit(True) if keep is None else keep
    part = lambda c: F.shiftright(c, 33)
    d = df.withColumn("_m", F.monotonically_increasing_id())
    counts = d.groupBy(part("_m").alias("_p")).agg(F.count("*").alias("n"), F.count_if(keep).alias("k"))
    d = d.filter(keep).withColumn("_k", F.monotonically_increasing_id()).withColumn("_p", part("_m"))
    d = d.join(_bases(counts, ["n", "k"]), "_p")
    place = lambda c: F.col(c).bitwiseAND(_PLACE) + 1
    return d.withColumn("_no", F.col("_b0") + place("_m")).withColumn("_ord", F.col("_b1") + place("_k")).drop("_p", "_m", "_k", "_b0", "_b1")


def _numbered_by(df: DataFrame, cols: list[str], parts: int = 64) -> DataFrame:
    """``_ord`` from 1 by the columns' order.

    Cut points come from the rows of smallest hash (a few for each part); rows are
    numbered within a part and the parts' counts are prefix-summed, so that no
    task sees more than a share of the rows, whatever one column's values are.
    """
    key = F.struct(*cols)
    some = df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(16 * parts)
    some = some.distinct().orderBy(*cols).collect()
    cuts = some[:: max(1, len(some) // parts)][1:]
    literal = lambda r: F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(cols, r, strict=True)])

    def bucket(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        mid = (low + high) // 2
        return F.when(key < literal(cuts[mid]), bucket(low, mid)).otherwise(bucket(mid + 1, high))

    d = df.withColumn("_p", bucket(0, len(cuts)))
    base = _bases(d.groupBy("_p").count(), ["count"])
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*cols))
    return d.withColumn("_n", nth).join(base, "_p").withColumn("_ord", F.col("_b0") + F.col("_n")).drop("_p", "_n", "_b0")


def _cases_from_variants(rows: DataFrame, where: str) -> DataFrame:
    """``ord, v`` (a variant for each row) to cases; a row that is no object raises."""
    shape = F.schema_of_variant("v")
    v = F.when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), F.raise_error(F.concat(F.lit(f"{where}: row "), F.col("ord").cast("string"), F.lit(" is not an object"))).cast("string"))
    text = F.coalesce(v, F.to_json("v"))
    keys = F.json_object_keys(text)
    # the text of each string value, by its trimmed lower-case name; the later of two equal names wins
    d = rows.select("ord", F.col("v"), keys.alias("k"))
    names = F.transform("k", lambda k: F.lower(F.trim(k)))

    def value(alias: str) -> Column:
        at = F.size("k") - F.array_position(F.reverse(names), alias) + 1
        name = F.when(F.array_contains(names, alias), F.element_at("k", at.cast("int")))
        got = F.try_variant_get("v", F.concat(F.lit("$['"), F.regexp_replace(name, "(['\\\\])", "\\\\$1"), F.lit("']")), "variant")
        return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(got, "$", "string"))

    def pick(key: str) -> Column:
        found = [F.when(~is_blank(value(a)), value(a)) for a in ALIASES[key]]
        return F.coalesce(*found, F.lit(""))

    ident = F.when(pick("id") != "", pick("id")).otherwise(F.col("ord").cast("string"))
    return d.select("ord", ident.alias("id"), *[pick(k).alias(k) for k in CASE_FIELDS[1:]])


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """``ord, id, prompt, response, gold, trace, language``: strings that are never null.

    ``.csv`` and ``.json`` by suffix, anything else is read as JSON lines. A
    byte-order mark is taken off. Malformed input raises with its place.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        df = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False, encoding="UTF-8").csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        return cases_from_columns(df)
    if suffix == ".json":
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
        doc = text.select(F.try_parse_json("value").alias("doc"))
        lists = [F.try_variant_get("doc", f"$.{k}", "variant") for k in ("cases", "data", "tests")]
        is_list = lambda c: F.coalesce(F.schema_of_variant(c).startswith("ARRAY"), F.lit(False))
        rows = F.when(is_list(F.col("doc")), F.col("doc"))
        rows = F.coalesce(rows, *[F.when(is_list(c) & (F.to_json(c) != "[]"), c) for c in lists])
        checked = F.when(rows.isNull(), F.raise_error(F.lit(f"{path}: expected a JSON list of objects")).cast("string")).otherwise(F.to_json(rows))
        each = doc.select(F.posexplode(F.from_json(checked, "array<variant>")).alias("pos", "v"))
        return _cases_from_variants(each.select((F.col("pos") + 1).cast("long").alias("ord"), "v"), path)
    lines = spark.read.text(path).select(F.explode(F.split("value", LINE_END, -1)).alias("line"))
    lines = _numbered(lines, ~is_blank("line"))
    text = F.when(F.col("_no") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    # NaN and the infinities are no JSON, but many writers put them; they are no texts, so null does as well
    finite = F.when(text.rlike("NaN|Infinity"), F.regexp_replace(text, _NOT_FINITE, "null")).otherwise(text)
    lines = lines.withColumn("v", F.try_parse_json(finite))
    bad = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("_no").cast("string"), F.lit(": invalid JSON")))
    return _cases_from_variants(lines.select(F.col("_ord").alias("ord"), F.when(F.col("v").isNull(), F.try_parse_json(bad.cast("string"))).otherwise(F.col("v")).alias("v")), path)


def load_terms(spark: SparkSession, path: str | None = None, sep: str = ",") -> DataFrame:
    """``term, reading_a, reading_b, origin``: the shipped dictionary or a CSV of one's own.

    Only rows with both readings are kept.
    """
    if path is None:
        return spark.createDataFrame([(t.term, t.reading_a, t.reading_b, t.origin) for t in default_terms()], "term string, reading_a string, reading_b string, origin string")
    df = spark.read.options(header=True, sep=sep, multiLine=True, escape='"').csv(path)
    of = {c.lower(): c for c in df.columns}
    col = lambda *names: next((F.col(f"`{of[n]}`") for n in names if n in of), F.lit(None).cast("string"))
    df = df.select(col("term", "target_word").alias("term"), col("reading_a", "suggested_reading_a", "first reading").alias("reading_a"), col("reading_b", "suggested_reading_b", "second reading").alias("reading_b"), F.coalesce(col("origin", "source"), F.lit("own")).alias("origin"))
    return df.filter(~is_blank("reading_a") & ~is_blank("reading_b"))


def collect_terms(terms: DataFrame, most: int = 2000) -> list[AmbiguousTerm]:
    """A dictionary small enough for literal patterns; a larger one stays a table."""
    rows = terms.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: use check_trace_with, which joins")
    return [AmbiguousTerm(r["term"], r["reading_a"], r["reading_b"], r["origin"]) for r in rows]


def load_similarity_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIMILARITY_SCHEMA).options(header=True, multiLine=True, escape='"').csv(path)


def load_judge_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGE_SCHEMA).option("multiLine", True).json(path)


def store_root(spark: SparkSession) -> str:
    """Where embeddings are kept: ``spark.bhashya.embedding.store``, which a cluster must name.

    A local master may go without: the user's cache folder then holds them.
    """
    path = spark.conf.get("spark.bhashya.embedding.store", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.bhashya.embedding.store must name a folder that driver and executors share")
    env = os.environ
    if env.get("BHASHYA_CACHE_DIR"):
        return "file://" + os.path.abspath(env["BHASHYA_CACHE_DIR"])
    base = env.get("XDG_CACHE_HOME") or env.get("LOCALAPPDATA")
    return "file://" + str((Path(base) if base else Path.home() / ".cache") / "bhashya")


def embedding_misses(texts: DataFrame, store: DataFrame, text: str = "text", is_query: bool = False) -> DataFrame:
    """``key, text`` of the different texts that the store (``key, embedding``) lacks."""
    wanted = texts.filter(F.col(text).isNotNull()).select(cache_key(text, is_query).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return wanted.join(store.select("key"), "key", "left_anti")


def embed(texts: DataFrame, store_path: str, encode: Callable[[list[str]], list[list[float]]], text: str = "text", is_query: bool = False) -> DataFrame:
    """Adds ``embedding``: from the store, into which what it lacks is encoded first.

    A store belongs to one encoder and revision: the keys are those of role and text.
    ``encode`` runs in the workers, once for each Arrow batch of different texts.
    """
    spark = texts.sparkSession
    schema = "key string, embedding array<float>"

    def run(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "embedding": encode(list(b["text"]))})

    def stored() -> DataFrame:
        # by its files: two reads of one folder count as the same to Spark, whatever was added between
        try:
            return spark.read.schema(schema).parquet(f"{store_path}/*.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    embedding_misses(texts, stored(), text, is_query).mapInPandas(run, schema).write.mode("append").parquet(store_path)
    return texts.withColumn("_key", cache_key(text, is_query)).join(stored().withColumnRenamed("key", "_key").dropDuplicates(["_key"]), "_key", "left").drop("_key")


def cache_stats(texts: DataFrame, store: DataFrame, text: str = "text", is_query: bool = False) -> DataFrame:
    """``hits, misses, hit_rate``; the rate is 0 without any text."""
    d = texts.filter(F.col(text).isNotNull()).select(cache_key(text, is_query).alias("key")).join(store.select("key", F.lit(1).alias("hit")).dropDuplicates(["key"]), "key", "left")
    hits = F.count("hit")
    return d.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.when(F.count("*") == 0, 0.0).otherwise(hits / F.count("*")).alias("hit_rate"))
