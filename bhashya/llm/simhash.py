"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: the majority of the XXH64 hashes of a text's word
shingles. Two fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits. Of
such a pair one half differs in at most one bit, so each half is a table: it is
probed with the half itself and with the half less one of its set bits (of two
halves one bit apart, one has the bit set). What the table has is verified over
all 64 bits. Texts are reduced to distinct fingerprints first, so exact copies
are never paired.

A half that more than ``HEAVY`` fingerprints share isn't paired up. There, links
go through points of the other half: a fingerprint within one bit of a point
and one within two bits are linked, so each point links all that are near to the
smallest fingerprint within one bit. That finds the same components with a
number of rows in proportion to the fingerprints, and leaves nothing out.

Words are runs without ASCII white space, A-Z lower-cased; shingles are three
words, or all of them if fewer. Null and wordless texts have fingerprint zero and
are linked like any other. Repeated rows share a component; a component without any
id has none. An empty table gives no rows; columns other than the id and the text, of
whatever name, are ignored. Whole texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, one_of_each, with_class

MAX_BITS = 3
SHINGLE = 3
SEED = 42
HEAVY = 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    w = text.lower().split() if text else []
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    total, n = np.zeros(64, np.int64), max(1, len(w) - shingle + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, n)
    for at in range(0, n, 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, th, fp`` for each row: the hash of its text and the fingerprint, signed longs; no shuffle."""

    def run(batches):
        for b in common.bounded(batches):
            fp = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], ["id", "th", "fp"])

    df = common.ids_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, th long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """``side, key, rest, fp``: each half with the other one."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    sides = F.array(F.struct(F.lit(0).alias("side"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("side"), low.alias("key"), high.alias("rest")))
    return fps.select("fp", F.inline(sides)).select("side", "key", "rest", "fp")


_LESS_ONE_BIT = "transform(filter(sequence(0, 31), b -> getbit(key, b) = 1), b -> key - shiftleft(1L, b))"
_BALL1 = "concat(array(rest), transform(sequence(0, 31), b -> rest ^ shiftleft(1L, b)))"
_BALL2 = "array_distinct(flatten(transform(sequence(0, 31), a -> transform(sequence(a, 31), b -> CASE WHEN a = b THEN rest ELSE rest ^ shiftleft(1L, a) ^ shiftleft(1L, b) END))))"


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: edges that connect exactly what links of distinct fingerprints ``fp`` connect."""
    table = _halves(fps)
    large = common.materialise(table.groupBy("side", "key").count().filter(F.col("count") > heavy).select("side", "key"), "heavy")
    probes = table.select("side", F.explode(F.expr(f"concat(array(key), {_LESS_ONE_BIT})")).alias("key"), F.col("key").alias("own"), "rest", F.col("fp").alias("a"))
    light_table, light_probes = table, probes
    some = not large.isEmpty()
    if some:
        light_table = table.join(large, ["side", "key"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = light_probes.select("side", "key", "own", "a").join(light_table.select("side", "key", F.col("fp").alias("b")), ["side", "key"])
    out = pairs.filter(((F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))) & near).select("a", "b")
    if some:
        out = out.union(_through_points(table.join(large, ["side", "key"], "left_semi"), probes.filter("own <> key").join(large, ["side", "key"], "left_semi")))
    return out


def _through_points(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Edges within heavy halves: every one joins two fingerprints that link."""
    place = ["side", "key", "x"]
    near = members.select("side", "key", F.explode(F.expr(_BALL1)).alias("x"), "fp")
    hub = near.groupBy(place).agg(F.min("fp").alias("b"))
    far = members.select("side", "key", F.explode(F.expr(_BALL2)).alias("x"), F.col("fp").alias("a"))
    by = probes.select("side", "key", F.explode(F.expr(_BALL1)).alias("x"), "a")
    both = near.withColumnRenamed("fp", "a").union(far).union(by)
    ok = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return both.join(hub, place).filter((F.col("a") != F.col("b")) & ok).select("a", "b").distinct()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """``id, th, fp, label, component_id``: the smallest id reachable over links; ``label`` is one for each component."""
    own = common.materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    firsts = common.materialise(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    label = components(links(firsts.select("fp"), heavy)).withColumnRenamed("node", "fp")
    labelled = common.materialise(firsts.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of = common.materialise(labelled.join(least, "label").select("fp", "n", "label", "component_id"), "classes")
    common.discard(firsts, labelled)
    return with_class(own, of, "fp").select("id", "th", "fp", "label", "component_id")


def report(docs: DataFrame, **kw) -> DataFrame:
    return classes(docs, **kw).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component, that of the smallest id (see ``one_of_each``)."""
    return one_of_each(docs, classes(docs, id_col=id_col, text_col=text_col, **kw), id_col, text_col)
