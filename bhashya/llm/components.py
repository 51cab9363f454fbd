"""Connected components of a distributed edge list, and what is done with them.

Alternating large-star and small-star steps, each written to the shared folder, where
it takes the place of the one before. No edge, label or component comes to the driver:
only two numbers for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbourhood."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    low = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = low.groupBy("u").agg(F.min("v").alias("m"))
    moved = low.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


#: A key that more than one in so many rows have is joined by itself.
HOT = 1000


def with_class(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``labels``, one row of which stands for each ``key``.

    Very many rows may have one key (copies, empty texts). Labels of keys that at least
    one in ``HOT`` rows have, no more than ``HOT`` of them, are broadcast; the others meet
    their rows in an ordinary join. ``labels`` says how often a key occurs (``n``).
    """
    total = rows.count()
    hot = labels.filter(F.col("n") * HOT >= total).drop("n")
    by_self = rows.join(F.broadcast(hot), key)  # bounded: see above
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_self.unionByName(others.join(labels.filter(F.col("n") * HOT < total).drop("n"), key))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each class, all columns kept: that of the smallest id, and of rows of one
    id that of the smallest hash of its text. Of rows with the same id and text, one.

    ``classes``: ``id, th`` (the hash of the text)``, label`` for every row. Rows without an
    id stay only where no row of their class has one. What is kept grows with the documents,
    so it is never broadcast by force.
    """
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    first = classes.groupBy("label").agg(least.alias("k"))
    kept = common.materialise(first.select(F.col("k.id").alias("kept_id"), F.col("k.th").alias("kept_th")), "kept")
    th = F.xxhash64(docs[text_col].cast("string"))
    out = docs.join(kept.hint("shuffle_hash"), docs[id_col].eqNullSafe(kept["kept_id"]) & (th == kept["kept_th"]), "left_semi")
    if out.count() == kept.count():
        return out
    packed = out.select(F.struct(*[out[c] for c in docs.columns]).alias("row"), out[id_col].alias("id"), F.xxhash64(out[text_col].cast("string")).alias("th"))
    return packed.dropDuplicates(["id", "th"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges (first two columns); the label
    is the smallest node reachable. Loops and repeated edges do no harm."""
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = common.materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    before = None
    while True:
        now = tuple(e.agg(state.alias("s")).first()["s"])
        if now == before or now[0] == 0:
            break
        before, old = now, e
        e = common.materialise(_small(_large(e)), "edges")
        common.discard(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v")).distinct()
