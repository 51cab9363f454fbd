"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every test item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window). The windows of one length form a Wu-Manber matcher:
a shift table over blocks of three words says how far the search may jump, a
bucket per block at the end of a window names the candidates, and a direct
comparison of the words confirms an occurrence. Documents are never shuffled.

Nulls and texts without words give ``n_words = 0`` and no hit; rows that repeat
give repeated results; columns other than the id and the text, of whatever name, are
ignored; an empty table of documents gives no rows, one of items no hits. An item without
an id is searched for like any other, but isn't named or counted among the items. The
search covers whole texts. The test items are a stated set that goes to every
task: its size is measured first, and a set larger than ``block_bytes`` is
searched in blocks, one pass over the documents for each. A matcher takes about a
hundred bytes for each byte of the items, so a block's takes some 200 MB of a worker.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256)
)

SCAN_SCHEMA = "id {kind}, text string, n_words long, starts array<long>, ends array<long>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z; a word is a run of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search for many word sequences of one length.

    ``patterns`` maps a word tuple to what it stands for.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(3, length)
        b = self.block
        self.far = length - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for p, what in patterns.items():
            for end in range(b, length + 1):
                k = p[end - b : end]
                d = length - end
                if d < self.shift.get(k, self.far):
                    self.shift[k] = d
            self.buckets[p[-b:]].append((p[0], list(p), what))

    def find(self, w: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, past the last word, what matched), by ascending position."""
        m, b, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        i, n = m, len(w)
        while i <= n:
            k = tuple(w[i - b : i])
            s = shift.get(k, far)
            if s:
                i += s
                continue
            head, seen = w[i - m], None
            for first, p, what in buckets[k]:
                if first == head and (seen or (seen := w[i - m : i])) == p:
                    yield i - m, i, what
            i += 1


def matchers(items: Iterable[tuple[object, str | None]], window: int = 10) -> list[WuManber]:
    by: dict[int, dict[tuple[bytes, ...], dict[str, None]]] = defaultdict(lambda: defaultdict(dict))
    for item, text in items:
        w = words(text.encode() if text is not None else None)
        if not w:
            continue
        m = min(window, len(w))
        for i in range(len(w) - m + 1):
            named = by[m][tuple(w[i : i + m])]
            if item is not None:
                named[str(item)] = None
    return [WuManber({p: list(x) for p, x in ps.items()}, m) for m, ps in sorted(by.items(), reverse=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict[str, list[WuManber]] = {}


def _built(key: str, make) -> list[WuManber]:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def _scanner(handle, window: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = handle.value
        found = _built(key, lambda: matchers(items, window))
        for batch in common.bounded(batches):
            texts = batch.column(1)
            n_words, starts, ends, ids = [], [], [], []
            for r, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                w = words(text)
                spans, names = [], set()
                for m in found:
                    for s, e, what in m.find(w):
                        spans.append((s, e))
                        names.update(what)
                if not first:
                    spans += zip(batch.column(3)[r].as_py(), batch.column(4)[r].as_py())
                    names.update(batch.column(5)[r].as_py())
                spans = merged(spans) if spans else spans
                n_words.append(len(w))
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                ids.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.nulls(len(texts), pa.string()) if last else texts, pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))],
                ["id", "text", "n_words", "starts", "ends", "items"],
            )

    return run


def scan(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, text (null), n_words, starts, ends, items``: merged word spans that any
    window covers, and the items with an occurring window, sorted as strings.

    ``block_bytes`` bounds what goes to every task at once. More test text than
    that is searched in several passes, whose results are kept in the shared folder.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    df = common.ids_and_text(docs, id_col, text_col)
    schema = SCAN_SCHEMA.format(kind=df.schema["id"].dataType.simpleString())
    kept = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.collect()]
        key = hashlib.sha256(repr((window, sorted(rows, key=repr))).encode()).hexdigest()
        df = df.mapInArrow(_scanner(spark.sparkContext.broadcast((key, rows)), window, b == 0, b == blocks - 1), schema)
        if b < blocks - 1:
            df = common.materialise(df, "decontaminate")
            common.discard(kept)
            kept = df
    return df


def report(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """One row per document: words, hit words, items found, and the verdict."""
    hits = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return scan(docs, items, **kw).select(
        F.col("id").alias("doc_id"),
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents without any occurrence, all columns kept.

    The verdict is found beside the rows themselves: no join back by id.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].alias("text"))
    kept = scan(packed, items, id_col="row", text_col="text", **kw).filter(F.size("starts") == 0)
    return kept.select(*[F.col("id").getField(c).alias(c) for c in names])
