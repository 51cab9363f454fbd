"""Document fingerprints by a randomised edit embedding.

A walk goes over a stretch of text: at each step it puts out a small hash of the
characters where it stands, and then stays or moves on by a random bit that depends on
the step and the character alone. All texts share the bits, so that after an edit the
walks of two texts soon stand at the same place again: a small edit distance becomes a
small Hamming distance.

Walks start at the text's beginning and anew at places that the text itself names: where
a hash of the ``CONTEXT`` characters before it is one of a few (on average every ``MEAN``
characters, at least ``LEAST`` after the last one; where none comes for ``MOST``, as in
texts of few different characters, one is put there). An insertion moves these places
along with the text, so only the walks that it falls into change. The walks together
cover the whole text.

The fingerprint samples the embedding at ``SLOTS`` positions (four bits each). A slot
takes the walk whose starting place has the smallest random waiting time (in proportion
to the length of the walk, so that each character counts alike), and of its steps that of
the smallest priority; both choices change little as texts do. The share of equal
slots, corrected for chance, estimates which part of both texts they share; likeness
is that share put as twice what is common by the sum of both, which is a half for a text
of which half was replaced.

Near-duplicates: distinct fingerprints are dealt into ``BANDS`` bands, each a sample
of ``ROWS`` slots. What shares a band's slots is laid in an order of chance, a new one in
each band, and every fingerprint is verified, over all slots, against the first one and
the ``NEIGHBOURS`` before it. That is all pairs of a bucket with up to that many and two.
Of a larger one it is a number in proportion to its members, which mostly are near its
first; where they are not all of one class by then, all pairs of its classes are
verified as well (``across``). The classes are thus those of all pairs that share a bucket.

Null texts count as empty; an empty text has the fingerprint of zeros, and two
equal fingerprints have likeness 1. Whole texts are walked. Repeated rows give repeated
results; an empty table gives no rows; columns other than the two, of whatever name, are
ignored. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .components import components, one_of_each, with_class

SLOTS = 128
CONTEXT = 8
MEAN, LEAST, MOST = 64, 16, 1024
SEED = 20231
#: A pair of likeness 0.8 agrees in a band with probability 0.05, and in none of 60 with 0.05.
BANDS, ROWS = 60, 8
NEIGHBOURS = 4
LIKENESS = 0.8
#: Members of a bucket that are compared in one place; larger buckets are dealt out as pairs of blocks.
BLOCK = 16384
RANGE_BYTES = 16 << 20
_EMPTY = "0" * SLOTS
_M = (1 << 64) - 1
_MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def longest(n: int) -> int:
    """The steps that a walk over ``n`` characters may take: it moves on in every second one."""
    return 2 * n + int(5 * (2 * n) ** 0.5) + 16


class Embedding:
    """The shared random choices."""

    def __init__(self, slots: int = SLOTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.slots = slots
        self.steps = longest(MOST)
        self.bits = rng.integers(0, 2, (self.steps, 256), dtype=np.int32)
        self.bits[:, 0] = 0  # code 0 stands behind the end
        self.fold = rng.integers(1, 256, 1 << 16, dtype=np.uint8)
        # times at which the smallest priority among positions 0..t-1 changes, for each slot
        self.records = []
        for _ in range(slots):
            times, t = [1], 1
            while t < self.steps:
                t = int(t / (1 - rng.random())) + 1
                times.append(t)
            self.records.append(np.array(times, np.int64))
        self.chosen = np.empty((self.steps + 1, slots), np.int64)  # the step that a slot takes of so many
        total = np.arange(self.steps + 1)
        for s, times in enumerate(self.records):
            self.chosen[:, s] = times[np.maximum(np.searchsorted(times, total, "right") - 1, 0)] - 1
        self.mix = rng.integers(1, 1 << 62, slots, dtype=np.uint64) | np.uint64(1)
        self.order = rng.integers(1, 1 << 62, slots, dtype=np.uint64) | np.uint64(1)

    def codes(self, text: str) -> np.ndarray:
        p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.fold[(p ^ (p >> 16)) & 0xFFFF]

    def starts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a text's walks start, and the hash of each place (of its number since the last
        named place, where none is named)."""
        n = len(code)
        h = np.zeros(n + 1, np.uint64)  # of the characters before a place
        for d in range(CONTEXT):
            h[CONTEXT:] += code[d : n - CONTEXT + 1 + d].astype(np.uint64) * np.uint64(pow(_MIX1, d + 1, 1 << 64)) if n >= CONTEXT else np.uint64(0)
        h ^= h >> np.uint64(31)
        h *= np.uint64(_MIX2)
        h ^= h >> np.uint64(29)
        named = np.flatnonzero(h[CONTEXT:n] % np.uint64(MEAN) == 0) + CONTEXT if n > CONTEXT else np.zeros(0, np.int64)
        at, hashes, last = [0], [1], 0
        for p in [*named.tolist(), n]:
            k = 1
            while p - last > MOST:
                last += MOST
                at.append(last)
                hashes.append((hashes[-1] + k * _MIX1) & _M)
                k += 1
            if p - last >= LEAST and p < n:
                at.append(p)
                hashes.append(int(h[p]))
                last = p
        return np.array(at, np.int64), np.array(hashes, np.uint64)

    def fingerprints(self, texts: list[str]) -> list[str]:
        out = [_EMPTY] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        coded = [self.codes(texts[i]) for i in some]
        size = np.array([len(c) for c in coded], np.int64)
        base = np.cumsum(size + 4) - size - 4
        flat = np.zeros(int((size + 4).sum()) + 4, np.uint8)
        begin, length, hashes, walks = [], [], [], []
        for b, c in zip(base.tolist(), coded, strict=True):
            flat[b : b + len(c)] = c
            at, h = self.starts(c)
            begin.append(at + b)
            length.append(np.diff(at, append=len(c)))
            hashes.append(h)
            walks.append(len(at))
        begin, length, hashes = map(np.concatenate, (begin, length, hashes))
        # all walks in step, the longest first
        order = np.argsort(-length, kind="stable")
        go, end = begin[order], (begin + length)[order]
        limit = np.array([longest(n) for n in range(MOST + 1)])[length[order]]
        active = np.searchsorted(-limit, -np.arange(limit[0]), "left")
        here, trail = go.copy(), []
        total = np.zeros(len(go), np.int64)
        for j, w in enumerate(active.tolist()):
            x = here[:w]
            trail.append((x - go[:w]).astype(np.int16))
            on = x < end[:w]
            total[:w] += on
            x += self.bits[j][flat[x]] * on
        offset = np.cumsum(active) - active
        trail = np.concatenate(trail)
        place = np.argsort(order)
        # for each slot the walk of smallest priority; the longer one is, the sooner its time comes
        first = np.cumsum(walks) - walks
        number, none = np.arange(len(begin)), len(begin)
        walk = np.empty((self.slots, len(some)), np.int64)
        for s in range(self.slots):
            v = hashes * self.order[s]
            v ^= v >> np.uint64(32)
            v *= np.uint64(_MIX2)
            wait = -np.log(((v >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / length
            least = np.repeat(np.minimum.reduceat(wait, first), walks)
            walk[s] = np.minimum.reduceat(np.where(wait == least, number, none), first)
        lane = place[walk]
        step = self.chosen[total[lane], np.arange(self.slots)[:, None]]
        where = go[lane] + trail[offset[step] + lane]
        stop = end[lane]
        seen = np.zeros(where.shape, np.uint64)
        for d in range(4):  # the characters at the place, as one symbol; none beyond the walk
            seen = seen * np.uint64(257) + np.where(where + d < stop, flat[where + d], 0).astype(np.uint64)
        v = (seen + step.astype(np.uint64) * np.uint64(_MIX1) + hashes[walk]) * self.mix[:, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(_MIX2)
        nib = (v >> np.uint64(60)).astype(np.uint8).T
        raw = np.frombuffer(b"0123456789abcdef", np.uint8)[nib].tobytes().decode()
        for r, i in enumerate(some):
            out[i] = raw[r * self.slots : (r + 1) * self.slots]
        return out


def likeness_of(equal: int, slots: int = SLOTS) -> float:
    """From 0 (as unlike as chance makes them) to 1, by the number of equal slots."""
    shared = max(0.0, (equal / slots - 1 / 16) / (15 / 16))
    return 2 * shared / (1 + shared)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) != len(b) or _EMPTY in (a, b):
        return 0.0
    return likeness_of(sum(x == y for x, y in zip(a, b, strict=True)), len(a))


_SHARED: list[Embedding] = []


def embedding() -> Embedding:
    if not _SHARED:
        _SHARED.append(Embedding())
    return _SHARED[0]


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars: int = 3 << 20) -> DataFrame:
    """``id, th, fingerprint`` for each row, ``th`` the hash of its text; no shuffle."""

    def run(batches):
        e = embedding()
        for t in common.groups(batches, chars):
            fp = e.fingerprints([x or "" for x in t.column("text").to_pylist()])
            yield from pa.table({"id": t.column("id"), "th": t.column("th"), "fingerprint": pa.array(fp, pa.string())}).combine_chunks().to_batches()

    df = common.ids_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, th long, fingerprint string")


def most_unlike(likeness_at_least: float = LIKENESS, slots: int = SLOTS) -> int:
    """The number of slots in which two fingerprints of that likeness may differ."""
    return max(d for d in range(slots + 1) if d == 0 or likeness_of(slots - d, slots) >= likeness_at_least)


_NIBBLES = 0x1111111111111111


def _differ(a: str, b: str) -> Column:
    """In how many of the hex digits two fingerprints differ, sixteen at a time."""
    out = F.lit(0)
    for at in range(1, SLOTS + 1, 16):
        word = lambda c: F.conv(F.substring(c, at, 16), 16, -10).cast("long")  # noqa: B023, E731
        x = word(a).bitwiseXOR(word(b))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        out = out + F.bit_count(any_bit.bitwiseAND(_NIBBLES))
    return out


def sampled(bands: int, rows: int, seed: int) -> np.ndarray:
    """The slots of each band."""
    rng = np.random.default_rng(seed)
    return np.array([np.sort(rng.choice(SLOTS, rows, replace=False)) for _ in range(bands)])


def band_keys(fps: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """``key, fid`` for each band of ``fid, fp``: its number and the slots it samples, four
    bits each. Small rows: they are what is shuffled."""
    slots = sampled(bands, rows, seed)
    shift = (np.uint64(4) * np.arange(rows, dtype=np.uint64))[None, None, :]
    number = np.arange(bands, dtype=np.uint64)[None, :] << np.uint64(4 * rows)

    def run(batches):
        for b in common.bounded(batches, 1 << 19):
            hexes = np.frombuffer("".join(b.column(1).to_pylist()).encode(), np.uint8).reshape(-1, SLOTS)
            nib = np.where(hexes > 57, hexes - 87, hexes - 48).astype(np.uint64)
            key = (nib[:, slots] << shift).sum(axis=2, dtype=np.uint64) | number
            fid = np.repeat(b.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(fid)], ["key", "fid"])

    return fps.select("fid", "fp").mapInArrow(run, "key long, fid long")


def shared(keyed: DataFrame) -> DataFrame:
    """``key, fid`` of the buckets with more than one member.

    One shuffle, by bucket; a bucket is passed through, never held. Each document is in as
    many buckets as there are bands, so a group of copies is a small part of a task's rows.
    """
    w = Window.partitionBy("key").orderBy("fid")
    beside = F.coalesce(F.lag("fid", 1).over(w), F.lead("fid", 1).over(w))
    return keyed.select("key", "fid", beside.alias("beside")).filter("beside IS NOT NULL").select("key", "fid")


def candidates(keyed: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Distinct pairs ``a < b``: each member of a bucket with the first and the ones before it.

    Of a bucket with more than ``neighbours + 2`` members these are not all pairs (see ``across``).
    """
    w = Window.partitionBy("key").orderBy("o")
    dealt = keyed.repartition("key").withColumn("o", F.xxhash64("key", "fid"))
    first = F.first("fid").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.array_distinct(F.array_compact(F.array(first, *[F.lag("fid", k).over(w) for k in range(1, neighbours + 1)])))
    pairs = dealt.select("fid", before.alias("others")).filter((F.size("others") > 1) | (F.col("others")[0] != F.col("fid")))
    pairs = pairs.select("fid", F.explode("others").alias("other")).filter("fid <> other")
    return pairs.select(F.least("fid", "other").alias("a"), F.greatest("fid", "other").alias("b")).distinct()


def _planes(raw: np.ndarray) -> np.ndarray:
    """Fingerprints of 64 bytes each as four planes of 128 bits, one bit of every slot."""
    bit = np.unpackbits(raw, axis=1).reshape(len(raw), SLOTS, 4)
    return np.ascontiguousarray(np.packbits(bit.transpose(0, 2, 1), axis=2).view(np.uint64).transpose(1, 2, 0))


def _slots_apart(planes: np.ndarray, one: int, of: slice) -> np.ndarray:
    """In how many slots the fingerprints ``of`` differ from number ``one``."""
    x, many = planes[:, :, one, None], planes[:, :, of]
    out = 0
    for word in range(many.shape[1]):
        any_bit = many[0, word] ^ x[0, word]
        for p in range(1, 4):
            any_bit |= many[p, word] ^ x[p, word]
        out = out + np.bitwise_count(any_bit)
    return out.astype(np.int64)


def linked_classes(label: np.ndarray, raw: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of labels that connect what the links between members of different labels connect.

    The number of differing slots is a metric: a member further from a class's first one than
    ``most`` and the class's radius is linked to none of that class. All others are compared
    with its every member, until the two classes are found to be one.
    """
    names, group, size = np.unique(label, return_inverse=True, return_counts=True)
    by = np.argsort(-size, kind="stable")  # the largest class first
    names, size, group = names[by].tolist(), size[by].tolist(), np.argsort(by)[group]
    order = np.argsort(group, kind="stable")
    member, planes = group[order].tolist(), _planes(raw[order])
    root, found, begin = list(range(len(names))), [], 0

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for c, n in enumerate(size[:-1]):
        apart = _slots_apart(planes, begin, slice(begin, None))
        others = apart[n:]
        near = np.flatnonzero(others <= most + int(apart[:n].max()))
        for m in near[np.argsort(others[near], kind="stable")].tolist():
            other = member[begin + n + m]
            if find(other) != find(c) and (others[m] <= most or (_slots_apart(planes, begin + n + m, slice(begin, begin + n)) <= most).any()):
                root[find(other)] = find(c)
                found.append((names[c], names[other]))
        begin += n
    return found


def across(members: DataFrame, fps: DataFrame, most: int, *, more_than: int = NEIGHBOURS + 2, block: int = BLOCK) -> DataFrame:
    """``a, b``: pairs of labels that connect what the links within the buckets of ``members``
    (``key, fid, label``) with more than so many connect, as far as the labels don't.

    Buckets of a single label are done. The pairs of the others are all covered: a bucket of more
    than ``block`` members is cut into blocks, and each two of these meet in one place.
    """
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("greatest"))
    several = several.filter((F.col("n") > more_than) & F.expr("least < greatest")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(several, "key").join(fps.select("fid", F.unhex("fp").alias("raw")), "fid")
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(fid), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), o -> o <> own) END")))
    place = ["key", "i", "j"]
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label", "raw")

    def answer(t: pa.Table):
        raw = np.frombuffer(b"".join(t.column("raw").to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
        found = linked_classes(t.column("label").to_numpy(), raw, most)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches):
        held, last = [], None  # what has come of the last group, and its place
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in place], axis=1)
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()] if len(at) else []
            for start, stop in zip(starts, [*starts[1:], len(at)]):
                if held and at[start].tolist() != last:
                    yield from answer(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(start, stop - start))
                last = at[start].tolist()
        if held:
            yield from answer(pa.Table.from_batches(held))

    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", likeness_at_least: float = LIKENESS, bands: int = BANDS, rows: int = ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``id, th, fingerprint, label, component_id``: the smallest id reachable over verified
    links; ``label`` is one for each class.

    Equal fingerprints are always of one class. A class without an id has none. Bands,
    buckets and links are of 64-bit hashes of the fingerprints (``fid``); the
    fingerprints themselves decide.
    """
    most = most_unlike(likeness_at_least)
    own = common.materialise(fingerprint(docs, id_col=id_col, text_col=text_col), "edit-fingerprints")
    firsts = own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = common.materialise(firsts.withColumn("fid", F.xxhash64("fp")), "edit-distinct")
    fps = firsts.filter(F.col("fp") != _EMPTY).select("fid", "fp")

    met = common.materialise(shared(band_keys(fps, bands, rows, SEED)), "edit-shared")
    pairs = candidates(met, neighbours)
    pairs = pairs.join(fps.select(F.col("fid").alias("a"), F.col("fp").alias("fa")), "a").join(fps.select(F.col("fid").alias("b"), F.col("fp").alias("fb")), "b")
    edges = common.materialise(pairs.filter(_differ("fa", "fb") <= most).select("a", "b"), "edit-links")
    label = components(edges).withColumnRenamed("node", "fid")
    members = common.materialise(met.join(label, "fid", "left").withColumn("label", F.coalesce("label", "fid")), "edit-members")
    more = common.materialise(across(members, fps, most, more_than=neighbours + 2), "edit-across")
    labelled = firsts.join(label, "fid", "left").withColumn("label", F.coalesce("label", "fid"))
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        labelled = labelled.join(joined, "label", "left").withColumn("label", F.coalesce("whole", "label")).drop("whole")
    labelled = common.materialise(labelled, "edit-classes")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of = labelled.join(least, "label").select(F.col("fp").alias("fingerprint"), "n", "label", "component_id")
    of = common.materialise(of, "edit-of")
    common.discard(met, members, more, edges, firsts, labelled)
    return with_class(own, of, "fingerprint").select("id", "th", "fingerprint", "label", "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id (see ``one_of_each``)."""
    return one_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **kw), id_col, text_col)


def near_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def _cuts(df: DataFrame, partitions: int) -> list:
    """At most ``partitions - 1`` ids that cut the rows into ranges of about equal size."""
    if partitions < 2:
        return []
    if isinstance(df.schema["id"].dataType, T.NumericType):
        found = df.agg(F.percentile_approx("id", [k / partitions for k in range(1, partitions)], 10 * partitions)).first()[0] or []
        return sorted(set(found))
    some = df.filter("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(8 * partitions)
    some = sorted({r[0] for r in some.collect()})
    return some[:: max(1, len(some) // partitions)][1:]


def with_next(docs: DataFrame, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt out by ranges of the id, each range followed by a copy of the
    row that comes after it (``extra``): the next document is then the next row.

    Cut points come from a sketch (``partitions`` numbers; for ids that aren't
    numbers from the rows of smallest hash, a few for each range); only they and the first
    ids of the ranges pass through the driver. Rows of one id stay in one range, ordered
    by text. Null ids come first.
    """
    df = common.ids_and_text(docs, id_col, text_col)
    cuts = _cuts(df.select("id"), partitions)

    @F.pandas_udf("int")
    def part(ids):
        return ids.map(lambda x: bisect.bisect_right(cuts, x)).astype("int32")

    # no null reaches the UDF: it would turn whole numbers into floats
    df = df.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(part(F.coalesce("id", F.lit(cuts[0]).cast(df.schema["id"].dataType)))) if cuts else F.lit(0))
    heads = {r[0]: (r[1], r[2]) for r in df.select("part", "id").groupBy("part").agg(F.min("id"), F.count_if(F.col("id").isNull()) > 0).collect()}
    order = sorted(heads)
    first_id = {p: None if null else low for p, (low, null) in heads.items()}  # a null comes first
    is_head = F.col("id").isin([h for h in first_id.values() if h is not None])
    if None in first_id.values():
        is_head |= F.col("id").isNull()
    least = F.min(F.struct(F.col("text").isNotNull(), F.col("text")))["text"]
    first = df.filter(is_head).groupBy("part", "id").agg(least.alias("text"))
    before = dict(zip(order[1:], order)) | {order[0]: order[-1]} if order else {}  # after the last comes the first

    @F.pandas_udf("int")
    def previous(parts):
        return parts.map(before).astype("int32")

    extra = first.withColumn("part", previous("part")).withColumn("extra", F.lit(True))
    both = df.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.repartition(partitions, "part").sortWithinPartitions("part", "extra", "id", "text")


def report(docs: DataFrame, *, partitions: int | None = None, chars: int = 3 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they are.

    The ranges follow the size of the texts (``RANGE_BYTES`` each), not a setting.
    """
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    df = with_next(docs, partitions)

    def run(batches):
        e = embedding()
        held: list = []  # the last row, waiting for what comes after it
        for t in common.groups(batches, chars):
            rows = held + list(zip(t.column("id").to_pylist(), (x or "" for x in t.column("text").to_pylist()), t.column("part").to_pylist(), t.column("extra").to_pylist(), strict=True))
            held = rows[-1:]
            yield from answer(e, rows)
        yield from answer(e, [*held, None]) if held else ()

    def answer(e, rows):
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
        if not pairs:
            return
        texts = [a[1] for a, _ in pairs]
        after = [b[1] if b is not None and b[2] == a[2] else a[1] for a, b in pairs]
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after, strict=True)]
        every = e.fingerprints(texts + edited + after[-1:])
        k = len(pairs)
        own, new = every[:k], every[k : 2 * k]
        follow = [own[i + 1] if i + 1 < k and after[i] is texts[i + 1] else None for i in range(k)]
        follow[-1] = every[-1]
        rest = [i for i in range(k) if follow[i] is None]
        for i, f in zip(rest, e.fingerprints([after[i] for i in rest]) if rest else [], strict=True):
            follow[i] = f
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], kind), pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                pa.array(own, pa.string()), pa.array(new, pa.string()),
                pa.array(list(map(likeness, own, new)), pa.float64()), pa.array(list(map(likeness, own, follow)), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    kind = to_arrow_type(df.schema["id"].dataType)
    return df.mapInArrow(run, f"doc_id {df.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
