"""SentencePiece encoding and decoding by suffix-array matching.

The symbols of a batch's different segments are put behind one another and a
suffix array (up to the longest piece) is built over them. Every piece of the
model is looked up in it by binary search; its range of suffixes gives all its
occurrences. These are the edges of a lattice; sorted by their end position they
are relaxed from left to right, all segments in step.

For a BPE model the relaxation keeps, at each position, the one edge that is the
last token of the prefix's encoding. An edge qualifies if it and the last token
before it stay two tokens when merged by rank ("compatible"). The encodings are
those of the reference library, which the tests compare. For a unigram model
the relaxation keeps the edge with the best total score.

A space is the mark U+2581 and no piece has the mark after another character, so
a text falls apart, without loss, before every run of marks. It also does so
between any two characters that are neighbours in no piece, such as a letter and
a full stop. Segments that repeat within a batch are encoded once.

Whether a space is put in front, and whether the model is BPE or unigram, is read from
the vocabulary file; one that changes its text in other ways (a character map, blanks
that are taken out) is refused, as are pieces with an inner mark.

Nulls and empty texts give no tokens. Decoding gives the text back, except that
U+2581 itself becomes a space: there ``round_trip`` is false. Characters without a piece
become bytes. Repeated rows give repeated results; an empty table gives no rows; columns
other than the id and the text, of whatever name, are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: So few edges of one step are looked at one by one, more as arrays.
FEW = 16


def _fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: numbers, and the bytes of what has a length."""
    out, at = {}, 0

    def number():
        nonlocal at
        v = shift = 0
        while True:
            b = raw[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            n = number() if n is None else n
            value, at = raw[at : at + n], at + n
        out.setdefault(tag >> 3, []).append(value)
    return out


def settings(proto: bytes) -> tuple[bool, bool]:
    """(BPE, a space in front); raises for what changes texts in other ways."""
    model = _fields(proto)
    trainer, normalizer = (_fields(model[k][-1]) if k in model else {} for k in (2, 3))
    last = lambda m, k, default: m[k][-1] if k in m else default
    kind = last(trainer, 3, 1)
    if kind not in (1, 2):
        raise ValueError("only BPE and unigram models are supported")
    if last(normalizer, 2, b"") or last(normalizer, 4, 1) or not last(normalizer, 5, 1) or last(trainer, 24, 0) or not last(trainer, 35, 0):
        raise ValueError("the model changes its text, or has no bytes to fall back on")
    return kind == 2, bool(last(normalizer, 3, 1))


class PieceModel:
    """Pieces of a SentencePiece model, with what suffix-array encoding needs."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.bpe, self.spaced = settings(proto)
        self.strings = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id = np.zeros(256, np.int32)
        for b in range(256):
            self.byte_id[b] = sp.piece_to_id(f"<0x{b:02X}>")
        self.plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)}
        byte = {int(b): bytes([n]) for n, b in enumerate(self.byte_id)}
        self.bytes = [b"" if i in special else byte.get(i) or s.replace(MARK, " ").encode() for i, s in enumerate(self.strings)]
        of = {self.strings[i]: i for i in self.plain}
        if any(MARK in s.lstrip(MARK) for s in of):
            raise ValueError("pieces with an inner mark are not supported")
        self.depth = 4  # symbols of a suffix that its key holds
        while self.depth < max(map(len, of)):
            self.depth *= 2
        self.symbols = sorted({c for s in of for c in s})
        self.code = {c: i + 1 for i, c in enumerate(self.symbols)}
        self.table = np.zeros(0x110000, np.uint16)
        for c, i in self.code.items():
            if c in of:
                self.table[ord(c)] = i
        self.single = np.zeros(len(self.symbols) + 1, np.int32)
        for c, i in self.code.items():
            self.single[i] = of.get(c, 0)
        self.segment = self._segments(of)
        if self.bpe:
            self._merges(of)
        else:
            self.reach = self.plain
        order = np.array(self.reach, np.int32)
        codes = np.zeros((len(order), self.depth), ">u2")
        for r, i in enumerate(order):
            s = self.strings[i]
            codes[r, : len(s)] = [self.code[c] for c in s]
        self.piece, self.low = order, codes
        self.width = np.array([len(self.strings[i]) for i in range(self.size)], np.int64)

    def _segments(self, of: dict[str, int]) -> re.Pattern:
        """Cuts a text only where no piece reaches across."""
        letters = {c for c in map(chr, range(0x41, 0x250)) if c.isalpha()}
        near = {(a, b) for s in of for a, b in zip(s, s[1:])}
        joined = {c for ab in near for c in ab}
        after = {b for a, b in near if a in letters}
        alone = [chr(c) for c in range(128) if chr(c) not in joined and chr(c) not in letters]
        cut = [chr(c) for c in range(128) if chr(c) not in after and chr(c) not in letters and chr(c) in joined]
        ll, u, s = ("".join(map(re.escape, sorted(x))) for x in (letters, alone, cut))
        return re.compile(f"{MARK}*[{ll}]+(?=[{MARK}{s}{u}]|\\Z)|{MARK}*[^{MARK}{u}]*[{u}]+|{MARK}*[^{MARK}{u}]+|{MARK}+")

    def _merges(self, of: dict[str, int]) -> None:
        """Ranks, all pairs that merge, and each token's own last merge."""
        by_rank = sorted(self.plain, key=lambda i: (-self.score[i], i))
        rank = np.full(self.size, np.iinfo(np.int64).max // 4, np.int64)
        rank[by_rank] = np.arange(len(by_rank))
        left, right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.reach, keys, made = [], [], []
        for s, i in of.items():
            for k in range(1, len(s)):
                a, b = of.get(s[:k]), of.get(s[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(int(rank[i]))
        pair, made = np.array(keys, np.int64), np.array(made, np.int64)
        self.bits = max(4, (4 * len(pair)).bit_length())
        place = self._place(pair)
        o = np.argsort(place, kind="stable")
        self.pair, self.pair_rank = pair[o], made[o]  # those of one place side by side
        self.begin = np.searchsorted(place[o], np.arange((1 << self.bits) + 1)).astype(np.int32)
        for s, i in of.items():
            if len(s) == 1:
                self.reach.append(i)
                continue
            parts, last = [of.get(c, -1) for c in s], None
            while len(parts) > 1:
                best, at = None, -1
                texts = [self.strings[p] if p >= 0 else "" for p in parts]
                for k in range(len(parts) - 1):
                    m = of.get(texts[k] + texts[k + 1]) if parts[k] >= 0 and parts[k + 1] >= 0 else None
                    if m is not None and (best is None or rank[m] < rank[best]):
                        best, at = m, k
                if best is None:
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [best]
            if parts == [i] and last:
                left[i], right[i] = last
                self.reach.append(i)
        self.rank, self.left, self.right = rank, left, right

    def _place(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        """The rank at which each pair of tokens merges; beyond all ranks if it doesn't."""
        out = np.full(len(pair), np.iinfo(np.int64).max, np.int64)
        place = self._place(pair)
        at, end = self.begin[place], self.begin[place + 1]
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], pair[left]
        while len(left):
            same = self.pair[at] == key
            out[left[same]] = self.pair_rank[at[same]]
            at = at + 1
            on = ~same & (at < end)
            left, at, end, key = left[on], at[on], end[on], key[on]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE on the two tokens' text gives the two tokens again."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max // 2, np.int64)
        while len(live):
            bad = self._ranks(x * self.size + y) < limit
            ok[live[bad]] = False
            # undo the later of the two tokens' own last merges
            rx = np.where(self.right[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            on_x = rx > ry
            limit = np.where(on_x, rx, ry + 1)
            go = ~bad & ((rx >= 0) | (ry >= 0))
            x2, y2 = np.where(on_x, self.right[x], x), np.where(on_x, y, self.left[y])
            x, y, limit, live = x2[go], y2[go], limit[go], live[go]
        return ok

    # -- encoding of distinct segments --------------------------------------

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in a symbol array."""
        n, depth = len(text), self.depth
        pad = np.zeros(n + depth, np.uint64)
        pad[:n] = text
        k = (pad[:n] << np.uint64(48)) | (pad[1 : n + 1] << np.uint64(32)) | (pad[2 : n + 2] << np.uint64(16)) | pad[3 : n + 3]
        order, step = np.argsort(k), 4
        while True:  # ranks by the first `step` symbols
            s = k[order]
            rank = np.empty(n + depth, np.uint64)
            rank[n:] = 0
            rank[order] = np.cumsum(np.concatenate(([1], s[1:] != s[:-1])), dtype=np.uint64)
            if step >= depth:
                break
            k = (rank[:n] << np.uint64(32)) | rank[step : n + step]
            order = np.argsort(k)
            step *= 2
        order = order[text[order] != 0]
        keys = np.zeros((len(order), depth), ">u2")
        wide = np.zeros(n + depth, ">u2")
        wide[:n] = text
        stop = np.zeros(len(order), bool)
        for d in range(depth):  # nothing behind a segment's end
            c = wide[order + d]
            stop |= c == 0
            keys[:, d] = np.where(stop, 0, c)
        # zero after a segment sorts first, as in the suffix order only if what follows is cut as well
        sa = keys.view(f"S{2 * depth}").ravel()
        o = np.argsort(sa, kind="stable") if np.any(sa[1:] < sa[:-1]) else None
        if o is not None:
            sa, order = sa[o], order[o]
        kind = f"S{2 * depth}"
        low, high = self.low.view(kind).ravel(), self.low.copy()
        lo = np.searchsorted(sa, low, "left")
        high[high == 0] = 0xFFFF
        high = high.view(kind).ravel()
        hi = lo.copy()
        here = np.flatnonzero(lo < len(sa))
        here = here[sa[lo[here]] <= high[here]]  # pieces that occur at all
        hi[here] = np.searchsorted(sa, high[here], "right")
        count = hi - lo
        piece = np.repeat(self.piece, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return order[at], piece

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The int32 ids of each segment, as bytes."""
        joined = "\n".join(segments)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        begin = np.cumsum(size + 1) - size - 1
        text = self.table[points]
        if len(segments) > 1:
            text[begin[1:] - 1] = 0
        known = text != 0
        first = np.flatnonzero(known & np.concatenate(([True], ~known[:-1]))) if len(text) else np.zeros(0, np.int64)
        run = np.zeros(len(text), np.int64)
        run[first[1:]] = 1
        run = np.cumsum(run)
        last = np.full(len(text) + 1, -1, np.int64)  # token that ends before each position
        if len(first):
            start, piece = self._edges(text)
            end = start + self.width[piece]
            rel = end - first[run[start]]
            self._relax(start, end, piece, rel, first[run[start]], last)
        return self._trace(text, points, begin, size, first, run, last)

    def _relax(self, start, end, piece, rel, first, last) -> None:
        """Sets ``last``, the token that ends at each position, position by position in all segments at once."""
        if not len(start):
            return
        if not self.bpe:
            self._relax_scores(start, end, piece, last)
            return
        shift = self.depth.bit_length()
        order = np.argsort(((rel * (int(end.max()) + 1) + end) << shift) | (self.depth - self.width[piece]))
        start, end, piece, rel, first = (v[order] for v in (start, end, piece, rel, first))
        cut = np.flatnonzero(np.diff(rel, prepend=-1))
        fits: dict[tuple[int, int], bool] = {}
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rel)], strict=True):
            if b - a <= FEW:
                self._step(start[a:b].tolist(), end[a:b].tolist(), piece[a:b].tolist(), first[a:b].tolist(), last, fits)
                continue
            e = end[a:b]
            head = np.flatnonzero(np.diff(e, prepend=-1)) + a  # longest edge of each end
            tail = np.concatenate((head[1:], [b]))
            while len(head):
                s, p = start[head], piece[head]
                inner = s != first[head]
                good = ~inner
                if inner.any():
                    before = last[s[inner]]
                    ok = before >= 0
                    ok[ok] = self.compatible(before[ok], p[inner][ok])
                    good[inner] = ok
                last[end[head[good]]] = p[good]
                head, tail = head[~good] + 1, tail[~good]
                left = head < tail
                head, tail = head[left], tail[left]

    def _step(self, start, end, piece, first, last, fits) -> None:
        """The edges of one step, one by one: of each end, the longest that fits."""
        done = -1
        for s, e, p, f in zip(start, end, piece, first, strict=True):
            if e == done:
                continue
            if s != f:
                t = int(last[s])
                if t < 0:
                    continue
                ok = fits.get((t, p))
                if ok is None:
                    ok = fits[t, p] = bool(self.compatible(np.array([t]), np.array([p]))[0])
                if not ok:
                    continue
            last[e], done = p, e

    def _relax_scores(self, start, end, piece, last) -> None:
        order = np.argsort(end, kind="stable")
        best: dict[int, float] = {}
        for s, e, p in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True):
            v = best.get(s, 0.0) + float(self.score[p])
            if e not in best or v > best[e]:
                best[e] = v
                last[e] = p

    def _trace(self, text, points, begin, size, first, run, last) -> list[bytes]:
        """Walk back from the ends of all runs at once, then lay the tokens out."""
        n = len(text)
        token = np.full(n, -1, np.int64)  # by start position
        if len(first):
            stop = np.concatenate((first[1:], [n]))
            known = np.concatenate(([0], np.cumsum(text != 0)))
            at = first + (known[stop] - known[first])
            live = np.arange(len(first))
            while len(live):
                p = last[at[live]]
                at[live] -= self.width[p]
                token[at[live]] = p
                live = live[at[live] > first[live]]
        unknown = text == 0
        if len(begin) > 1:
            unknown[begin[1:] - 1] = False
        where = np.flatnonzero(token >= 0)
        cut = (np.searchsorted(where, np.concatenate((begin, [n]))) * 4).tolist()
        raw = token[where].astype(np.int32).tobytes()
        out = [raw[a:b] for a, b in zip(cut, cut[1:])]
        some = np.concatenate(([0], np.cumsum(unknown)))
        for i in np.flatnonzero(some[begin + size] > some[begin]).tolist():
            ids, b = [], int(begin[i])
            for k in range(b, b + int(size[i])):
                if unknown[k]:
                    ids += [int(self.byte_id[x]) for x in chr(points[k]).encode("utf-8", "replace")]
                elif token[k] >= 0:
                    ids.append(int(token[k]))
            out[i] = np.array(ids, np.int32).tobytes()
        return out

    # -- texts ----------------------------------------------------------------

    def encode(self, texts: list[str | None], span: int = 400_000) -> list[np.ndarray]:
        """Ids of each text; ``span`` characters share a suffix array, which bounds its memory."""
        find, front = self.segment.findall, MARK if self.spaced else ""
        cut = [find(front + t.replace(" ", MARK)) if t else [] for t in texts]
        ids: dict[str, bytes] = {}
        held, size = [], 0
        for w in dict.fromkeys(w for ws in cut for w in ws):
            held.append(w)
            size += len(w) + 1
            if size >= span:
                ids.update(zip(held, self.encode_segments(held), strict=True))
                held, size = [], 0
        if held:
            ids.update(zip(held, self.encode_segments(held), strict=True))
        return [np.frombuffer(b"".join(map(ids.__getitem__, ws)), np.int32) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw.removeprefix(b" ") if self.spaced else raw).decode("utf-8", "replace")


def load(spark: SparkSession, path: str = MODEL):
    """Read the model where the driver runs; the workers get it prepared."""
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    return spark.sparkContext.broadcast(model)


def _encoder(handle, chars: int, decode: bool, want_ids: bool):
    def run(batches):
        model = handle.value
        for t in common.groups(batches, chars):
            texts = t.column("text").to_pylist()
            ids = model.encode(texts)
            cols = {"id": t.column("id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            cols["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
            if want_ids:
                lens = np.cumsum([0, *map(len, ids)])
                cols["ids"] = pa.LargeListArray.from_arrays(lens, np.concatenate(ids) if ids else np.zeros(0, np.int32)).cast(pa.list_(pa.int32()))
            if decode:
                back = [model.decode(x) for x in ids]
                cols["n_chars_decoded"] = pa.array([len(b) for b in back], pa.int64())
                cols["round_trip"] = pa.array([b == (a or "") for a, b in zip(texts, back, strict=True)], pa.bool_())
            yield from pa.table(cols).combine_chunks().to_batches()

    return run


def encode(docs: DataFrame, *, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = True, decode: bool = False, chars: int = 4 << 20) -> DataFrame:
    """``id, n_tokens, ids_sha256[, ids][, n_chars_decoded, round_trip]`` for each row.

    ``chars`` bounds the text that is held at once, not what is encoded.
    """
    spark = docs.sparkSession
    df = common.ids_and_text(docs, id_col, text_col)
    schema = f"id {df.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string"
    schema += ", ids array<int>" * want_ids + ", n_chars_decoded long, round_trip boolean" * decode
    return df.mapInArrow(_encoder(load(spark, path), chars, decode, want_ids), schema)


def decode(tokens: DataFrame, *, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: the text of each row's ids; null ids give an empty text."""
    handle = load(tokens.sparkSession, path)

    def run(batches):
        model = handle.value
        for b in common.bounded(batches):
            back = [model.decode(np.array(x or [], np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string())], ["id", "text"])

    df = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].cast("array<int>").alias("ids"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, text string")
