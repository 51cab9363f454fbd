"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled
text. A text is parsed against it: every phrase is the longest match that
starts where the last phrase ended. A match may be as long as the sample; a letter
that the sample lacks is a phrase of its own. Phrases are normalised by what it takes
to say where one begins, the logarithm of the sample's length; the language that needs
the fewest wins, and ties go to the smaller name.

All automata lie in one sparse table (a double array): a state is an offset, a
transition one look-up, whatever the alphabet. A batch of texts is parsed in step. For
that, texts are cut into blocks that are first parsed from their own beginnings; then
each block's parse is carried on into the next one until a phrase of both begins at one
place, from where on they agree. The phrases counted are those of the whole text.

The labelled sample is bounded: whole texts of at most ``train_docs`` documents a
language, those of smallest hash among the texts of at most ``train_text`` characters (or
one longer text, where there are no others), until they hold ``train_chars`` characters;
with very many languages a share of ``ALL_CHARS``. The table's size is measured before it
is broadcast. Labels that are null are never learned. Texts that are null or have no letter
give ``und`` with score 0. Repeated rows give repeated results; an empty table gives
no rows; without any labelled text every prediction is ``und``. Columns other than
those named, of whatever name, are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS = 96
TRAIN_TEXT = 4_000
TRAIN_CHARS = 60_000
ALL_CHARS = 4_000_000
MODEL_BYTES = 512 << 20
BLOCK = 1024
GAP, OTHER = 0, 1


def in_training_fold(id_col: str = "doc_id") -> Column:
    """Rows without an id are in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2, F.lit(True))


def training_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_text: int = TRAIN_TEXT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, text, h`` of at most ``train_docs`` documents for each label.

    Ranking limits each task's rows before the shuffle, so a label that holds most
    rows doesn't meet in one task.
    """
    w = Window.partitionBy("lang").orderBy("far", "h", "id")
    df = docs.filter(in_training_fold(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    df = df.withColumn("far", F.greatest(F.length("text") - train_text, F.lit(0)))
    return df.withColumn("r", F.row_number().over(w)).filter(f"r <= {train_docs} AND (far = 0 OR r = 1)").select("lang", "text", "h")


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all suffixes; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


class DoubleArray:
    """States of several automata as offsets into one table: state ``s`` has a transition
    by symbol ``c`` if the entry at ``s + c`` names ``s``; the entry's rest is where it leads."""

    def __init__(self):
        # offset 0 is the state without transitions
        self.used, self.bases, self.cursor, self.passed = bytearray(1), bytearray(1), 1, {}
        self.entries: list[tuple[int, int, int]] = []

    def _room(self, upto: int) -> None:
        if upto >= len(self.used):
            more = bytes(upto - len(self.used) + (1 << 16))
            self.used.extend(more)
            self.bases.extend(more)

    def _place(self, symbols: list[int]) -> int:
        """The next offset under which all symbols find room; it only moves on, and leaves
        holes to the many states of one symbol."""
        base, used, bases = self.cursor, self.used, self.bases
        while True:
            self._room(base + symbols[-1])
            if not bases[base] and not any(used[base + c] for c in symbols):
                self.cursor = base
                return base
            base += 1

    def _fill(self, symbol: int) -> int:
        """The next hole for a state of one symbol: what the symbol has passed once never fits it again."""
        slot = self.passed.get(symbol, symbol + 1)
        while True:
            slot = self.used.find(b"\0", slot)
            if slot < 0:
                slot = len(self.used)
                self._room(slot)
            if not self.bases[slot - symbol]:
                self.passed[symbol] = slot + 1
                return slot - symbol
            slot += 1

    def add(self, to: list[dict[int, int]]) -> int:
        """Puts an automaton in; returns its start state."""
        order = sorted(range(len(to)), key=lambda s: -len(to[s]))
        at = [0] * len(to)
        for s in order:
            if not to[s]:
                break
            symbols = sorted(to[s])
            base = at[s] = self._place(symbols) if len(symbols) > 1 else self._fill(symbols[0])
            self.bases[base] = 1
            for c in symbols:
                self.used[base + c] = 1
        self.entries += [(at[s] + c, at[s], at[n]) for s in order for c, n in to[s].items()]
        return at[0]

    def table(self) -> np.ndarray:
        width = max((e[0] for e in self.entries), default=0) + 1
        if len(self.bases) + width > np.iinfo(np.int32).max:
            raise ValueError("the samples are too large for one table")
        out = np.full(width, -1 << 32, np.int64)
        if self.entries:
            slot, state, to = np.array(self.entries, np.int64).T
            out[slot] = state << 32 | to
        return out


class CrossParser:
    """Parses texts against one automaton per language."""

    def __init__(self, samples: dict[str, str], block: int = BLOCK):
        self.langs, self.block = sorted(samples), block
        letters = sorted({c.lower()[0] for t in samples.values() for c in set(t) if c.isalpha() or unicodedata.category(c)[0] == "M"})
        self.codes = _code_table({c: i + 2 for i, c in enumerate(letters)})
        array, roots, size = DoubleArray(), [], []
        for name in self.langs:
            text = self.symbols(samples[name])[0].tolist()
            size.append(len(text))
            roots.append(array.add(suffix_automaton(text)))
        t = array.table()
        self.table = np.concatenate((t, np.full(len(letters) + 2, -1 << 32, np.int64)))  # no look-up leaves it
        self.roots = np.array(roots, np.int64)
        self.bits = np.log2(np.array(size, np.float64) + 1)
        if self.nbytes > MODEL_BYTES:
            raise ValueError(f"the automata take {self.nbytes} bytes, more than {MODEL_BYTES}: use smaller samples")

    @property
    def nbytes(self) -> int:
        return self.table.nbytes + self.codes.nbytes

    def symbols(self, text: str) -> tuple[np.ndarray, int]:
        """Codes of a text, runs of non-letters as one gap, none in front; and its letters."""
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = c == GAP
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        c = c[keep]
        return c, int(np.count_nonzero(c))

    def _step(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase starts with this symbol)."""
        e = self.table[state + symbol]
        starts = (e >> 32) != state
        if starts.any():
            e0 = self.table[root + symbol]
            e = np.where(starts, np.where((e0 >> 32) == root, e0, 0), e)
        return e & 0xFFFFFFFF, starts

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and text, letters by text)."""
        coded = [self.symbols(t) if t else (np.zeros(0, self.codes.dtype), 0) for t in texts]
        letters = np.array([n for _, n in coded], np.int64)
        n, b, k = len(texts), self.block, len(self.langs)
        sizes = np.array([len(c) for c, _ in coded], np.int64)
        blocks = -(-sizes // b)
        out = np.zeros((k, n), np.int64)
        if not blocks.sum() or not k:
            return out, letters
        m = int(blocks.sum())
        owner = np.repeat(np.arange(n), blocks)
        first = np.cumsum(blocks) - blocks
        flat = np.zeros(m * b, self.codes.dtype)
        for i, (c, _) in enumerate(coded):
            flat[first[i] * b : first[i] * b + len(c)] = c
        length = np.minimum(b, sizes[owner] - (np.arange(m) - first[owner]) * b)
        order = np.argsort(-length, kind="stable")
        grid = np.ascontiguousarray(flat.reshape(-1, b)[order].T)
        # every block from its own beginning
        root = np.repeat(self.roots[:, None], m, axis=1)
        state = np.zeros((k, m), np.int64)
        begins = np.zeros((k, b, m), bool)
        active = np.searchsorted(-length[order], -np.arange(b), "left")  # blocks longer than the step
        for j in range(b):
            w = active[j]
            if not w:
                break
            state[:, :w], begins[:, j, :w] = self._step(state[:, :w], grid[j, :w], root[:, :w])
        own = np.empty_like(state)
        own[:, order] = state
        place = np.argsort(order)
        begun = np.ascontiguousarray(begins[:, :, place].transpose(0, 2, 1)).reshape(k, m * b)
        before = np.concatenate((np.zeros((k, 1), np.int32), np.cumsum(begun, axis=1, dtype=np.int32)), axis=1)
        until = first * b + sizes
        total = before[:, until] - before[:, first * b]
        several = np.flatnonzero(blocks > 1)
        if len(several):
            extra, meets = self._carry_on(own, flat, begun, owner, until)
            for i in several.tolist():
                for q in range(k):
                    count, at = 0, int(first[i]) * b
                    while at < until[i]:
                        block = at // b
                        count += int(before[q, min((block + 1) * b, until[i])] - before[q, at]) + int(extra[q, block])
                        at = int(meets[q, block])
                    total[q, i] = count
        return total, letters

    def _carry_on(self, own, flat, begun, owner, until) -> tuple[np.ndarray, np.ndarray]:
        """For each language and block: phrases that begin beyond the block in its own parse,
        before the place where the parse of a later block agrees; and that place."""
        k, m = own.shape
        b = self.block
        extra, meets = np.zeros((k, m), np.int64), np.repeat(until[owner][None, :], k, axis=0)
        lang, lane = np.nonzero(np.repeat((np.arange(1, m + 1) * b < until[owner])[None, :], k, axis=0))
        at, state, root, end = (lane + 1) * b, own[lang, lane], self.roots[lang], until[owner[lane]]
        while len(lane):
            state, starts = self._step(state, flat[at], root)
            met = starts & begun[lang, at]
            meets[lang[met], lane[met]] = at[met]
            more = starts & ~met
            extra[lang[more], lane[more]] += 1
            at = at + 1
            go = ~met & (at < end)
            lang, lane, at, state, root, end = lang[go], lane[go], at[go], state[go], root[go], end[go]
        return extra, meets

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language or ``und``, score from 0 to 1, letters per phrase of the winner).

        A text that all languages parse in as many phrases shows no trace of any: its
        score is even. Else a language is likelier by two for each bit that it saves.
        """
        ph, letters = self.phrases(texts)
        cost, k, out = ph * self.bits[:, None], len(self.langs), []
        for i, n in enumerate(letters.tolist()):
            if not n or not k:
                out.append(("und", 0.0, 0.0))
                continue
            if k > 1 and (ph[:, i] == ph[0, i]).all():
                out.append((self.langs[0], 1 / k, float(n / ph[0, i])))
                continue
            win = int(np.argmin(cost[:, i]))
            saved = np.minimum(cost[:, i] - cost[win, i], 60)
            out.append((self.langs[win], float(1 / np.sum(2.0**-saved)), float(n / ph[win, i])))
        return out


def _code_table(of: dict[str, int]) -> np.ndarray:
    """The code of every character: letters of the samples, other letters, and the gap."""
    t = np.zeros(0x110000, np.uint16 if len(of) < 65_000 else np.uint32)
    for p in range(0x110000):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            t[p] = of.get(c.lower()[0], OTHER)
    return t


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_text: int = TRAIN_TEXT, **cols) -> CrossParser:
    """Fits the automata in the driver, on the bounded sample."""
    found = common.materialise(training_sample(docs, train_docs, train_text, **cols), "language-sample")
    labels = max(1, found.select("lang").distinct().count())
    each = min(train_chars, max(1, ALL_CHARS // labels))
    # no more rows come to the driver than it takes to fill each sample
    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("s", F.coalesce(so_far, F.lit(0))).filter(F.col("s") < each).select("lang", "h", "text").collect()
    common.discard(found)
    samples: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        samples.setdefault(r["lang"], {})[r["text"]] = None  # copies add nothing
    return CrossParser({lang: "\n".join(ts) for lang, ts in samples.items()})


def predict(docs: DataFrame, parser: CrossParser, *, id_col: str = "doc_id", text_col: str = "text", chars: int = 2 << 20) -> DataFrame:
    """``id, lang_pred, score, match_len``: by the text alone."""
    df = common.ids_and_text(docs, id_col, text_col)
    schema = f"id {df.schema['id'].dataType.simpleString()}, lang_pred string, score double, match_len double"
    return df.mapInArrow(_runner(docs, parser, chars, "id"), schema)


def _runner(docs: DataFrame, parser: CrossParser, chars: int, keep: str):
    handle = docs.sparkSession.sparkContext.broadcast(parser)  # its size was checked when it was built

    def run(batches):
        model = handle.value
        for t in common.groups(batches, chars):
            got = model.predict(t.column("text").to_pylist())
            out = pa.table({keep: t.column(keep), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "match_len": pa.array([g[2] for g in got], pa.float64())})
            yield from out.combine_chunks().to_batches()

    return run


def accepted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """The rows whose text has a language, all columns kept; null labels are filled in.

    Rejected are ``und`` texts and those that every one of several languages
    parses equally well, which thus show no trace of any of them.
    """
    parser, names = train(docs, text_col=text_col, lang_col=lang_col, **kw), docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].cast("string").alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, match_len double"
    got = packed.mapInArrow(_runner(docs, parser, 2 << 20, "row"), schema)
    even = 1 / max(1, len(parser.langs)) + 1e-9
    got = got.filter((F.col("lang_pred") != "und") & (F.lit(len(parser.langs) < 2) | (F.col("score") > even)))
    field = lambda c: F.col("row").getField(c)
    return got.select(*[(F.coalesce(field(c), F.col("lang_pred")) if c == lang_col else field(c)).alias(c) for c in names])


def report(docs: DataFrame, **kw) -> DataFrame:
    """The prediction for every document, with its fold."""
    return predict(docs, train(docs, **kw)).select(
        F.col("id").alias("doc_id"), (~in_training_fold("id")).alias("held_out"), "lang_pred", "score", "match_len"
    )
