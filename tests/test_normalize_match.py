"""Normalisation, transliteration, string scores and alignment."""

import random
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pytest
from rows import on

from bhashya.functions import match as M
from bhashya.functions import normalize as N

PINNED = {
    "HELLO World": "hello world", "résumé naïve": "resume naive", "नमस्ते।": "नमस्ते", "-5": "-5", "100.5": "100.5", "1,200": "1.200", "e-mail": "email", "It costs 5.": "it costs 5", "௧௨௩": "123", "೧೨೩": "123",
    "Hello, world!": "hello world", "१,२००": "1.200", "  a \t b ": "a b", "": "", " \n": "", "5-6": "56", "a.b": "ab", "x-5": "x5", "(-7)": "-7", "1.2.3": "1.2.3", "①": "1", "5.,6": "56", "Ⅷ": "viii",
}


def test_pinned_normal_forms(spark):
    assert on(spark, [*PINNED, None], "t string", N.normalize("t")) == [*PINNED.values(), ""]
    assert [N.normalize_text(t) for t in PINNED] == list(PINNED.values())


def test_hinglish_is_transliterated_first(spark):
    assert on(spark, ["vah doctor hai.", "the doctor"], "t string", N.normalize("t")) == [N._fold("वह् डॉक्टर है."), "the doctor"]
    assert on(spark, ["vah doctor hai"], "t string", N.normalize("t", "kannada"))[0] == N.normalize_text("vah doctor hai", "kannada")


def test_catalyst_and_python_agree_on_random_ascii(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9 .,-!_\t(5\x1c'") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert on(spark, texts, "t string", N.normalize("t")) == [N.normalize_text(t) for t in texts]


def test_idempotent_on_native_and_english(spark):
    once = on(spark, ["The price, today, is -5.50!", "आज का भाव १,२०० है।", "naïve café"], "t string", N.normalize("t"))
    assert on(spark, once, "t string", N.normalize("t")) == once


def test_accents_go_only_from_latin_letters(spark):
    got = on(spark, ["é ñ ö", "क़", "ä़"], "t string", N.normalize("t"))
    assert got[0] == "e n o" and got[1] == unicodedata.normalize("NFKD", "क़")


def test_transliteration_anchors(spark):
    assert on(spark, ["kaise", "tune", "doctor", "", None], "t string", N.transliterate("t")) == ["कैसे", "तुने", "डॉक्टर", "", ""]
    assert on(spark, ["dhanyavaada"], "t string", N.transliterate("t", "KANNADA")) == ["ಧನ್ಯವಾದ"]
    assert N._to_devanagari("doctor") == "दोच्तोर्" and N.romanised_to("raajaa", "bengali") == "রাজা" and "।" in N.romanised_to("raam|", "telugu")
    with pytest.raises(ValueError, match="unknown script"):
        N.transliterate("t", "klingon")


SCORES = [("Hello, World!", "hello world"), ("namaskara", "namaskar"), ("red blue green", "green red blue"), ("", ""), (None, "x"), ("a a b", "a b b"), ("a b", "c d"), ("", " ")]


def plain_f1(a, b):
    x, y = N.normalize_text(a).split(), N.normalize_text(b).split()
    if not x or not y:
        return float(not x and not y)
    n = sum((Counter(x) & Counter(y)).values())
    return 0.0 if not n else 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y))


def test_scores(spark):
    got = on(spark, SCORES, "a string, b string", M.exact_match("a", "b"), M.token_f1("a", "b"), M.char_similarity("a", "b"))
    for (a, b), (exact, f1, ratio) in zip(SCORES, got, strict=True):
        x, y = N.normalize_text(a), N.normalize_text(b)
        assert (exact, f1, ratio) == (float(x == y), plain_f1(a, b), SequenceMatcher(None, x, y).ratio())


def test_f1_of_random_token_bags(spark):
    rng = random.Random(4)
    rows = [tuple(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(400)]
    assert on(spark, rows, "a string, b string", M.token_f1("a", "b")) == [plain_f1(*r) for r in rows]


def test_long_texts_keep_the_matchers_heuristics(spark):
    a, b = "ab" * 150, "ba" * 160
    assert on(spark, [(a, b)], "a string, b string", M.char_similarity("a", "b")) == [SequenceMatcher(None, a, b).ratio()]


def test_alignment(spark):
    rows = [("a b c", " a  b\tc"), ("the sea floor", ""), (None, None), ("w1 w2 w3 w4 x w6 w7 w8 w9 w10", "w1 w2 w3 w4 y w6 w7 w8 w9 w10"), ("a", "b")]
    got = on(spark, rows, "a string, b string", M.align("a", "b"), M.words_agree("a", "b"))
    assert [(x["aligned"], y) for x, y in got] == [(True, True), (False, False), (True, True), (False, False), (False, False)]
    assert got[3][0]["mismatched_response"] == "w2 w3 w4 x w6 w7 w8" and got[3][0]["mismatched_gold"] == "w2 w3 w4 y w6 w7 w8"
    assert got[0][0]["similarity_ratio"] == 1.0 and got[4][0]["similarity_ratio"] == 0.0


def test_words_agree_equals_the_udf(spark):
    rng = random.Random(5)
    rows = [tuple("".join(rng.choice("ab \t \x1c") for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(500)]
    assert all(x["aligned"] == y for x, y in on(spark, rows, "a string, b string", M.align("a", "b"), M.words_agree("a", "b")))


def test_python_holds_a_bounded_piece_of_a_batch():
    """However many rows and bytes Spark puts into a batch, few of them are Python objects at a time."""
    import pyarrow as pa

    from bhashya.functions.batches import PIECE, by_row, pieces

    rows = ["x" * 1000, None, "é" * 700, ""] * 2000 + ["y" * (3 * PIECE), "z"]
    whole = (pa.array(rows), pa.array(rows[::-1]))
    cut = list(pieces(whole))
    assert all(len(p[0]) == 1 or sum(c.nbytes for c in p) <= PIECE for p in cut) and len(cut) > 5
    assert [r for p in cut for r in p[0].to_pylist()] == rows and [r for p in cut for r in p[1].to_pylist()] == rows[::-1]
    got = list(by_row(lambda a, b: float(len(a) - len(b)), iter([whole]), pa.float64()))
    assert len(got) == len(cut) and [v for g in got for v in g.to_pylist()] == [None if a is None or b is None else float(len(a) - len(b)) for a, b in zip(rows, rows[::-1])]
    assert [list(map(len, by_row(str, iter([pa.array([], pa.string())]), pa.string())))] == [[0]]


def test_functions_yield_pieces_of_a_batch(spark):
    import pyarrow as pa

    from bhashya.functions import normalize as N

    batch = pa.array(["nकितना ३" * 200] * 2000)
    for udf, columns in ((N._fold_udf("devanagari"), batch), (N._translit_udf("devanagari"), batch), (M._f1, (batch, batch))):
        out = list(udf.func(iter([columns])))
        assert len(out) > 3 and sum(map(len, out)) == 2000
