"""Script classes, blanks, Hinglish cues, loanwords, adherence: pinned cases and random texts."""

import random

import pytest
from rows import on

from bhashya.functions import adherence as A
from bhashya.functions import text as X

from pyspark.sql import functions as F

SENTENCES = {
    "devanagari": "आज मौसम अच्छा है", "gurmukhi": "ਅੱਜ ਮੌਸਮ ਚੰਗਾ ਹੈ", "gujarati": "આજે હવામાન સારું છે", "odia": "ଆଜି ପାଗ ଭଲ ଅଛି", "tamil": "இன்று வானிலை நன்றாக உள்ளது",
    "telugu": "ఈరోజు వాతావరణం బాగుంది", "kannada": "ಇಂದು ಹವಾಮಾನ ಚೆನ್ನಾಗಿದೆ", "malayalam": "ഇന്ന് കാലാവസ്ഥ നല്ലതാണ്", "bengali": "আজ আবহাওয়া ভালো",
}


def test_classes_and_their_borders(spark):
    cases = [(None, "empty"), ("", "empty"), ("   ", "empty"), (" \x1c\x1f ", "empty"), ("hello", "roman"), ("123", "mixed"), ("😀", "mixed"), ("Где", "mixed")]
    cases += [("राज" + "a" * n, c) for n, c in ((2, "devanagari"), (3, "mixed"), (6, "mixed"), (7, "roman"))]
    cases += [("कख தமிழ்நா", "tamil"), ("कখ", "devanagari"), ("খত", "bengali")] + [(s, k) for k, s in SENTENCES.items()]
    assert on(spark, [t for t, _ in cases], "t string", X.script_class("t")) == [c for _, c in cases]


def plain_blank(t):
    return not (t or "").strip()


def plain_class(t):
    t = t or ""
    if plain_blank(t):
        return "empty"
    n = [(sum(lo <= ord(c) <= hi for c in t), k) for k, (lo, hi) in X.SCRIPTS.items()]
    most = max(x for x, _ in n)
    latin = sum(c.isascii() and c.isalpha() for c in t)
    return next(k for x, k in n if x == most) if most > latin else "roman" if latin > 2 * most else "mixed"


def test_random_texts_equal_plain_python(spark):
    rng = random.Random(11)
    letters = "aZ é\t\x1c \x850१৩।॥कखतथகখगਗಗൿఀॿ௰॰😀Я-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    got = on(spark, texts, "t string", X.script_class("t"), X.is_blank("t"), X.has_no_script_signal("t"), X.is_only_danda("t"), X.count_scripts("t"))
    for t, (label, blank, silent, danda, counts) in zip(texts, got, strict=True):
        assert (label, blank) == (plain_class(t), plain_blank(t)), repr(t)
        signal = any(c.isascii() and c.isalpha() or 0x900 <= ord(c) <= 0xD7F and not c.isdecimal() and c not in "।॥" for c in t)
        assert silent == (not signal), repr(t)
        indic = [c for c in t if 0x900 <= ord(c) <= 0xD7F]
        assert danda == (bool(indic) and set(indic) <= set("।॥") and not any(c.isascii() and c.isalpha() for c in t)), repr(t)
        assert sum(counts) == len(t) and counts["latin_alpha_chars"] == sum(c.isascii() and c.isalpha() for c in t)


def test_letters_leave_digits_and_dandas_out(spark):
    assert on(spark, ["க௧௰", "क१।॥॰"], "t string", X.letters_of("t", "tamil"), X.letters_of("t", "devanagari")) == [(2, 0), (0, 2)]


def test_columns_that_are_no_text_count_as_empty(spark):
    d = spark.createDataFrame([(5, None)], "n int, t string")
    assert d.select(X.coerce_text("n", d.schema["n"].dataType), X.coerce_text("t", d.schema["t"].dataType)).first() == ("", "")


def test_variants(spark):
    rows = [("hello", "en"), ("hello", "hi"), ("आज", "hi"), ("आज hello abc", "hinglish"), ("", "nonsense")]
    assert on(spark, rows, "t string, v string", X.is_script_adherent("t", "v")) == [True, False, True, True, False]
    with pytest.raises(Exception, match="unknown language variant"):
        on(spark, [("x", "xx")], "t string, v string", X.is_script_adherent("t", "v"))


def test_cues_are_whole_runs_of_letters(spark):
    cases = {"Delhi KA mausam": ["ka"], "Se7en": ["se"], "kaam": [], "hai-hain": ["hai", "hain"], "": [], "éka": ["ka"], "nahi NAHI": ["nahi"]}
    assert on(spark, list(cases), "t string", X.hindi_function_words("t"), X.looks_like_hinglish("t")) == [(w, bool(w)) for w in cases.values()]


def test_loanwords(spark):
    got = on(spark, ["Doctor", "doctors", "the DOCTOR, school7", None], "t string", X.lookup_loanword("t"), X.substitute_loanwords("t"))
    assert got == [("डॉक्टर", "डॉक्टर"), (None, "doctors"), (None, "the डॉक्टर, स्कूल7"), (None, "")]


def test_detection_and_clip(spark):
    d, short = on(spark, ["aap कौन हैं  9"], "t string", X.detection("t"), X.clip("t", 5))[0]
    assert (d["script"], d["counts"], d["hinglish"], short) == ("devanagari", {"devanagari": 6, "latin": 3}, True, "aap …")


ADHERENCE = [
    ("Where is Mumbai?", "12345 100 42", "no_script_signal"), ("12345 100 42", "12345 100 42", "no_script_signal"), ("Where is Mumbai?", "😀 🎉", "no_script_signal"), ("मुंबई कहाँ है?", "मुंबई 🎉 महाराष्ट्र में है 👍।", "matched"),
    ("Where is Moscow?", "Москва в России", "no_script_signal"), ("Mumbai kahan hai?", "Mumbai is the capital of Maharashtra.", "matched"), ("Mumbai kahan hai?", "मुंबई महाराष्ट्र में है।", "script_mismatch"),
    ("Mumbai kahan hai?", "Mumbai Maharashtra mein hai.", "matched"), (None, "x", "empty"), ("x", " ", "empty"), ("मुंबई?", "।", "no_script_signal"), ("मुंबई?", "१२३ ।", "no_script_signal"), ("मुंबई?", "१२३ शहर", "matched"),
    ("मुंबई?", "शहर है city यह", "devanagari"), ("मुंबई शहर", "abcd शहरर", "mixed"), ("शहर abcde", "hello", "matched"), ("hello", "शहर abcde", "mixed"),
]


def test_adherence_table(spark):
    got = on(spark, [c[:2] for c in ADHERENCE], "p string, r string", A.script_adherence("p", "r"))
    want = [("matched" if c[2] == "devanagari" else c[2]) for c in ADHERENCE]
    assert [g["label"] for g in got] == want
    assert all((g["score"], g["passed"]) == ((1.0, True) if g["label"] in ("matched", "mixed") else (0.0, False)) and g["reason"] for g in got)
    assert got[0]["detail"]["response_label"] == "mixed" and got[1]["detail"]["prompt_bucket"] is None and got[0]["detail"]["prompt_bucket"] == "romanized"


def test_every_pair_of_scripts(spark):
    names = list(SENTENCES)
    rows = [(SENTENCES[a], SENTENCES[b]) for a in names for b in names]
    labels = on(spark, rows, "p string, r string", A.script_adherence("p", "r")["label"])
    assert labels == ["matched" if a == b else "script_mismatch" for a in names for b in names]


def test_strict_language_check(spark):
    rows = [("Mumbai kahan hai?", "Mumbai is the capital."), ("Mumbai kahan hai?", "Mumbai yahin hai"), ("Where is Mumbai?", "It is here"), ("शहर abcde", "It is here")]
    assert on(spark, rows, "p string, r string", A.script_adherence("p", "r", True)["label"]) == ["language_mismatch", "matched", "matched", "matched"]
    assert on(spark, ["abc hai", "abc", "शहर", "शहर abc", ""], "t string", A.prompt_bucket("t")) == ["code-mixed", "romanized", "native-script", "code-mixed", "empty"]


def test_adherence_runs_without_python(spark):
    d = spark.createDataFrame([("a", "b")], "p string, r string").select(A.script_adherence("p", "r", True).alias("r"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_expressions_over_an_empty_table(spark):
    d = spark.createDataFrame([], "t string")
    assert d.select(X.script_class("t"), X.detection("t"), A.script_adherence("t", F.lit("x"))).count() == 0
