"""Text normalisation across scripts, numerals and romanised Hindi.

ASCII texts, by far the most, stay in Catalyst. The rest goes to one Arrow UDF,
which gets null for every row that doesn't need it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_row
from .text import LOANWORDS, coerce_text, is_blank, looks_like_hinglish, script_class, substitute_loanwords

_LOAN = re.compile(rf"(?<![A-Za-z])({'|'.join(LOANWORDS)})(?![A-Za-z])", re.I)

# -- ITRANS romanisation, from its public tables -----------------------------------
_VOWELS = {"aa": "आ", "A": "आ", "a": "अ", "ii": "ई", "I": "ई", "ee": "ई", "i": "इ", "uu": "ऊ", "U": "ऊ", "oo": "ऊ", "u": "उ", "RRi": "ऋ", "R^i": "ऋ", "LLi": "ऌ", "L^i": "ऌ", "ai": "ऐ", "e": "ए", "au": "औ", "o": "ओ"}
_SIGNS = {"आ": "ा", "इ": "ि", "ई": "ी", "उ": "ु", "ऊ": "ू", "ऋ": "ृ", "ऌ": "ॢ", "ए": "े", "ऐ": "ै", "ओ": "ो", "औ": "ौ", "अ": ""}
_CONSONANTS = {
    "kSh": "क्ष", "ksh": "क्ष", "x": "क्ष", "j~n": "ज्ञ", "dny": "ज्ञ", "GY": "ज्ञ", "gy": "ज्ञ", "shr": "श्र", "k": "क", "kh": "ख", "g": "ग", "gh": "घ", "~N": "ङ", "N^": "ङ", "ch": "च", "c": "च", "Ch": "छ", "chh": "छ",
    "j": "ज", "jh": "झ", "~n": "ञ", "JN": "ञ", "T": "ट", "Th": "ठ", "D": "ड", "Dh": "ढ", "N": "ण", "t": "त", "th": "थ", "d": "द", "dh": "ध", "n": "न", "p": "प", "ph": "फ", "b": "ब", "bh": "भ",
    "m": "म", "y": "य", "r": "र", "l": "ल", "L": "ळ", "ld": "ळ", "v": "व", "w": "व", "sh": "श", "Sh": "ष", "shh": "ष", "s": "स", "h": "ह",
    "q": "क़", "K": "ख़", "G": "ग़", "z": "ज़", "J": "ज़", "f": "फ़", ".D": "ड़", ".Dh": "ढ़",
}
_MARKS = {"M": "ं", ".n": "ं", ".m": "ं", "H": "ः", ".N": "ँ", ".a": "ऽ", "OM": "ॐ", "AUM": "ॐ", "|": "।", "||": "॥"}
#: Offset of each target block from Devanagari, in which the scripts run in parallel.
TARGETS = {"devanagari": 0, "bengali": 0x80, "gurmukhi": 0x100, "gujarati": 0x180, "odia": 0x200, "tamil": 0x280, "telugu": 0x300, "kannada": 0x380, "malayalam": 0x400}
_TAMIL = {"ख": "क", "ग": "क", "घ": "क", "छ": "च", "झ": "ज", "ठ": "ट", "ड": "ट", "ढ": "ट", "थ": "त", "द": "त", "ध": "त", "फ": "प", "ब": "प", "भ": "प"}


#: Every sign, the longest first, and anything else one by one.
_SIGN = re.compile("|".join(sorted(map(re.escape, [*_CONSONANTS, *_VOWELS, *_MARKS]), key=lambda x: -len(x))) + "|.", re.S)
_FULL = {**_MARKS, **_VOWELS, **_CONSONANTS}
_DEPENDENT = {part: _SIGNS[sign] for part, sign in _VOWELS.items()}


def _signs_of(text: str) -> str:
    out: list[str] = []
    bare = False  # the last sign is a consonant without a vowel yet
    for part in _SIGN.findall(text):
        if bare and part in _DEPENDENT:
            out.append(_DEPENDENT[part])
            bare = False
            continue
        consonant = part in _CONSONANTS
        if bare and part not in _MARKS:
            out.append("्")
        out.append(_FULL.get(part, part))
        bare = consonant
    return "".join(out) + "्" * bare


_word = lru_cache(maxsize=1 << 15)(_signs_of)


def _run_to_devanagari(text: str) -> str:
    """Words are kept, longer runs seldom come again."""
    return _word(text) if len(text) <= 40 else _signs_of(text)


#: Runs of what romanised signs are made of; nothing reaches from one run into the next.
_RUN = re.compile(r"[A-Za-z~^.|]+")


def _to_devanagari(text: str) -> str:
    return _RUN.sub(lambda m: _run_to_devanagari(m[0]), text)


def romanised_to(text: str, script: str = "devanagari") -> str:
    """ITRANS text in one of nine scripts; known loanwords first, for Devanagari only."""
    script = script.lower()
    if script not in TARGETS:
        raise ValueError(f"unknown script: {script}")
    if not text:
        return text
    if script == "devanagari":
        text = _LOAN.sub(lambda m: LOANWORDS[m[0].lower()], text)
    text, shift = _to_devanagari(text), TARGETS[script]
    if script == "tamil":
        text = "".join(_TAMIL.get(c, c) for c in unicodedata.normalize("NFD", text) if c != "़")
    if not shift:
        return text
    return "".join(chr(ord(c) + shift) if 0x900 <= ord(c) <= 0x963 or 0x966 <= ord(c) <= 0x96F else c for c in text)


def _class_of(points: list[int]) -> str:
    """A regular expression's character class, by ranges."""
    out, k = [], 0
    while k < len(points):
        first = k
        while k + 1 < len(points) and points[k + 1] == points[k] + 1:
            k += 1
        out.append(f"\\U{points[first]:08x}-\\U{points[k]:08x}")
        k += 1
    return "[" + "".join(out) + "]"


@cache
def _tables() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[int, str | None]]:
    """Accents behind ASCII, the signs of numbers that go, and what each further character becomes.

    Built from the interpreter's Unicode tables when first needed.
    """
    marks, digits, becomes = [], [], {}
    for p in range(0x110000):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.append(p)
        elif kind[0] == "P" and c not in "-.,":
            becomes[p] = None
        if c.isdigit():
            digits.append(p)
            becomes[p] = str(unicodedata.digit(c))
    d = _class_of(digits)
    loose = rf"[-.,](?:(?<=-)(?:(?!{d})|(?<=[^\W_]-))|(?<=[.,])(?:(?!{d})|(?<!{d}[.,])))"
    # two classes: one of the basic plane alone is a table to the engine, a mixed one a list of ranges
    return re.compile(f"{_class_of([p for p in marks if p < 0x10000])}+"), re.compile(f"{_class_of(marks)}+"), re.compile(loose), becomes


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _accent(m: re.Match) -> str:
    """Marks go behind an ASCII character and stay elsewhere, at the beginning as well."""
    at = m.start()
    return "" if at and m.string[at - 1] < "\x80" else m[0]


def _fold(text: str) -> str:
    """Everything from lower case on, in plain Python for texts beyond ASCII."""
    accents, beyond, loose, becomes = _tables()
    s = unicodedata.normalize("NFKD", text.lower())
    s = (beyond if _BEYOND.search(s) else accents).sub(_accent, s)
    return " ".join(loose.sub("", s).replace(",", ".").translate(becomes).split())


def _fold_udf(script: str):
    """Folds texts behind their mark; ``r`` marks a romanised one, null one that doesn't need Python."""

    def one(t: str) -> str:
        return _fold(romanised_to(t[1:], script) if t[0] == "r" else t[1:])

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_row(one, batches, pa.string())

    return run


def _translit_udf(script: str):
    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_row(lambda t: romanised_to(t, script), batches, pa.string())

    return run


def transliterate(c: Column | str, to_script: str = "devanagari") -> Column:
    if to_script.lower() not in TARGETS:
        raise ValueError(f"unknown script: {to_script}")
    return _translit_udf(to_script)(coerce_text(c))


def _strip_ascii_punctuation(t: Column) -> Column:
    """Without punctuation, but for the signs of numbers; commas that are left stand between digits and become points."""
    odd = r"[!-#%-*,-/:;?@\[-\]_{}](?<![0-9][.,](?=[0-9]))(?<!(?<![A-Za-z0-9])-(?=[0-9]))"
    return F.translate(F.regexp_replace(t, odd, ""), ",", ".")


def normalize(c: Column | str, to_script: str = "devanagari") -> Column:
    t = coerce_text(c)
    blank = is_blank(t)
    hindi = looks_like_hinglish(t) & (script_class(t) == "roman")
    marked = F.when(blank, F.lit(None).cast("string")).when(hindi, F.concat(F.lit("r"), t)).when(t.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("n"), t))
    plain = F.trim(F.regexp_replace(_strip_ascii_punctuation(F.lower(t)), r"[\s\x1c-\x1f]{2,}|[\t-\r\x1c-\x1f]", " "))
    return F.coalesce(_fold_udf(to_script)(marked), F.when(blank, "").otherwise(plain))


def normalize_text(text: str | None, to_script: str = "devanagari") -> str:
    """The same for one text, without Spark; used inside other UDFs and tests."""
    from .match import plain_class, plain_hinglish

    if not isinstance(text, str) or not text.strip():
        return ""
    if plain_class(text) == "roman" and plain_hinglish(text):
        text = romanised_to(text, to_script)
    return _fold(text)


__all__ = ["normalize", "normalize_text", "romanised_to", "substitute_loanwords", "transliterate"]
