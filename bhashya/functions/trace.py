"""Trace check: does a reasoning trace take the wrong reading of an ambiguous term?"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adherence import reason_of, result
from .text import coerce_text, is_blank, let

#: A letter or mark that goes on with a Devanagari word.
CONTINUES = r"[ऀ-ॣॱ-ॿ]"
FLAGGED = "array<struct<term:string,reading_a:string,reading_b:string>>"
REASONS = {
    "empty": "There is no source or no trace to check.",
    "misread_detected": "The trace names only the other reading of an ambiguous term.",
    "no_misread_detected": "No ambiguous term of the source is misread in the trace.",
}


@dataclass(frozen=True, slots=True)
class AmbiguousTerm:
    """``reading_a`` is meant, ``reading_b`` is the misreading."""

    term: str
    reading_a: str
    reading_b: str
    origin: str = ""


@cache
def default_terms() -> tuple[AmbiguousTerm, ...]:
    path = Path(__file__).parent.parent / "sources" / "data" / "ambiguous_terms.csv"
    if not path.exists():
        return ()
    with path.open(encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(line for line in f if not line.startswith("#")))
    terms = (AmbiguousTerm(r["target_word"], r["suggested_reading_a"].strip(), r["suggested_reading_b"].strip(), r["source"]) for r in rows)
    return tuple(t for t in terms if t.reading_a and t.reading_b)


def primary_gloss(reading: str) -> str:
    return reading.split("(", 1)[0].strip()


def term_present(term: str, source: Column) -> Column:
    """As a word of its own: no Devanagari letter or mark on either side."""
    return source.contains(term) & source.rlike(f"(?<!{CONTINUES}){_quoted(term)}(?!{CONTINUES})")


def gloss_present(reading: str, trace_lower: Column) -> Column:
    return trace_lower.rlike(rf"(?U)\b{_quoted(primary_gloss(reading).lower())}\b")


def _quoted(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&~#-])", r"\\\1", s)


def flagged_terms(source: Column, trace: Column, terms: Sequence[AmbiguousTerm]) -> Column:
    """Misread terms in the dictionary's order; literal patterns, no join."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[hit(t, low) for t in terms]))

    hit = lambda t, low: (
        F.when(term_present(t.term, source) & gloss_present(t.reading_b, low) & ~gloss_present(t.reading_a, low), F.struct(F.lit(t.term).alias("term"), F.lit(t.reading_a).alias("reading_a"), F.lit(t.reading_b).alias("reading_b")))
    )
    none = F.array().cast(FLAGGED)
    if not terms:
        return none
    # a source without Devanagari, or a trace without a misreading's gloss, can't be flagged
    return F.when(source.rlike("|".join(_quoted(t.term) for t in terms)), let(F.lower(trace), found)).otherwise(none)


def check_trace(source: Column | str, trace: Column | str, terms: Sequence[AmbiguousTerm] | None = None) -> Column:
    """Result struct; its detail has the dictionary's size and the flagged terms."""
    terms = default_terms() if terms is None else tuple(terms)
    if not all(isinstance(t, AmbiguousTerm) for t in terms):
        raise TypeError("terms must all be AmbiguousTerm")
    s, t = coerce_text(source), coerce_text(trace)
    blank = is_blank(s) | is_blank(t)
    facts = F.struct(blank.alias("blank"), F.when(~blank, flagged_terms(s, t, terms)).alias("flagged"))

    def full(x: Column) -> Column:
        label = F.when(x["blank"], "empty").when(F.size(x["flagged"]) > 0, "misread_detected").otherwise("no_misread_detected")
        passed = label == "no_misread_detected"
        detail = F.struct(F.lit(len(terms)).alias("dictionary_size"), x["flagged"].alias("flagged_terms"))
        return result(label, passed, passed.cast("double"), reason_of(label, REASONS), detail)

    return let(facts, full)


def _literal(c: str) -> str:
    """SQL for a column's text as a literal part of a pattern, whatever signs it holds."""
    return rf"regexp_replace({c}, '([^\\p{{L}}\\p{{N}}\\p{{M}}])', '\\\\$1')"


def check_trace_with(df: DataFrame, source: str, trace: str, terms: DataFrame, key: str) -> DataFrame:
    """For a dictionary that is a table (``term, reading_a, reading_b[, ord]``), of any size.

    Returns ``key, flagged_terms`` for every row of ``df``: an empty array where nothing is
    flagged. ``ord`` gives the dictionary's order (else it is by term and readings).

    A term that is found as a word has its first Devanagari run, wherever that stands, as
    a whole run of the source; by that word the sources and the terms are joined, so that
    neither side is multiplied by the other. Terms without such a run, which are few, are
    joined with every source that holds them.
    """
    run = F.lit(f"({CONTINUES}+)")
    order = "ord" if "ord" in terms.columns else None
    d = terms.select(F.struct(*([order] if order else []), "term", "reading_a", "reading_b").alias("t"), F.regexp_extract("term", f"({CONTINUES}+)", 1).alias("w")).filter("t.term <> ''")
    s = df.select(F.col(key).alias("_k"), coerce_text(source).alias("_s"), F.lower(coerce_text(trace)).alias("_t"))
    usable = s.filter(~is_blank("_s") & ~is_blank("_t"))
    by_word = usable.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("_s", run, F.lit(1))))).join(d.filter("w <> ''"), "w")
    without = usable.join(d.filter("w = ''").drop("w"), F.col("_s").contains(F.col("t.term")))
    near = by_word.select("_k", "_s", "_t", "t").unionByName(without.select("_k", "_s", "_t", "t"))
    bound = CONTINUES.replace("[", "").replace("]", "")
    whole = F.expr(f"_s RLIKE concat('(?<![{bound}])', {_literal('t.term')}, '(?![{bound}])')")
    gloss = lambda c: F.expr(f"_t RLIKE concat('(?U)\\\\b', {_literal(f"lower(trim(substring_index({c}, '(', 1)))")}, '\\\\b')")
    hit = near.filter(whole & gloss("t.reading_b") & ~gloss("t.reading_a"))
    found = hit.groupBy("_k").agg(F.array_sort(F.collect_list("t")).alias("f"))
    flagged = F.transform("f", lambda t: F.struct(t["term"].alias("term"), t["reading_a"].alias("reading_a"), t["reading_b"].alias("reading_b")))
    keys = df.select(F.col(key).alias("_k0"))
    out = keys.join(found, F.col("_k0").eqNullSafe(F.col("_k")), "left")
    return out.select(F.col("_k0").alias(key), F.coalesce(flagged, F.array().cast(FLAGGED)).alias("flagged_terms"))
