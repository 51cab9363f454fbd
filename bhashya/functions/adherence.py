"""Script adherence: does a reply come in the prompt's writing system?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SCRIPTS, coerce_text, has_no_script_signal, let, looks_like_hinglish, script_class

REASONS = {
    "empty": "There is no prompt or no response to compare.",
    "no_script_signal": "Only digits, punctuation or signs of other scripts: nothing shows the script.",
    "matched": "The response is written as the prompt asks.",
    "mixed": "The response mixes scripts, which the prompt allows.",
    "script_mismatch": "The response is in another script than the prompt.",
    "language_mismatch": "A Hinglish prompt got a response without any Hindi cue.",
}


def result(label: Column, passed: Column, score: Column, reason: Column, detail: Column) -> Column:
    """The struct that every check returns."""
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), label.alias("label"), reason.alias("reason"), detail.alias("detail"))


def reason_of(label: Column, reasons: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reasons.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def _bucket(label: Column, hinglish: Column) -> Column:
    return (
        F.when(label.isin(*SCRIPTS), "native-script").when(label == "mixed", "code-mixed").when(label == "empty", "empty")
        .otherwise(F.when(hinglish, "code-mixed").otherwise("romanized"))
    )


def prompt_bucket(c: Column | str) -> Column:
    t = coerce_text(c)
    return let(script_class(t), lambda label: _bucket(label, looks_like_hinglish(t)))


def script_adherence(prompt: Column | str, response: Column | str, strict_language_check: bool = False) -> Column:
    """Result struct; its detail has both classes and, where it was reached, the bucket."""
    p, r = coerce_text(prompt), coerce_text(response)
    facts = F.struct(
        script_class(p).alias("pl"), script_class(r).alias("rl"), has_no_script_signal(p).alias("pn"), has_no_script_signal(r).alias("rn"),
        looks_like_hinglish(p).alias("ph"), looks_like_hinglish(r).alias("rh"),
    )

    def decided(x: Column) -> Column:
        pl, rl, bucket = x["pl"], x["rl"], _bucket(x["pl"], x["ph"])
        label = F.when((pl == "empty") | (rl == "empty"), "empty").when(x["pn"] | x["rn"], "no_script_signal")
        label = label.when(pl.isin(*SCRIPTS), F.when(rl == pl, "matched").when(rl == "mixed", "mixed").otherwise("script_mismatch"))
        if strict_language_check:
            label = label.when((bucket == "code-mixed") & (rl == "roman") & x["ph"] & ~x["rh"], "language_mismatch")
        label = label.when(rl == "roman", "matched").when(rl == "mixed", "mixed").otherwise("script_mismatch")
        reached = ~((pl == "empty") | (rl == "empty") | x["pn"])
        return F.struct(label.alias("label"), F.struct(pl.alias("prompt_label"), rl.alias("response_label"), F.when(reached, bucket).alias("prompt_bucket")).alias("detail"))

    def full(x: Column) -> Column:
        passed = x["label"].isin("matched", "mixed")
        return result(x["label"], passed, passed.cast("double"), reason_of(x["label"], REASONS), x["detail"])

    return let(let(facts, decided), full)
