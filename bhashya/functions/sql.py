"""SQL functions for tools that call Spark with SQL: the checks by name, without Python.

They are SQL themselves, so Catalyst sees through them; only ``normalize_text`` runs in
Python workers, an Arrow batch at a time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import normalize_text
from .text import HINDI_CUES, SCRIPTS, SIGNAL


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NAMES = "array(" + ", ".join(map(_q, SCRIPTS)) + ")"
_COUNTS = "array(" + ", ".join(f"regexp_count(t, {_q(f'[{chr(92)}u{lo:04x}-{chr(92)}u{hi:04x}]')})" for lo, hi in SCRIPTS.values()) + ")"
_LATIN = "regexp_count(t, '[A-Za-z]')"
_NATIVE = ", ".join(map(_q, SCRIPTS))

#: name -> (parameters, type, body); a later one may call those before it
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "is_blank": ("t STRING", "BOOLEAN", f"NOT coalesce(t, '') RLIKE {_q(r'(?U)[^\s\x1c-\x1f]')}"),
    "has_no_script_signal": ("t STRING", "BOOLEAN", f"NOT coalesce(t, '') RLIKE {_q(SIGNAL)}"),
    "looks_like_hinglish": ("t STRING", "BOOLEAN", f"coalesce(t, '') RLIKE {_q('(?i)(?<![A-Za-z])(' + '|'.join(HINDI_CUES) + ')(?![A-Za-z])')}"),
    "script_class": (
        "t STRING",
        "STRING",
        f"""CASE WHEN is_blank(t) THEN 'empty' WHEN NOT t RLIKE {_q(r'[\u0900-\u0d7f]')} THEN CASE WHEN t RLIKE '[A-Za-z]' THEN 'roman' ELSE 'mixed' END
        WHEN array_max({_COUNTS}) > {_LATIN} THEN element_at({_NAMES}, CAST(array_position({_COUNTS}, array_max({_COUNTS})) AS INT)) WHEN {_LATIN} > 2 * array_max({_COUNTS}) THEN 'roman' ELSE 'mixed' END""",
    ),
    "prompt_bucket": (
        "t STRING",
        "STRING",
        f"CASE WHEN script_class(t) IN ({_NATIVE}) THEN 'native-script' WHEN script_class(t) = 'mixed' THEN 'code-mixed' WHEN script_class(t) = 'empty' THEN 'empty' WHEN looks_like_hinglish(t) THEN 'code-mixed' ELSE 'romanized' END",
    ),
    "script_adherence": (
        "p STRING, r STRING",
        "STRING",
        f"""CASE WHEN is_blank(p) OR is_blank(r) THEN 'empty' WHEN has_no_script_signal(p) OR has_no_script_signal(r) THEN 'no_script_signal'
        WHEN script_class(p) IN ({_NATIVE}) THEN CASE WHEN script_class(r) = script_class(p) THEN 'matched' WHEN script_class(r) = 'mixed' THEN 'mixed' ELSE 'script_mismatch' END
        WHEN script_class(r) = 'roman' THEN 'matched' WHEN script_class(r) = 'mixed' THEN 'mixed' ELSE 'script_mismatch' END""",
    ),
}


def register(spark: SparkSession, prefix: str = "bhashya_") -> list[str]:
    """Makes the functions temporary ones of the session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        for other in FUNCTIONS:
            body = body.replace(f"{other}(", f"{prefix}{other}(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf(T.StringType())
    def normalised(s):
        return s.map(normalize_text)

    spark.udf.register(f"{prefix}normalize_text", normalised)
    return [*(prefix + n for n in FUNCTIONS), f"{prefix}normalize_text"]
