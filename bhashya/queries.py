"""The registered queries of the evaluation engine and their DuckDB SQL.

The driver's tables hold no Indic text; ``FIXTURE`` is unioned in on both sides.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import adherence as A
from .functions import judge as J
from .functions import match as M
from .functions import normalize as N
from .functions import similarity as S
from .functions import sql as Q
from .functions import text as X
from .functions import trace as R
from .operators import calibration as C
from .operators import embedding as V
from .operators import evaluate as E
from .operators import judging
from .plans import report as reports
from .sources import datasets as D
from .sources.tables import table
from .streaming import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: id, prompt, response, trace, gold, language
FIXTURE: list[tuple[int, str | None, str | None, str | None, str | None, str | None]] = [
    (1, "दिल्ली में आज मौसम कैसा है?", "आज दिल्ली में धूप है।", None, "आज दिल्ली में धूप है", "hi"),
    (2, "ਮੌਸਮ ਕਿਵੇਂ ਹੈ?", "ਮੌਸਮ ਚੰਗਾ ਹੈ", None, None, None),
    (3, "હવામાન કેવું છે?", "હવામાન સારું છે", None, None, None),
    (4, "ପାଗ କେମିତି ଅଛି?", "ପାଗ ଭଲ ଅଛି", None, None, None),
    (5, "வானிலை எப்படி உள்ளது?", "வானிலை நன்றாக உள்ளது", None, None, None),
    (6, "వాతావరణం ఎలా ఉంది?", "వాతావరణం బాగుంది", None, None, None),
    (7, "ಹವಾಮಾನ ಹೇಗಿದೆ?", "ಹವಾಮಾನ ಚೆನ್ನಾಗಿದೆ", None, None, None),
    (8, "കാലാവസ്ഥ എങ്ങനെയുണ്ട്?", "കാലാവസ്ഥ നല്ലതാണ്", None, None, None),
    (9, "আবহাওয়া কেমন?", "আবহাওয়া ভালো", None, None, None),
    (10, "दिल्ली में मौसम?", "வானிலை நன்றாக உள்ளது", None, None, None),
    (11, "ਮੌਸਮ ਕਿਵੇਂ ਹੈ?", "The weather is fine", None, None, None),
    (12, "Delhi mein mausam kaisa hai?", "Delhi mein dhoop hai", None, "Delhi mein dhoop hai!", "hinglish"),
    (13, "Delhi mein mausam kaisa hai?", "It is sunny in Delhi.", None, "sunny", "hinglish"),
    (14, "Delhi mein mausam kaisa hai?", "दिल्ली में धूप है", None, None, "hinglish"),
    (15, "How is the weather in Delhi?", "It is sunny; दिल्ली में धूप है आज", None, "It is sunny", "en"),
    (16, "मौसम weather क्या है today", "aaj dhoop", None, None, None),
    (17, "दिल्ली में मौसम?", "12345 ।", None, None, None),
    (18, "१२३ ।", "कुछ भी", None, None, None),
    (19, "Where?", "😀 🎉", None, None, None),
    (20, "Где Москва?", "Moscow is in Russia", None, None, None),
    (21, "", "text", None, None, None),
    (22, " \t\n  ", "text", None, None, None),
    (23, None, "text", None, None, None),
    (24, "Se7en is a film", "A film\u001c", None, None, "en"),
    (25, "राजaaaaaa", "राजaaaaaaa", None, None, None),
    (26, "राजaaa", "राजaa", None, None, None),
    (27, "कल की बैठक कब है?", "शाम को", "The user asks about yesterday and the meeting", None, "hi"),
    (28, "कल की बैठक कब है?", "शाम को", "Either tomorrow or yesterday is possible", None, "hi"),
    (29, "कलम कहाँ है?", "मेज पर", "This was yesterday", None, "hi"),
    (30, "समुद्र तल की ऊँचाई?", "शून्य", "The question is about the SEA FLOOR.", None, "hi"),
    (31, "इस वर्ग का नाम?", "पहला", "A square has four sides; the bow is drawn", None, "hi"),
    (32, "The Doctor went to school by mobile", "doctors in OFFICE", None, None, "en"),
    (33, "।।", "॥", None, None, "hi"),
    (34, "résumé naïve Ünïted", "resume naive united", None, None, "en"),
]
_FX = "fx(id, prompt, response, trace, gold, language)"


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


DUCK_FX = f"(SELECT * FROM {values(FIXTURE)} AS {_FX})"


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "id long, prompt string, response string, trace string, gold string, language string")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares; a temporary one for a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bhashya-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text``: all documents and the fixture's prompts (negative ids)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.union(fixture(spark).select(-F.col("id"), "prompt"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, turn, prompt, response``: conversation pairs and the fixture."""
    p = E.conversation_pairs(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("id"), "turn", "prompt", "response")
    return p.union(fixture(spark).select(-F.col("id"), F.lit(0).cast("long"), "prompt", "response"))


DUCK_TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, prompt FROM {DUCK_FX})"
DUCK_PAIRS = f"""(SELECT u.conv_id AS id, u.turn, coalesce(u.text, '') AS prompt, coalesce(a.text, '') AS response FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' UNION ALL SELECT -id, 0, prompt, response FROM {DUCK_FX})"""
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SIGNAL = "A-Za-z" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in [(0x900, 0x963), *((k, k + 0x75) for k in range(0x970, 0xCF1, 0x80)), (0xD70, 0xD7F)])
_CUES = "(^|[^A-Za-z])(" + "|".join(X.HINDI_CUES) + ")($|[^A-Za-z])"


def d_blank(t: str) -> str:
    return f"(NOT regexp_matches(coalesce({t}, ''), '[^{_WS}]'))"


def d_count(t: str, cls: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '[{cls}]'))"


def d_script(t: str, s: str) -> str:
    lo, hi = X.SCRIPTS[s]
    return d_count(t, f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}")


def d_class(t: str) -> str:
    most = "greatest(" + ", ".join(d_script(t, s) for s in X.SCRIPTS) + ")"
    latin = d_count(t, "A-Za-z")
    first = " ".join(f"WHEN {d_script(t, s)} = {most} THEN '{s}'" for s in X.SCRIPTS)
    return f"(CASE WHEN {d_blank(t)} THEN 'empty' WHEN {most} > {latin} THEN CASE {first} END WHEN {latin} > 2 * {most} THEN 'roman' ELSE 'mixed' END)"


def d_hinglish(t: str) -> str:
    return f"regexp_matches(lower(coalesce({t}, '')), '{_CUES}')"


def d_no_signal(t: str) -> str:
    return f"(NOT regexp_matches(coalesce({t}, ''), '[{_SIGNAL}]'))"


def _d_flat(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), '[{_WS}]+', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# -- script classes ---------------------------------------------------------------


@query("script_counts", f"SELECT id, {', '.join(f'{d_script('text', s)} AS {s}_chars' for s in X.SCRIPTS)}, {d_count('text', 'A-Za-z')} AS latin_alpha_chars, length(coalesce(text, '')) - {' - '.join(d_script('text', s) for s in X.SCRIPTS)} - {d_count('text', 'A-Za-z')} AS other_chars FROM {DUCK_TEXTS}")
def script_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.count_scripts("text").alias("c")).select("id", "c.*")


@query("script_class", f"SELECT id, {d_class('text')} AS label FROM {DUCK_TEXTS}")
def script_class(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.script_class("text").alias("label"))


@query("blank_text", f"SELECT id, {d_blank('text')} AS blank FROM {DUCK_TEXTS}")
def blank_text(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.is_blank("text").alias("blank"))


@query("only_danda", f"SELECT id, regexp_matches(coalesce(text, ''), '[।॥]') AND NOT regexp_matches(coalesce(text, ''), '[A-Za-z\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{0D7F}}]') AS only_danda FROM {DUCK_TEXTS}")
def only_danda(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.is_only_danda("text").alias("only_danda"))


@query("no_script_signal", f"SELECT id, {d_no_signal('text')} AS no_signal FROM {DUCK_TEXTS}")
def no_script_signal(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.has_no_script_signal("text").alias("no_signal"))


@query("script_letters", f"SELECT id, {d_count('text', 'ऀ-ॣ॰-ॿ')} AS devanagari_letters, {d_count('text', chr(92) + 'x{0B80}-' + chr(92) + 'x{0BE5}' + chr(92) + 'x{0BF0}-' + chr(92) + 'x{0BFF}')} AS tamil_letters FROM {DUCK_TEXTS}")
def script_letters(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.letters_of("text", "devanagari").cast("long").alias("devanagari_letters"), X.letters_of("text", "tamil").cast("long").alias("tamil_letters"))


_VARIANT = "CASE language WHEN 'hi' THEN ['devanagari'] WHEN 'hinglish' THEN ['roman', 'mixed'] ELSE ['roman'] END"


_DOC_VARIANT = "CASE WHEN lang = 'en' THEN 'en' ELSE 'hinglish' END"
_CHECKED = f"(SELECT id, language, prompt AS text FROM {DUCK_FX} WHERE language IS NOT NULL UNION ALL SELECT doc_id, {_DOC_VARIANT}, text FROM documents)"


@query("script_adherent", f"SELECT id, language, CASE WHEN {d_class('text')} = 'empty' THEN false ELSE list_contains({_VARIANT}, {d_class('text')}) END AS adherent, array_to_string({_VARIANT}, ',') AS expected FROM {_CHECKED}")
def script_adherent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_DOC_VARIANT).alias("language"), "text")
    both = docs.union(fixture(spark).filter("language IS NOT NULL").select("id", "language", "prompt"))
    return both.select("id", "language", X.is_script_adherent("text", "language").alias("adherent"), F.array_join(X.expected_script("language"), ",").alias("expected"))


@query("sql_functions", f"SELECT id, {d_class('text')} AS label, {d_hinglish('text')} AS hinglish, {d_no_signal('text')} AS no_signal FROM {DUCK_TEXTS}")
def sql_functions(spark, sf_dir):
    """The registered SQL functions, called by name."""
    Q.register(spark)
    return texts(spark, sf_dir).selectExpr("id", "bhashya_script_class(text) AS label", "bhashya_looks_like_hinglish(text) AS hinglish", "bhashya_has_no_script_signal(text) AS no_signal")


@query("detect", f"SELECT id, {d_class('text')} AS script, {d_hinglish('text')} AS hinglish, concat_ws(',', {', '.join(f'CASE WHEN {d_script('text', s)} > 0 THEN {chr(39)}{s}:{chr(39)} || {d_script('text', s)} END' for s in X.SCRIPTS)}, CASE WHEN {d_count('text', 'A-Za-z')} > 0 THEN 'latin:' || {d_count('text', 'A-Za-z')} END) AS counts FROM {DUCK_TEXTS}")
def detect(spark, sf_dir):
    d = texts(spark, sf_dir).select("id", X.detection("text").alias("d"))
    counts = F.array_join(F.transform(F.map_entries("d.counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return d.select("id", "d.script", "d.hinglish", counts.alias("counts"))


# -- Hinglish and loanwords --------------------------------------------------------


@query("hindi_words", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w)), lambda w: list_contains([{', '.join(map(_sql, X.HINDI_CUES))}], w)))), ',') AS words FROM {DUCK_TEXTS}")
def hindi_words(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(X.hindi_function_words("text"), ",").alias("words"))


@query("looks_hinglish", f"SELECT id, {d_hinglish('text')} AS hinglish FROM {DUCK_TEXTS}")
def looks_hinglish(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.looks_like_hinglish("text").alias("hinglish"))


_SUB = "coalesce(text, '')"
for _w, _v in X.LOANWORDS.items():
    _SUB = f"regexp_replace({_SUB}, '(^|[^A-Za-z]){_w}($|[^A-Za-z])', '\\1{_v}\\2', 'gi')"


@query("loanword_subst", f"SELECT id, {_SUB} AS text FROM {DUCK_TEXTS}")
def loanword_subst(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.substitute_loanwords("text").alias("text"))


@query("loanword_lookup", f"SELECT w, CASE lower(w) {' '.join(f'WHEN {_sql(k)} THEN {_sql(v)}' for k, v in X.LOANWORDS.items())} END AS loan FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM {DUCK_TEXTS})")
def loanword_lookup(spark, sf_dir):
    w = texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).distinct()
    return w.select("w", X.lookup_loanword("w").alias("loan"))


# -- adherence ------------------------------------------------------------------------

_BUCKET = "(CASE WHEN pl IN (" + ", ".join(map(_sql, X.SCRIPTS)) + ") THEN 'native-script' WHEN pl = 'mixed' THEN 'code-mixed' WHEN pl = 'roman' THEN CASE WHEN ph THEN 'code-mixed' ELSE 'romanized' END ELSE 'empty' END)"


def _adherence_sql(strict: bool) -> str:
    mismatch = "WHEN bucket = 'code-mixed' AND rl = 'roman' AND ph AND NOT rh THEN 'language_mismatch'" if strict else ""
    return f"""WITH a AS (SELECT id, turn, {d_class('prompt')} AS pl, {d_class('response')} AS rl, {d_hinglish('prompt')} AS ph, {d_hinglish('response')} AS rh,
  {d_no_signal('prompt')} AS pn, {d_no_signal('response')} AS rn FROM {DUCK_PAIRS}), b AS (SELECT *, {_BUCKET} AS bucket FROM a),
c AS (SELECT *, CASE WHEN pl = 'empty' OR rl = 'empty' THEN 'empty' WHEN pn OR rn THEN 'no_script_signal'
  WHEN bucket = 'native-script' THEN CASE WHEN rl = pl THEN 'matched' WHEN rl = 'mixed' THEN 'mixed' ELSE 'script_mismatch' END
  {mismatch} WHEN rl = 'roman' THEN 'matched' WHEN rl = 'mixed' THEN 'mixed' ELSE 'script_mismatch' END AS label FROM b)
SELECT id, turn, label, label IN ('matched', 'mixed') AS passed, CASE WHEN label IN ('matched', 'mixed') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, pl AS prompt_label, rl AS response_label,
  CASE WHEN NOT (pl = 'empty' OR rl = 'empty' OR pn) THEN bucket END AS prompt_bucket FROM c"""


def _adherence(spark, sf_dir, strict: bool):
    d = pairs(spark, sf_dir).select("id", "turn", A.script_adherence("prompt", "response", strict).alias("r"))
    return d.select("id", "turn", "r.label", "r.passed", "r.score", "r.detail.*")


@query("script_adherence", _adherence_sql(False))
def script_adherence(spark, sf_dir):
    return _adherence(spark, sf_dir, False)


@query("script_adherence_strict", _adherence_sql(True))
def script_adherence_strict(spark, sf_dir):
    return _adherence(spark, sf_dir, True)


@query("prompt_bucket", f"SELECT id, {_BUCKET} AS bucket FROM (SELECT id, {d_class('text')} AS pl, {d_hinglish('text')} AS ph FROM {DUCK_TEXTS})")
def prompt_bucket(spark, sf_dir):
    return texts(spark, sf_dir).select("id", A.prompt_bucket("text").alias("bucket"))


@query("adherence_by_label", f"SELECT label, count(*) AS n, sum(passed::INT)::BIGINT AS passed FROM ({_adherence_sql(False)}) GROUP BY 1")
def adherence_by_label(spark, sf_dir):
    """The flagship: how conversation pairs fare, by label."""
    return script_adherence(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


# -- normalisation and matching ----------------------------------------------------------


def d_norm(t: str) -> str:
    """For texts of Latin letters, accents included, in a dialect without look-around."""
    t = f"strip_accents(lower({t}))"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\d)[.,](\\d)', '\\1{chr(0xE000)}\\2', 'g')"
    t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}])-(\\d)', '\\1{chr(0xE001)}\\2', 'g')"
    t = f"replace(replace(regexp_replace({t}, '\\p{{P}}', '', 'g'), '{chr(0xE000)}', '.'), '{chr(0xE001)}', '-')"
    return f"trim(regexp_replace({t}, '[{_WS}]+', ' ', 'g'))"


_PLAIN = "NOT (" + d_hinglish("text") + " AND " + d_class("text") + " = 'roman')"


@query("normalize_latin", f"SELECT doc_id, {d_norm('text')} AS norm FROM documents WHERE text IS NOT NULL AND {_PLAIN}")
def normalize_latin(spark, sf_dir):
    """All documents but those that look like romanised Hindi, for which SQL has no ITRANS."""
    t = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~(X.looks_like_hinglish("text") & (X.script_class("text") == "roman")))
    return t.select("doc_id", N.normalize("text").alias("norm"))


@query("normalize_documents")
def normalize_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.sha2(N.normalize("text"), 256).alias("norm_sha256"))


@query("transliterate")
def transliterate(spark, sf_dir):
    """Every document in Devanagari, as if it were romanised; the tests hold examples and plain Python against it."""
    return texts(spark, sf_dir).select("id", F.sha2(N.transliterate("text"), 256).alias("devanagari"))


def doc_pairs(spark, sf_dir):
    """All documents with the one of the next id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


@query("exact_match", f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, {d_norm("coalesce(text, '')")} AS n, NOT {_PLAIN} AS h FROM documents)
SELECT a.doc_id, (CASE WHEN a.h OR b.h THEN a.t = b.t ELSE a.n = b.n END)::INT::DOUBLE AS exact FROM p a JOIN p b ON b.doc_id = a.doc_id + 1""")
def exact_match(spark, sf_dir):
    """Every document is normalised once and meets its neighbours by its hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(N.normalize("text"), 256).alias("n"))
    sides = F.array(F.struct(F.col("doc_id"), F.col("n").alias("a"), F.lit(None).cast("string").alias("b")), F.struct((F.col("doc_id") - 1).alias("doc_id"), F.lit(None).cast("string").alias("a"), F.col("n").alias("b")))
    pairs_ = d.select(F.inline(sides)).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return pairs_.select("doc_id", M.exact_match_of(F.col("a"), F.col("b")).alias("exact"))


@query("token_f1", f"""WITH p AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[{_WS}]+', ' ', 'g')) AS n FROM documents),
q AS (SELECT a.doc_id, a.n AS na, b.n AS nb FROM p a JOIN p b ON b.doc_id = a.doc_id + 1),
ta AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(string_split(na, ' ')) AS w FROM q WHERE na <> '') GROUP BY 1, 2),
tb AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(string_split(nb, ' ')) AS w FROM q WHERE nb <> '') GROUP BY 1, 2),
o AS (SELECT ta.doc_id, sum(least(ta.c, tb.c)) AS ov FROM ta JOIN tb ON ta.doc_id = tb.doc_id AND ta.w = tb.w GROUP BY 1)
SELECT q.doc_id, round(CASE WHEN na = '' AND nb = '' THEN 1.0 WHEN na = '' OR nb = '' THEN 0.0 ELSE 2.0 * coalesce(ov, 0)::DOUBLE / (len(string_split(na, ' ')) + len(string_split(nb, ' '))) END::DOUBLE, 6) AS f1 FROM q LEFT JOIN o ON q.doc_id = o.doc_id""")
def token_f1(spark, sf_dir):
    """Over texts that are in lower case only: normalised ones are a matter of ``normalize_latin``."""
    d = doc_pairs(spark, sf_dir).select("doc_id", F.lower("text").alias("na"), F.lower("other").alias("nb"))
    return d.select("doc_id", F.round(M.token_f1_of(F.col("na"), F.col("nb")), 6).alias("f1"))


@query("char_similarity")
def char_similarity(spark, sf_dir):
    """Prompts and responses; SQL has no Ratcliff and Obershelp, so the tests hold examples against it."""
    return pairs(spark, sf_dir).select("id", "turn", F.round(M.char_similarity("prompt", "response"), 6).alias("ratio"))


@query("align_spans")
def align_spans(spark, sf_dir):
    d = pairs(spark, sf_dir).select("id", "turn", M.align("prompt", "response").alias("x"))
    return d.select("id", "turn", "x.aligned", "x.mismatched_response", "x.mismatched_gold")


@query("align_exact", f"SELECT a.doc_id, {_d_flat('a.text')} = {_d_flat('b.text')} AS aligned FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def align_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(other, "doc_id").select("doc_id", M.words_agree("text", "other").alias("aligned"))


# -- trace check ------------------------------------------------------------------------

_CC = r"[\x{0900}-\x{0963}\x{0971}-\x{097F}]"
_NCC = r"[^\x{0900}-\x{0963}\x{0971}-\x{097F}]"
_TERMS = values([(i, t.term, t.reading_a, t.reading_b, R.primary_gloss(t.reading_a).lower(), R.primary_gloss(t.reading_b).lower()) for i, t in enumerate(R.default_terms())])
_GLOSS = "regexp_matches(lower(trace), concat('(^|[^a-z0-9_])', regexp_escape({0}), '($|[^a-z0-9_])'))"
_TRACE_SQL = f"""WITH s AS (SELECT u.conv_id AS id, u.turn, u.text AS source, a.text AS trace FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' UNION ALL SELECT -id, 0, prompt, trace FROM {DUCK_FX}),
t AS (SELECT * FROM {_TERMS} AS v(k, term, a, b, ga, gb)),
f AS (SELECT id, turn, string_agg(term, ',' ORDER BY k) AS terms, count(*) AS n FROM s JOIN t ON regexp_matches(source, concat('(^|{_NCC})', term, '($|{_NCC})'))
  WHERE {_GLOSS.format('gb')} AND NOT {_GLOSS.format('ga')} GROUP BY 1, 2)
SELECT s.id, s.turn, CASE WHEN {d_blank('source')} OR {d_blank('trace')} THEN 'empty' WHEN n > 0 THEN 'misread_detected' ELSE 'no_misread_detected' END AS label, coalesce(terms, '') AS terms
FROM s LEFT JOIN f ON s.id = f.id AND s.turn = f.turn"""


def _traces(spark, sf_dir):
    p = E.conversation_pairs(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("id"), "turn", F.col("prompt").alias("source"), F.col("response").alias("trace"))
    return p.union(fixture(spark).select(-F.col("id"), F.lit(0).cast("long"), "prompt", "trace"))


@query("trace_check", _TRACE_SQL)
def trace_check(spark, sf_dir):
    d = _traces(spark, sf_dir).select("id", "turn", R.check_trace("source", "trace").alias("r"))
    return d.select("id", "turn", "r.label", F.coalesce(F.array_join(F.transform("r.detail.flagged_terms", lambda t: t["term"]), ","), F.lit("")).alias("terms"))


@query("trace_terms_join", _TRACE_SQL.replace(_TRACE_SQL[_TRACE_SQL.rindex("SELECT s.id, s.turn"):], "SELECT s.id || '-' || s.turn AS case_id, coalesce(terms, '') AS terms FROM s LEFT JOIN f ON s.id = f.id AND s.turn = f.turn"))
def trace_terms_join(spark, sf_dir):
    """The same traces against the dictionary as a table."""
    d = _traces(spark, sf_dir).withColumn("case_id", F.concat_ws("-", "id", "turn"))
    terms = spark.createDataFrame([(k, t.term, t.reading_a, t.reading_b) for k, t in enumerate(R.default_terms())], "ord int, term string, reading_a string, reading_b string")
    out = R.check_trace_with(d, "source", "trace", terms, "case_id")
    return out.select("case_id", F.array_join(F.transform("flagged_terms", lambda t: t["term"]), ",").alias("terms"))


class Constant:
    """A judge that always says the same."""

    model_id = "constant-1b"

    def __init__(self, raw: str):
        self.raw = raw

    def call(self, prompt: str) -> str:
        return self.raw


@query("trace_judge", f"""WITH c AS ({_TRACE_SQL}), t AS (SELECT u.conv_id AS id, u.turn, u.text AS source, a.text AS trace FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' UNION ALL SELECT -id, 0, prompt, trace FROM {DUCK_FX})
SELECT c.id, c.turn, CASE WHEN label <> 'no_misread_detected' THEN label WHEN {_d_flat('t.trace')} = {_d_flat('t.source')} THEN label ELSE 'misread_detected' END AS label,
  CASE WHEN label = 'no_misread_detected' THEN {_d_flat('t.trace')} <> {_d_flat('t.source')} END AS asked FROM c JOIN t ON c.id = t.id AND c.turn = t.turn""")
def trace_judge(spark, sf_dir):
    """Dictionary, then word agreement, then a judge who is never sure."""
    d = judging.check_trace_with_judge(_traces(spark, sf_dir), "source", "trace", Constant('{"misread": false, "confidence": "low"}'))
    return d.select("id", "turn", "trace_check.label", F.col("trace_check.detail.llm_fallback_used").alias("asked"))


# -- judge ---------------------------------------------------------------------------------

#: Answers of six kinds out of a labelled row: (Spark and DuckDB share the expression)
_SCORE, _SURE = "(quality + 4 * toxic + doc_id % 3)", "CASE WHEN doc_id % 2 = 0 THEN 'High' ELSE 'medium' END"
_OBJECT = f"""concat('{{"reasoning": "a {{b}} c", "score": ', CAST({_SCORE} AS STRING), ', "confidence": "', {_SURE}, '"}}')"""
_ANSWER = f"""CASE doc_id % 6 WHEN 0 THEN {_OBJECT} WHEN 1 THEN concat('```json', chr(10), {_OBJECT}, chr(10), '```') WHEN 2 THEN concat('see {{x}} then ', {_OBJECT}, ' and {{"score": 1}}')
  WHEN 3 THEN concat('{{"score": "', CAST({_SCORE} AS STRING), '"}}') WHEN 4 THEN 'no answer at all' ELSE concat('{{"score": ', CAST({_SCORE} AS STRING), '.5}}') END"""


@query("judge_parse", f"""WITH r AS (SELECT doc_id, {_ANSWER.replace('AS STRING', 'AS VARCHAR')} AS raw FROM labels),
o AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(raw, '\\{{(?:[^"{{}}]|"[^"]*")*\\}}'), lambda x: CASE WHEN json_valid(x) THEN x END), lambda x: x IS NOT NULL)[1] AS j FROM r),
v AS (SELECT doc_id, CASE WHEN json_type(j, '$.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN round_even(json_extract_string(j, '$.score')::DOUBLE, 0) END AS level, lower(coalesce(json_extract_string(j, '$.confidence'), 'low')) AS sent FROM o)
SELECT doc_id, CASE WHEN level BETWEEN 1 AND 5 THEN (level - 1) / 4 END::DOUBLE AS score, CASE WHEN level BETWEEN 1 AND 5 THEN CASE WHEN sent IN ('high', 'low') THEN sent ELSE 'low' END END AS confidence,
  coalesce(level BETWEEN 1 AND 5 AND (level - 1) / 4 >= 0.8 AND sent = 'high', false) AS passed FROM v""")
def judge_parse(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", F.expr(_ANSWER).alias("raw")).select("doc_id", J.parse_judge("raw").alias("v"))
    return d.select("doc_id", "v.score", "v.confidence", F.coalesce(J.judge_passes("v.score", "v.confidence"), F.lit(False)).alias("passed"))


_MODEL = "concat('maker/', {0}, '-', CAST({1} AS {2}), CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'x' END)"
_STRIP = "regexp_replace({0}, '-[0-9]+[bm]*$', '')"


@query("judge_family", f"""SELECT doc_id, {_STRIP.format('a')} AS family, coalesce(trim(b) <> '' AND {_STRIP.format('a')} = {_STRIP.format('b')}, false) AS same
  FROM (SELECT doc_id, {_MODEL.format('lang', 'n_chars', 'VARCHAR')} AS a, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN ' ' ELSE {_MODEL.format("CASE WHEN source IS NULL THEN 'x' ELSE lang END", '7', 'VARCHAR')} END AS b FROM documents)""")
def judge_family(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MODEL.format("lang", "n_chars", "STRING")).alias("a"), F.expr(f"CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN ' ' ELSE {_MODEL.format("CASE WHEN source IS NULL THEN 'x' ELSE lang END", '7', 'STRING')} END").alias("b"))
    return d.select("doc_id", J.family("a").alias("family"), J.same_family_warning("a", "b").isNotNull().alias("same"))


def _judged(spark, sf_dir):
    """Conversation pairs; every fourth turn has its response as the reference."""
    return pairs(spark, sf_dir).withColumn("gold", F.when(F.col("turn") % 4 == 0, F.col("response")).otherwise(F.lit("")))


_FREE = " || ".join("coalesce(prompt, '')" if p == "§q" else "coalesce(response, '')" if p == "§a" else _sql(p) for p in J.template_parts("reference_free"))
_LEVEL = "(1 + length({0}) % 5)"
_JUDGE_SQL = f"""SELECT id, turn, CASE WHEN blank THEN 'empty' WHEN same THEN 'matched' WHEN level = 5 THEN 'matched' ELSE 'flagged' END AS label, CASE WHEN blank THEN 0 WHEN same THEN 1 ELSE (level - 1) / 4 END::DOUBLE AS score,
  NOT blank AND (same OR level = 5) AS passed, CASE WHEN NOT blank THEN CASE WHEN gold THEN 'reference_based' ELSE 'reference_free' END END AS mode
FROM (SELECT id, turn, {d_blank('prompt')} OR {d_blank('response')} AS blank, turn % 4 = 0 AND NOT {d_blank('response')} AS gold, turn % 4 = 0 AND NOT {d_blank('response')} AS same, {_LEVEL.format('(' + _FREE + ')')} AS level FROM {DUCK_PAIRS})"""


class ByLength:
    """A judge whose score depends on the length of what it is asked."""

    model_id = "length-1b"

    def call(self, prompt: str) -> str:
        return '{"score": %d, "confidence": "high", "reasoning": "by length"}' % (1 + len(prompt) % 5)


def _verdicts(d: DataFrame) -> DataFrame:
    return d.select("id", "turn", "judge.label", "judge.score", "judge.passed", "judge.detail.mode")


@query("judge_calls", _JUDGE_SQL)
def judge_calls(spark, sf_dir):
    """The whole judge path with calls; only rows that need one reach the judge."""
    return _verdicts(judging.judge_answers(_judged(spark, sf_dir), "prompt", "response", "gold", ByLength(), answering_model_id=F.lit("length-7b")))


@query("judge_replay", _JUDGE_SQL)
def judge_replay(spark, sf_dir):
    """The same with answers that are looked up by their prompts."""
    asked = _judged(spark, sf_dir).select(J.build_prompt("reference_free", "prompt", "response").alias("p")).distinct()
    answers = asked.select(F.sha2("p", 256).alias("prompt_sha256"), F.concat(F.lit('{"score": '), F.expr(_LEVEL.format("p")).cast("string"), F.lit(', "confidence": "high"}')).alias("raw"))
    return _verdicts(judging.judge_answers(_judged(spark, sf_dir), "prompt", "response", "gold", judging.ReplayJudge(answers)))


@query("judge_prompts", f"SELECT id, turn, sha256({_FREE}) AS free FROM {DUCK_PAIRS}")
def judge_prompts(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", "turn", F.sha2(J.build_prompt("reference_free", "prompt", "response"), 256).alias("free"))


_GRADED = "(SELECT *, (doc_id % 2)::INT AS v FROM labels)"


@query("judge_agreement", f"SELECT count(*) AS n, coalesce(avg((v = quality)::INT::DOUBLE), 0) AS agreement_grader1, coalesce(avg((v = toxic)::INT::DOUBLE), 0) AS agreement_grader2 FROM {_GRADED}")
def judge_agreement(spark, sf_dir):
    return E.judge_agreement(table(spark, sf_dir, "labels").withColumn("v", (F.col("doc_id") % 2).cast("int")), "v", "quality", "toxic")


@query("judge_disagreements", f"SELECT doc_id AS ord, doc_id::VARCHAR AS id FROM {_GRADED} WHERE v IS DISTINCT FROM quality OR v IS DISTINCT FROM toxic")
def judge_disagreements(spark, sf_dir):
    return E.judge_disagreements(table(spark, sf_dir, "labels").withColumn("v", (F.col("doc_id") % 2).cast("int")), "v", "quality", "toxic", "doc_id", "doc_id")


# -- similarity and calibration -----------------------------------------------------------------


def vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"), F.col("embedding").alias("embedding2")), "vec_id")


_VEC = "SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("cosine", f"SELECT vec_id, round(c, 6) AS cosine FROM ({_VEC})")
def cosine(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(S.cosine_similarity("embedding", "embedding2"), 6).alias("cosine"))


_CAL = values([(e, lang, c.threshold, c.roc_auc) for (e, lang), c in C.TABLE.items()])


def _similar(encoder: str, min_auc: float) -> str:
    cell = f"LEFT JOIN (SELECT * FROM {_CAL} AS v(encoder, language, threshold, roc_auc) WHERE encoder = '{encoder}') k ON k.language = l"
    return f"""SELECT vec_id, l AS language, round(greatest(0, least(1, c)), 6) AS score, coalesce(threshold, 0.5)::DOUBLE AS threshold,
  CASE WHEN roc_auc < {min_auc} THEN 'low_discrimination' WHEN threshold IS NULL THEN CASE WHEN greatest(0, least(1, c)) >= 0.5 THEN 'similar_uncalibrated' ELSE 'dissimilar_uncalibrated' END
  WHEN greatest(0, least(1, c)) >= threshold THEN 'similar' ELSE 'dissimilar' END AS label FROM (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE 'hinglish' END AS l FROM ({_VEC})) {cell}"""


def _similarity(spark, sf_dir, encoder: str, min_auc: float = 0.7):
    lang = F.when(F.col("vec_id") % 3 == 0, "en").when(F.col("vec_id") % 3 == 1, "hi").otherwise("hinglish")
    d = vector_pairs(spark, sf_dir).withColumn("g", F.lit("gold")).withColumn("r", F.lit("reply"))
    d = S.calibrated_similarity(d, "g", "r", "embedding", "embedding2", lang, encoder=encoder, min_auc=min_auc, allow_muril=True)
    x = F.col("similarity")
    return d.select("vec_id", x["detail"]["language"].alias("language"), F.round(x["score"], 6).alias("score"), x["detail"]["threshold"].alias("threshold"), x["label"].alias("label"))


@query("calibrated_similarity", _similar(C.DEFAULT_ENCODER, 0.7))
def calibrated_similarity(spark, sf_dir):
    return _similarity(spark, sf_dir, C.DEFAULT_ENCODER)


@query("low_discrimination", _similar(C.MURIL, 0.7))
def low_discrimination(spark, sf_dir):
    return _similarity(spark, sf_dir, C.MURIL)


@query("uncalibrated_similarity", _similar("another/encoder", 0.7))
def uncalibrated_similarity(spark, sf_dir):
    return _similarity(spark, sf_dir, "another/encoder")


def _cal_sql(by: str = "") -> str:
    k, p, g = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""WITH e AS ({_VEC}), s AS (SELECT vec_id % 3 AS lang3, round(c, 6) AS s, same FROM e),
v AS (SELECT {k}s, sum(same::INT) AS y, sum((NOT same)::INT) AS n FROM s GROUP BY {k}s),
w AS (SELECT *, coalesce(sum(y) OVER ({p}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_y, coalesce(sum(n) OVER ({p}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_n,
  sum(y) OVER ({p or ''}) AS ty, sum(n) OVER ({p or ''}) AS tn FROM v),
r AS (SELECT *, ty - b_y + b_n AS hits FROM w), m AS (SELECT {k}max(hits) AS best, max(ty) AS ty, max(tn) AS tn, sum(y * (b_n + n / 2.0)) AS auc FROM r {g}),
d AS (SELECT {k}avg((((s >= 0.5) = same))::INT::DOUBLE) AS at_default, max((abs(s) > 1)::INT) AS outside FROM s {g})
SELECT {f'm.{by}, ' if by else ''}(SELECT min(s) FROM r WHERE hits = m.best {f'AND r.{by} = m.{by}' if by else ''}) AS threshold, (best / (ty + tn))::DOUBLE AS accuracy_at_threshold, at_default AS accuracy_at_default, least(ty, tn)::BIGINT AS n_cases,
  concat_ws(';', CASE WHEN least(ty, tn) < 5 THEN 'fewer than 5 cases on a side' END, CASE WHEN outside = 1 THEN 'a score lies outside [-1, 1]' END, CASE WHEN best / (ty + tn) <= 0.5 THEN '{C.AT_CHANCE}' END) AS warnings,
  round((auc / (ty * tn))::DOUBLE, 9) AS roc_auc FROM m JOIN d ON {f'm.{by} = d.{by}' if by else 'true'}"""


def _scored(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select((F.col("vec_id") % 3).alias("lang3"), F.round(S.cosine_similarity("embedding", "embedding2"), 6).alias("score"), (F.col("label") == F.col("label2")).alias("is_correct"))


@query("calibrate", _cal_sql())
def calibrate(spark, sf_dir):
    return C.calibrate(_scored(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ";")).withColumn("roc_auc", F.round("roc_auc", 9))


@query("calibrate_by_group", _cal_sql("lang3"))
def calibrate_by_group(spark, sf_dir):
    return C.calibrate(_scored(spark, sf_dir), by=["lang3"]).withColumn("warnings", F.array_join("warnings", ";")).withColumn("roc_auc", F.round("roc_auc", 9))


@query("benchmark_buckets", "SELECT lang AS language, sum((quality = 1)::INT)::BIGINT AS correct, sum((quality <> 1)::INT)::BIGINT AS wrong FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def benchmark_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.length("text").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("label", F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "wrong_hard").otherwise("wrong_subtle"))
    return E.scored_for_calibration(d, F.col("size") / 1e6).groupBy("language").agg(F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("wrong"))


@query("mean_pool", """WITH t AS (SELECT a.vec_id, [a.embedding::DOUBLE[], b.embedding::DOUBLE[]] AS v, [1, (a.vec_id % 2)::INT] AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_transform(range(1, 65), lambda d: v[1][d] * m[1] + v[2][d] * m[2]) AS x FROM t)
SELECT vec_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda y: y * y))), 6) AS first, round(x[64] / sqrt(list_sum(list_transform(x, lambda y: y * y))), 6) AS last FROM s""")
def mean_pool(spark, sf_dir):
    """Two token vectors, of which every other row masks the second."""
    d = vector_pairs(spark, sf_dir).select("vec_id", S.mean_pool(F.array("embedding", "embedding2"), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"))).alias("p"))
    return d.select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[63], 6).alias("last"))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An encoder without a model."""
    return [[float(t.lower().count(c)) for c in "aeinrst "] for t in texts]


_COUNTED = "list_transform(['a', 'e', 'i', 'n', 'r', 's', 't', ' '], lambda c: (length({0}) - length(replace(lower({0}), c, '')))::DOUBLE)"


@query("encoded_pairs", f"SELECT id, turn, round(list_dot_product(p, r) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(r, r)) + 1e-12), 6) AS cosine FROM (SELECT id, turn, {_COUNTED.format('prompt')} AS p, {_COUNTED.format('response')} AS r FROM {DUCK_PAIRS} WHERE coalesce(prompt, '') <> '' AND id > 0)")
def encoded_pairs(spark, sf_dir):
    """Every different text is encoded once in the workers, stored, and joined back."""
    d = pairs(spark, sf_dir).filter("id > 0 AND prompt <> ''").select("id", "turn", F.col("prompt").alias("gold"), "response")
    d = V.with_vectors(d, "letters", store=scratch(spark, "vectors"), encode=letter_counts)
    return d.select("id", "turn", F.round(S.cosine_similarity("gold_vector", "response_vector"), 6).alias("cosine"))


@query("embedding_cache_misses", "SELECT sha256('passage' || chr(0) || text) AS key FROM (SELECT DISTINCT text FROM documents) WHERE sha256('passage' || chr(0) || text) NOT IN (SELECT sha256('passage' || chr(0) || text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def embedding_cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(S.cache_key("text", False).alias("key"))
    return D.embedding_misses(docs, store).select("key")


@query("cache_stats", "WITH s AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT count(s.text) AS hits, count(*) - count(s.text) AS misses, count(s.text) / count(*)::DOUBLE AS hit_rate FROM documents d LEFT JOIN s ON d.text = s.text")
def cache_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(S.cache_key("text", False).alias("key"))
    return D.cache_stats(docs, store)


# -- evaluation ------------------------------------------------------------------------------


@query("load_alias", f"SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) AS ord, u.conv_id || '-' || u.turn AS id, coalesce(CASE WHEN NOT {d_blank('u.text')} THEN u.text END, '') AS prompt, coalesce(CASE WHEN NOT {d_blank('a.text')} THEN a.text END, '') AS response, '' AS gold, '' AS trace, '' AS language FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def load_alias(spark, sf_dir):
    p = E.conversation_pairs(table(spark, sf_dir, "conversations"))
    p = p.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias(" Case_ID "), F.col("prompt").alias("Question"), F.col("response").alias("completion"), F.lit(" ").alias("gold"), F.lit(5).alias("trace"))
    return D.cases_from_columns(p, ["conv_id", "turn"])


_LOADED = f"SELECT u.conv_id || '-' || u.turn AS id, coalesce(CASE WHEN NOT {d_blank('u.text')} THEN u.text END, '') AS prompt, coalesce(CASE WHEN NOT {d_blank('a.text')} THEN a.text END, '') AS response, '' AS gold, '' AS trace, 'en' AS language FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def _to_load(spark, sf_dir):
    p = E.conversation_pairs(table(spark, sf_dir, "conversations"))
    return p.select(F.concat_ws("-", "conv_id", "turn").alias("Case_ID"), F.col("prompt").alias("question"), F.lit(" ").alias("prompt"), F.col("response").alias("OUTPUT"), F.lit("en").alias("lang"), F.lit(5).alias("gold"))


@query("load_jsonl", _LOADED)
def load_jsonl(spark, sf_dir):
    """Cases by way of JSON lines, some with a token that is no JSON."""
    path = scratch(spark, "cases.jsonl")
    line = F.to_json(F.struct("*"))
    _to_load(spark, sf_dir).select(F.regexp_replace(line, '"gold":5', '"gold":NaN')).write.text(path)
    return D.load_cases(spark, path).drop("ord")


@query("load_csv", _LOADED)
def load_csv(spark, sf_dir):
    path = scratch(spark, "cases") + ".csv"
    _to_load(spark, sf_dir).withColumn("gold", F.lit(" ")).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return D.load_cases(spark, path).drop("ord")


def _write_lists(d: DataFrame, key: str, path: str, wrap: Callable, size: int = 50) -> None:
    """JSON documents, each with a list of about ``size`` rows, one to a file."""
    parts = d.count() // size + 1
    lists = d.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct(*d.columns)).alias("rows"))
    lists.select(F.to_json(wrap(F.col("rows")))).write.option("maxRecordsPerFile", 1).text(path)


@query("load_json", _LOADED)
def load_json(spark, sf_dir):
    """By way of JSON documents with lists of cases."""
    path = scratch(spark, "cases") + ".json"
    _write_lists(_to_load(spark, sf_dir), "Case_ID", path, lambda rows: F.struct(rows.alias("cases")))
    return D.load_cases(spark, path).drop("ord")


@query("judge_benchmark", "SELECT lang AS ground_truth_answer_type, count(*) AS n, sum((d.doc_id % 3 = 0)::INT)::BIGINT AS holdout, sum((quality = toxic)::INT)::BIGINT AS agree FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def judge_benchmark(spark, sf_dir):
    """Labelled documents by way of the judge benchmark's JSON lists."""
    path = scratch(spark, "traces") + ".json"
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select(
        F.col("doc_id").cast("string").alias("trace_id"), F.lit("q").alias("question"), F.col("source").alias("answer"), F.col("lang").alias("ground_truth_answer_type"),
        F.col("quality").cast("string").alias("human_verdict_grader1"), F.col("toxic").cast("string").alias("human_verdict_grader2_independent"), (F.col("doc_id") % 3 == 0).alias("is_holdout"),
    )
    _write_lists(d, "trace_id", path, lambda rows: rows)
    got = D.load_judge_benchmark(spark, path).groupBy("ground_truth_answer_type")
    return got.agg(F.count("*").alias("n"), F.count_if("is_holdout").alias("holdout"), F.count_if(F.col("human_verdict_grader1") == F.col("human_verdict_grader2_independent")).alias("agree"))


@query("similarity_benchmark", "SELECT lang AS language, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'wrong_hard' ELSE 'wrong_subtle' END AS label, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(text, '') <> '' GROUP BY 1, 2")
def similarity_benchmark(spark, sf_dir):
    """Labelled documents by way of the benchmark's CSV."""
    path = scratch(spark, "benchmark.csv")
    d = table(spark, sf_dir, "documents").filter("coalesce(text, '') <> ''").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "wrong_hard").otherwise("wrong_subtle")
    d = d.select(F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("task_id"), F.col("lang").alias("language"), label.alias("label"), F.col("text").alias("gold_text"), F.col("text").alias("answer"))
    d.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return D.load_similarity_benchmark(spark, path).groupBy("language", "label").agg(F.count("*").alias("n"), F.sum(F.length("gold_text")).alias("size"))


def _cases(spark, sf_dir):
    p = pairs(spark, sf_dir).select(F.col("id").alias("ord"), "turn", F.concat_ws("-", "id", "turn").alias("id"), "prompt", "response", F.lit("").alias("gold"), F.lit("").alias("language"))
    traces = fixture(spark).select((-F.col("id")).alias("ord"), F.coalesce("trace", F.lit("")).alias("trace"))
    return p.join(F.broadcast(traces), "ord", "left").withColumn("trace", F.coalesce("trace", F.lit("")))


def _long(spark, sf_dir):
    return E.long_results(E.evaluate(_cases(spark, sf_dir), ["script", "trace"]), ["script", "trace"], keep=("ord", "turn", "id", "prompt", "response"))


_T = f"(SELECT t.* FROM ({_TRACE_SQL}) t JOIN {DUCK_FX} x ON t.id = -x.id WHERE coalesce(x.trace, '') <> '')"
_LONG = f"""(SELECT 'script' AS metric, 0 AS metric_ord, id, turn, label, passed, score FROM ({_adherence_sql(False)})
  UNION ALL SELECT 'trace', 1, id, turn, label, label = 'no_misread_detected', (label = 'no_misread_detected')::INT::DOUBLE FROM {_T})"""
_CASES = f"(SELECT count(*) FROM {DUCK_PAIRS})"
_SUMMARY = f"""SELECT metric, metric_ord, count(*) AS total, sum(passed::INT)::BIGINT AS passed, {_CASES} - count(*) AS skipped, sum(passed::INT) / count(*)::DOUBLE AS pass_rate, round(avg(score), 9) AS mean_score FROM {_LONG} GROUP BY 1, 2"""


@query("metric_summary", _SUMMARY)
def metric_summary(spark, sf_dir):
    return E.summarize(_long(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 9))


@query("failures", f"SELECT metric, id, turn, label FROM {_LONG} WHERE NOT passed")
def failures(spark, sf_dir):
    return E.failures(_long(spark, sf_dir)).select("metric", F.col("ord").alias("id"), "turn", "label")


@query("gate", f"SELECT metric, pass_rate FROM ({_SUMMARY}) WHERE total > 0 AND pass_rate < 0.95")
def gate(spark, sf_dir):
    return E.gate(E.summarize(_long(spark, sf_dir)), 0.95).select("metric", "pass_rate")


@query("label_dist", f"SELECT metric, label, count(*) AS count FROM {_LONG} GROUP BY 1, 2")
def label_dist(spark, sf_dir):
    return E.label_distribution(_long(spark, sf_dir))


_ICON, _TITLE = "CASE WHEN passed = total THEN '✅' ELSE '❌' END", "CASE metric WHEN 'script' THEN 'Script adherence' ELSE 'Trace check' END"


@query("report_markdown", f"""SELECT printf('| %s %s | %.1f%% | %d/%d | %d | %.3f |', {_ICON}, {_TITLE}, pass_rate * 100, passed::BIGINT, total::BIGINT, skipped::BIGINT, mean_score) AS line FROM ({_SUMMARY})
UNION ALL SELECT '| ' || {_TITLE} || ' | ' || id || '-' || turn || ' | ' || label || ' |' FROM {_LONG} WHERE NOT passed""")
def report_markdown(spark, sf_dir):
    """The rows of the Markdown report, without the wording of the reasons."""
    long = _long(spark, sf_dir).cache()
    out = io.StringIO()
    reports.markdown_report(E.summarize(long).orderBy("metric_ord").collect(), reports.each_failure(long), out)
    long.unpersist()
    rows = [x for x in out.getvalue().splitlines() if x.startswith("| ") and not x.startswith("| Metric")]
    return spark.createDataFrame([(x if x[2] in "✅❌" else x[: x.rindex(" | ") + 2],) for x in rows], "line string")


@query("report_json", f"SELECT {_TITLE} AS title, id || '-' || turn AS id, label, passed, score FROM {_LONG}")
def report_json(spark, sf_dir):
    """The cases of the JSON report, read back."""
    long = _long(spark, sf_dir).cache()
    out = io.StringIO()
    reports.json_report(long, E.summarize(long).orderBy("metric_ord").collect(), out)
    long.unpersist()
    metrics = json.loads(out.getvalue())["metrics"]
    return spark.createDataFrame([(title, c["id"], c["label"], c["passed"], c["score"]) for title, m in metrics.items() for c in m["cases"]], "title string, id string, label string, passed boolean, score double")


@query("windowed_pass_rate", f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTES, TIMESTAMP '1970-01-01' + turn * INTERVAL 1 MINUTE), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS total, sum(passed::INT)::BIGINT AS passed
  FROM {_LONG} WHERE metric = 'script' GROUP BY 1""")
def windowed_pass_rate(spark, sf_dir):
    """The running summary, over a batch: a time for every turn."""
    cases = _cases(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("turn") * 60))
    out = checks.windowed_pass_rate(checks.stream_results(cases, keep=("ord", "id", "at")), "at")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "total", "passed")


@query("similarity_skips", f"""SELECT count(*) FILTER (WHERE counts) AS total, count(*) FILTER (WHERE NOT counts) AS skipped FROM (SELECT turn % 3 <> 0 AND coalesce(response, '') <> '' AND turn % 2 = 0 AS counts FROM {DUCK_PAIRS} WHERE id > 0)""")
def similarity_skips(spark, sf_dir):
    """Cases without a gold text or without a language are skipped, not scored."""
    d = pairs(spark, sf_dir).filter("id > 0").select(F.col("id").alias("ord"), F.concat_ws("-", "id", "turn").alias("id"), "prompt", "response", F.when(F.col("turn") % 3 != 0, F.col("response")).otherwise("").alias("gold"), F.lit("").alias("trace"), F.when(F.col("turn") % 2 == 0, "en").otherwise("").alias("language"))
    d = V.with_vectors(d, "letters", store=scratch(spark, "vectors"), encode=letter_counts)
    return E.summarize(E.long_results(E.evaluate(d, ["similarity"], encoder="letters"), ["similarity"])).select("total", "skipped")
