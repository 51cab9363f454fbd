"""Personal data by format-preserving Feistel pseudonyms; DataFrame functions only.

One regular expression finds candidates; each is then validated: card numbers by
length and Luhn's sum, account numbers (IBAN) by country, length and remainder of 97,
IPv4 addresses by their octets, dates by the calendar, telephone and social-security
numbers by their form. A validated value's digits are split in two halves and permuted
by ``ROUNDS`` rounds of a keyed Feistel network within the same format: a card stays a
valid card and an account a valid account (their check digits are made anew), a date a
date, an address an address. The permutation depends on the key, the kind and the value
only, so equal values stay linked across documents and different values stay different.
Country codes, letters and separators are kept. A telephone number is permuted in its
last ten digits (all but one of a shorter one), so it stays linked with and without a
country code.

Mail and IPv6 addresses and secrets (passwords behind ``password=``, access keys, runs of
32 or more letters and digits with both) have no digits to permute; they become a keyed
hash, linked alike. Numbers of versions and of revisions that are called so are left.

The key is a parameter without a default. It enters the plan as the value of a one-row
table, which plans and event logs don't print.

Dates lie between 1900-01-01 and 73,169 days later; others are left. ``dd/mm/yyyy`` is
tried before ``mm/dd/yyyy``. Null texts stay null with 0 found; an empty text stays empty.
Whole texts are treated, and rows that repeat give repeated results; an empty table gives
no rows; further columns, of whatever name, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Every candidate has one of these.
SOME = "[0-9@=]"
#: Length of an account number by country, of some countries; fixed values of the registry.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def _iban(country: str, n: int) -> str:
    rest = (n - 4) % 4
    return f"{country}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (f" ?[0-9A-Z]{{{rest}}}" if rest else "")


#: Left as they are: what is called a version or a revision.
_CALLED = r"(?:commit|revision|parent|tree|sha|sha1) [0-9a-f]{7,64}|(?:[Vv]ersion|[Rr]elease) v?[0-9]+(?:\.[0-9]+)+|\bv[0-9]+(?:\.[0-9]+)+"
_PHONES = (
    r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]",
    r"\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]",
    r"\([0-9]{3}\) ?[0-9]{3}-[0-9]",
    r"[0-9]{3}-[0-9]{3}-[0-9]",
    r"[0-9]{3}\.[0-9]{3}\.[0-9]",
)
_ABROAD = r"\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}"
CANDIDATE = "|".join(
    [
        _CALLED,
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"(?:password|passwd|pwd)=[0-9A-Za-z]{6,}",
        *(_iban(c, n) for c, n in IBAN.items()),
        r"[0-9A-Za-z]{32,}",
        r"AKIA[0-9A-Z]{16}",
        r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
        r"\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b",
        r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]+",
        r"[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}",
        r"[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}",
        *(p + "+" for p in _PHONES),
        _ABROAD,
        r"\+[0-9]{8,15}",
        r"[0-9]{3}-[0-9]{2}-[0-9]+",
        r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]+",
        r"3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]+",
        r"[A-Za-z._%+-]{65,}",  # a long run is looked at once
        r"[0-9]+",
    ]
)


class _Spark:
    escape = 2  # a backslash in a string literal
    regex = staticmethod(lambda x, p: f"regexp_like({x}, '{p}')")
    number = staticmethod(lambda x: f"coalesce(try_cast({x} AS BIGINT), 0L)")
    text = staticmethod(lambda x: f"CAST({x} AS STRING)")
    digits = staticmethod(lambda x: f"regexp_replace({x}, '[^0-9]', '')")
    each = staticmethod(lambda xs, v, e: f"transform({xs}, {v} -> {e})")
    upto = staticmethod(lambda n: f"sequence(1, {n})")
    sum = staticmethod(lambda xs: f"aggregate({xs}, 0, (s, y) -> s + y)")
    join = staticmethod(lambda xs: f"array_join({xs}, '')")
    hash = staticmethod(lambda x: f"sha2({x}, 256)")
    hex = staticmethod(lambda x: f"CAST(conv({x}, 16, 10) AS BIGINT)")
    days = staticmethod(lambda d: f"datediff({d}, DATE'1900-01-01')")
    day = staticmethod(lambda n: f"CAST(date_add(DATE'1900-01-01', CAST({n} AS INT)) AS STRING)")
    part = staticmethod(lambda x, i: f"split_part({x}, '.', {i})")
    div = staticmethod(lambda a, b: f"({a}) DIV ({b})")
    fold = staticmethod(lambda xs, e: f"aggregate({xs}, 0, (a, c) -> {e})")

    @staticmethod
    def struct(fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


class Duck(_Spark):
    """The same expressions for DuckDB."""

    escape = 1
    regex = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    number = staticmethod(lambda x: f"coalesce(try_cast({x} AS BIGINT), 0::BIGINT)")
    text = staticmethod(lambda x: f"CAST({x} AS VARCHAR)")
    digits = staticmethod(lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')")
    each = staticmethod(lambda xs, v, e: f"list_transform({xs}, lambda {v}: {e})")
    upto = staticmethod(lambda n: f"range(1, CAST({n} AS BIGINT) + 1)")
    sum = staticmethod(lambda xs: f"coalesce(list_sum({xs}), 0)")
    join = staticmethod(lambda xs: f"array_to_string({xs}, '')")
    hash = staticmethod(lambda x: f"sha256({x})")
    hex = staticmethod(lambda x: f"CAST(concat('0x', {x}) AS BIGINT)")
    days = staticmethod(lambda d: f"date_diff('day', DATE '1900-01-01', {d})")
    day = staticmethod(lambda n: f"CAST(CAST(DATE '1900-01-01' + CAST({n} AS INTEGER) AS DATE) AS VARCHAR)")
    div = staticmethod(lambda a, b: f"({a}) // ({b})")
    fold = staticmethod(lambda xs, e: f"list_reduce(list_prepend(0, {xs}), lambda a, c: {e})")

    @staticmethod
    def struct(fields: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def _luhn(q, d: str, n: str, skip: int) -> str:
    """Luhn's sum of the first ``n`` digits; ``skip`` 1 if the check digit is yet to come."""
    x = f"CAST(substr({d}, CAST({n} - i + 1 AS INT), 1) AS INT)"
    v = f"CASE WHEN (i + {skip}) % 2 = 0 THEN 2 * {x} - CASE WHEN {x} > 4 THEN 9 ELSE 0 END ELSE {x} END"
    return q.sum(q.each(q.upto(n), "i", v))


def _mod97(q, z: str) -> str:
    """The remainder of an account number without blanks, its first four signs behind the rest, letters as 10 to 35."""
    signs = q.each(q.upto(f"length({z})"), "i", f"ascii(substr({z}, CAST(i AS INT), 1))")
    return q.fold(signs, "CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END")


def pseudonyms(found: str, key: str, q=_Spark) -> str:
    """SQL over an array of candidate strings: an array of structs ``k`` (kind, null
    if nothing was validated) and ``o`` (what takes the candidate's place).

    ``key`` is SQL as well: a column, or a literal.
    """
    year_first, day_first = q.regex("x.m", "^[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}$"), q.regex("x.m", "^[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}$")
    of_year = lambda a, b: f"concat(substr(x.m, 7, 4), '-', substr(x.m, {a}, 2), '-', substr(x.m, {b}, 2))"
    iso = f"CASE WHEN {year_first} THEN replace(x.m, '/', '-') WHEN {day_first} THEN CASE WHEN try_cast({of_year(4, 1)} AS DATE) IS NULL AND substr(x.m, 3, 1) = '/' THEN {of_year(1, 4)} ELSE {of_year(4, 1)} END END"
    octet = " AND ".join(f"{q.number(q.part('x.m', i))} <= 255" for i in (1, 2, 3, 4))
    day = q.days("try_cast(x.z AS DATE)")
    phone = "|".join(f"^{p}{{4}}$" for p in _PHONES).replace(chr(92), chr(92) * q.escape) + f"|^{_ABROAD}$".replace(chr(92), chr(92) * q.escape) + "|^[+][0-9]{8,15}$|^[2-9][0-9]{2}[2-9][0-9]{6}$"
    called = f"^(?:{_CALLED})$".replace(chr(92), chr(92) * q.escape)
    keep = {"m": "x.m", "d": "x.d", "n": "x.n"}
    e = q.each(found, "m", q.struct({"m": "m", "d": q.digits("m")}))
    e = q.each(e, "x", q.struct({"m": "x.m", "d": "x.d", "n": "CAST(length(x.d) AS BIGINT)", "z": iso}))
    turned = "concat(substr(replace(x.m, ' ', ''), 5), substr(x.m, 1, 4))"
    kind = f"""CASE WHEN {q.regex('x.m', called)} THEN NULL WHEN x.m LIKE '%@%' THEN 'mail'
      WHEN {q.regex('x.m', '^[A-Z]{2}[0-9]{2}[0-9A-Z ]{11,}$')} AND {_mod97(q, turned)} = 1 THEN 'iban'
      WHEN {q.regex('x.m', '^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$')} THEN 'ip6'
      WHEN {q.regex('x.m', '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$')} THEN CASE WHEN {octet} THEN 'ip' END
      WHEN x.z IS NOT NULL THEN CASE WHEN {day} BETWEEN 0 AND 73169 THEN 'date' END
      WHEN {q.regex('x.m', phone)} AND x.n BETWEEN 8 AND 15 THEN 'phone'
      WHEN {q.regex('x.m', '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} THEN 'ssn'
      WHEN {q.regex('x.m', '^[0-9 -]+$')} AND x.n BETWEEN 13 AND 19 THEN CASE WHEN {_luhn(q, 'x.d', 'x.n', 0)} % 10 = 0 THEN 'card' END
      WHEN x.m LIKE '%=%' THEN 'password'
      WHEN {q.regex('x.m', '^AKIA[0-9A-Z]{16}$')} THEN 'secret'
      WHEN {q.regex('x.m', '^[0-9A-Za-z]{32,}$')} AND {q.regex('x.m', '[0-9]')} AND {q.regex('x.m', '[A-Za-z]')} THEN 'secret' END"""
    e = q.each(e, "x", q.struct(keep | {"z": "x.z", "k": kind}))
    # u digits are permuted from the (p + 1)-th on, in halves of h and u - h
    u = "CASE x.k WHEN 'card' THEN x.n - 1 WHEN 'phone' THEN CASE WHEN x.n > 9 THEN 10 ELSE x.n - 1 END WHEN 'ssn' THEN 9 WHEN 'iban' THEN x.n - 2 ELSE 0 END"
    keep |= {"k": "x.k"}
    e = q.each(e, "x", q.struct(keep | {"z": "x.z", "u": f"CAST({u} AS BIGINT)", "p": "CAST(CASE x.k WHEN 'phone' THEN CASE WHEN x.n > 9 THEN x.n - 10 ELSE 1 END WHEN 'iban' THEN 2 ELSE 0 END AS BIGINT)", "h": f"CAST({q.div(u, '2')} AS BIGINT)"}))
    keep |= {"u": "x.u", "p": "x.p", "h": "x.h"}
    cut = lambda a, n: q.number(f"substr(x.d, CAST({a} AS INT), CAST({n} AS INT))")
    of = lambda i: q.number(q.part("x.m", i))
    a = f"CASE x.k WHEN 'ip' THEN {of(1)} * 256 + {of(2)} WHEN 'date' THEN CAST({q.div(day, '270')} AS BIGINT) ELSE {cut('x.p + 1', 'x.h')} END"
    b = f"CASE x.k WHEN 'ip' THEN {of(3)} * 256 + {of(4)} WHEN 'date' THEN CAST({day} % 270 AS BIGINT) ELSE {cut('x.p + x.h + 1', 'x.u - x.h')} END"
    size = lambda n, ip, date: f"CASE x.k WHEN 'ip' THEN {ip} WHEN 'date' THEN {date} ELSE CAST(power(10, {n}) AS BIGINT) END"
    e = q.each(e, "x", q.struct(keep | {"a": a, "b": b, "ma": size("x.h", 65536, 271), "mb": size("x.u - x.h", 65536, 270)}))
    keep |= {"ma": "x.ma", "mb": "x.mb"}
    for r in range(ROUNDS):
        on, by = ("a", "b") if r % 2 == 0 else ("b", "a")
        f = q.hex(f"substr({q.hash(f"concat({key}, '|', x.k, '|', {q.text('x.u')}, '|{r}|', {q.text(f'x.{by}')})")}, 1, 12)")
        e = q.each(e, "x", q.struct(keep | {on: f"CASE WHEN x.ma > 1 THEN (x.{on} + {f}) % x.m{on} ELSE x.{on} END", by: f"x.{by}"}))
    digits = f"concat(substr(x.d, 1, CAST(x.p AS INT)), lpad({q.text('x.a')}, CAST(x.h AS INT), '0'), lpad({q.text('x.b')}, CAST(x.u - x.h AS INT), '0'))"
    e = q.each(e, "x", q.struct({"m": "x.m", "k": "x.k", "a": "x.a", "b": "x.b", "n": "x.n", "w": f"CASE WHEN x.k IN ('card', 'phone', 'ssn', 'iban') THEN {digits} END"}))
    check = q.text(f"(10 - {_luhn(q, 'x.w', '(x.n - 1)', 1)} % 10) % 10")
    e = q.each(e, "x", q.struct({"m": "x.m", "k": "x.k", "a": "x.a", "b": "x.b", "w": f"CASE WHEN x.k = 'card' THEN concat(x.w, {check}) ELSE x.w END"}))
    at = f"CAST(length({q.digits('substr(x.m, 1, CAST(i AS INT))')}) AS INT)"
    c = "substr(x.m, CAST(i AS INT), 1)"
    filled = q.join(q.each(q.upto("length(x.m)"), "i", f"CASE WHEN {q.regex(c, '[0-9]')} THEN substr(x.w, {at}, 1) ELSE {c} END"))
    new_day = q.day("x.a * 270 + x.b")
    ip = ", '.', ".join(q.text(v) for v in (q.div("x.a", "256"), "x.a % 256", q.div("x.b", "256"), "x.b % 256"))
    sign = "CAST(instr(x.m, '=') AS INT)"
    keyed = q.hash(f"concat({key}, '|', x.k, '|', lower(x.m))")
    six = ", ':', ".join(f"substr({keyed}, {i}, 4)" for i in range(3, 31, 4))
    whole = lambda m: f"concat(substr(replace({m}, ' ', ''), 5), substr({m}, 1, 2), '00')"
    sep, year, month, day_ = "substr(x.m, {n}, 1)", f"substr({new_day}, 1, 4)", f"substr({new_day}, 6, 2)", f"substr({new_day}, 9, 2)"
    american = f"try_cast({of_year(4, 1)} AS DATE) IS NULL"
    out = f"""CASE WHEN x.k IS NULL THEN x.m
      WHEN x.k = 'mail' THEN concat('p', substr({keyed}, 1, 16), '@pseudonym.invalid')
      WHEN x.k = 'secret' THEN substr({q.hash(f"concat({key}, '|', x.k, '|', x.m)")}, 1, least(64, CAST(length(x.m) AS INT)))
      WHEN x.k = 'password' THEN concat(substr(x.m, 1, {sign}), substr({q.hash(f"concat({key}, '|', x.k, '|', substr(x.m, {sign} + 1))")}, 1, least(64, CAST(length(x.m) AS INT) - {sign})))
      WHEN x.k = 'ip' THEN concat({ip})
      WHEN x.k = 'ip6' THEN concat('fd', substr({keyed}, 1, 2), ':', {six})
      WHEN x.k = 'date' AND {year_first} THEN concat({year}, {sep.format(n=5)}, {month}, {sep.format(n=8)}, {day_})
      WHEN x.k = 'date' AND {american} THEN concat({month}, {sep.format(n=3)}, {day_}, {sep.format(n=6)}, {year})
      WHEN x.k = 'date' THEN concat({day_}, {sep.format(n=3)}, {month}, {sep.format(n=6)}, {year}) ELSE {filled} END"""
    e = q.each(e, "x", q.struct({"m": "x.m", "k": "x.k", "o": out}))
    check97 = f"lpad({q.text(f'98 - {_mod97(q, whole("x.o"))}')}, 2, '0')"
    return q.each(e, "x", q.struct({"k": "x.k", "o": f"CASE WHEN x.k = 'iban' THEN concat(substr(x.o, 1, 2), {check97}, substr(x.o, 5)) ELSE x.o END"}))


def apply(docs: DataFrame, *, key: str, text_col: str = "text", found_col: str | None = "n_found") -> DataFrame:
    """The rows with the text's personal data replaced; every other column is kept.

    ``found_col`` names a further column, the number of values replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    names = docs.columns
    text = docs[text_col].cast("string")
    some = F.when(text.rlike(SOME), text)
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    df = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text.alias("t"), F.regexp_extract_all(some, F.lit(CANDIDATE), F.lit(0)).alias("found"), secret.alias("secret"))
    df = df.withColumn("new", F.expr(pseudonyms("found", "secret")))
    gaps = F.split("t", CANDIDATE, -1)
    put = F.array_join(F.flatten(F.zip_with(gaps, F.col("new.o"), lambda g, o: F.array(g, F.coalesce(o, F.lit(""))))), "")
    n = F.coalesce(F.size(F.filter("new.k", lambda k: k.isNotNull())), F.lit(0)).cast("long")
    hit = F.exists("new.k", lambda k: k.isNotNull())
    cols = [(F.when(hit, put).otherwise(F.col("t")) if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    return df.select(*cols, *([n.alias(found_col)] if found_col else []))


def report(docs: DataFrame, key: str) -> DataFrame:
    return apply(docs.select("doc_id", "text"), key=key)


def oracle(key: str) -> str:
    """The same in DuckDB."""
    c = CANDIDATE.replace("'", "''")
    literal = "'" + key.replace("'", "''") + "'"
    return f"""
WITH f AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '{SOME}') THEN regexp_extract_all(text, '{c}') END AS found FROM documents),
n AS (SELECT doc_id, text, {pseudonyms('found', literal, Duck)} AS new FROM f),
g AS (SELECT doc_id, text, new, list_filter(new, lambda x: x.k IS NOT NULL) AS hit, string_split_regex(text, '{c}') AS gaps FROM n)
SELECT doc_id, CASE WHEN len(hit) > 0 THEN array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: concat(gaps[i], coalesce(new[i].o, ''))), '') ELSE text END AS text,
  coalesce(len(hit), 0)::BIGINT AS n_found
FROM g
"""
