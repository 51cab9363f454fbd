"""Licence scans by sentence rules; DataFrame functions only.

A text is cut into sentences: at full stops, question and exclamation marks that
white space follows, and at empty lines (lines with nothing but signs of comments
count as empty). Other line ends are wraps and join. A sentence is normalised:
lower case, spelling variants brought together, addresses left out, everything but
letters, digits and inner dots becomes one space. Known licence sentences are
looked up in it, from left to right, the longer of two that begin at one place
first, so a sentence that names several licences gives several identifiers. The
identifiers of a text form a sequence, in the text's order. Ordered rules are then
matched against the sequence: the first rule that applies takes the identifiers it
covers, for as often as they occur, then the next rule follows. Identifiers that no
rule takes are reported as ``unknown:<identifier>``, except for those in ``ASIDE``,
which say nothing without a licence beside them; ``all-rights`` counts only where
nothing else was found.

Only sentences with one of the trigger words are looked at; every known sentence has
one, which the tests check. Null, empty and wordless texts have no licence; an empty
table gives no rows; rows that repeat give repeated results; columns other than the id
and the text, of whatever name, are ignored. Whole texts are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNDER = r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the |a |an )?"
_IT = r"(?:this (?:program|library|file|software|package)|[a-z0-9.]+(?: [a-z0-9.]+){0,4}) is free software you can redistribute it and or modify it under the terms of the "
_FSF = r" as published by the free software foundation"
_LATER = r" of the license or at your option any later version"

#: Licences that SPDX names; fixed values of the SPDX list.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense", "Zlib", "0BSD",
)

#: identifier -> normalised sentence, with free parts as a pattern (no look-around: DuckDB runs it too)
SENTENCES: dict[str, str] = {
    "apache2-header": r"(?:licensed|licenses this (?:file|work) to you) under the apache license version 2\.0 the license you may not use this (?:file|work) except in compliance with the license",
    "apache2-copy": r"you may obtain a copy of the license at",
    "apache2-asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind(?: either express or implied)?",
    "apache2-see": r"see the license for the specific language governing permissions and limitations under the license",
    "apache2-title": r"apache license version 2\.0 january 2004",
    "apache2-short": _UNDER + r"apache (?:software )?license (?:version |v ?)?2(?:\.0)?",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions)?",
    "mit-notice": r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies(?: or substantial portions of the software)?",
    "mit-asis": r"the software is provided as is without warranty of any kind express or implied(?: including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement)?",
    "mit-liable": r"in no event shall the authors or copyright holders be liable(?: for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software)?",
    "mit-title": r"^(?:the )?mit license(?: mit)?$",
    "mit-short": _UNDER + r"(?:mit|expat) license",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?",
    "bsd-source": r"redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?",
    "bsd-binary": r"redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution)?",
    "bsd-advert": r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
    "bsd-endorse": r"neither the names? of .{1,200}? may be used to endorse or promote products derived from this software(?: without specific prior written permission)?",
    "bsd-asis": r"this software is provided by .{1,100}? as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": r"in no event shall .{1,100}? be liable for any direct indirect incidental special exemplary or consequential damages",
    "bsd3-short": _UNDER + r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license",
    "bsd2-short": _UNDER + r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license",
    "isc-grant": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?",
    "isc-asis": r"the software is provided as is and .{1,60}? disclaims? all warranties with regard to this software",
    "isc-liable": r"in no event shall .{1,60}? be liable for any special direct indirect or consequential damages or any damages whatsoever",
    "isc-short": _UNDER + r"isc license",
    "mpl2-header": r"this source code form is subject to the terms of the mozilla public license (?:version |v ?)2\.0",
    "mpl2-copy": r"if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl2-title": r"^mozilla public license version 2\.0$",
    "mpl2-short": _UNDER + r"mozilla public license (?:version |v ?)?2(?:\.0)?",
    "cc-by-nc": _UNDER + r"(?:cc by nc|creative commons attribution (?:noncommercial|non commercial))(?: 4\.0)?",
    "cc-by-sa": _UNDER + r"(?:cc by sa|creative commons attribution (?:sharealike|share alike))(?: 4\.0)?",
    "cc-by-nd": _UNDER + r"(?:cc by nd|creative commons attribution (?:noderivatives|no derivatives|noderivs))(?: 4\.0)?",
    "cc-by": _UNDER + r"(?:cc by|creative commons attribution) 4\.0",
    "cc0": r"cc0 1\.0|creative commons zero|dedicated to the public domain",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "spdx": r"spdx license identifier",
    "all-rights": r"all rights reserved",
}
#: The GNU family: every licence has the same sentences with its own name and versions.
GNU = {"gpl": ("GPL", "gnu general public license", ("2", "3")), "lgpl": ("LGPL", "gnu (?:lesser|library) general public license", ("2.1", "3")), "agpl": ("AGPL", "gnu affero general public license", ("3",))}
for _key, (_, _name, _versions) in GNU.items():
    for _v in _versions:
        _n = _v.replace(".", r"\.")
        _called = rf"(?:{_name}|gnu {_key}|{_key}) (?:version |v ?)?{_n}(?:\.0)?"
        SENTENCES |= {
            f"{_key}{_v}-free": _IT + _name + _FSF + rf" (?:either )?version {_n}" + _LATER,
            f"{_key}{_v}-exact": _IT + _name + rf"(?: version {_n}(?: only)?{_FSF}|{_FSF} version {_n} of the license)",
            f"{_key}{_v}-later": _UNDER + _called + " or (?:any )?later",
            f"{_key}{_v}-short": _UNDER + _called,
        }
    SENTENCES |= {f"{_key}-details": rf"see the {_name} for more details", f"{_key}-copy": rf"you should have received a copy of the {_name} along with this [a-z]+"}
SENTENCES |= {
    "gpl3-title": r"gnu general public license version 3 29 june 2007",
    "gpl2-title": r"gnu general public license version 2 june 1991",
    "gnu-hope": r"is distributed in the hope that it will be useful but without any warranty(?: without even the implied warranty of merchantability or fitness for a particular purpose)?",
}
SENTENCES |= {f"spdx-{n}": "spdx license identifier " + n.lower().replace("-", " ").replace(".", r"\.") for n in SPDX}



def _gnu_rules() -> Iterator[tuple[str, str, tuple[str, ...]]]:
    for key, (name, _, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else v + ".0"
            for kind, suffix in (("free", "or-later"), ("exact", "only")):
                rest = ("gnu-hope", f"{key}-details", f"{key}-copy")
                for n, rule in ((3, "full"), (2, "notice"), (0, "terms")):
                    yield f"{key}{v}-{kind}-{rule}", f"{name}-{full}-{suffix}", (f"{key}{v}-{kind}", *rest[:n])
            for kind, suffix in (("later", "or-later"), ("short", "only")):
                yield f"{key}{v}-{kind}", f"{name}-{full}-{suffix}", (f"{key}{v}-{kind}",)


#: ordered: (rule, licence, identifiers that follow one another)
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache2-text", "Apache-2.0", ("apache2-title", "apache2-header", "apache2-copy", "apache2-asis", "apache2-see")),
    ("apache2-full", "Apache-2.0", ("apache2-header", "apache2-copy", "apache2-asis", "apache2-see")),
    ("mit-text", "MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("mit-grant-notice", "MIT", ("mit-grant", "mit-notice")),
    ("bsd4-full", "BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis", "bsd-liable")),
    ("bsd3-full", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liable")),
    ("bsd2-full", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable")),
    ("bsd3-terms", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2-terms", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("isc-full", "ISC", ("isc-grant", "isc-asis", "isc-liable")),
    ("mpl2-full", "MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("gpl3-text", "GPL-3.0-only", ("gpl3-title", "gpl3-free", "gnu-hope", "gpl-details", "gpl-copy")),
    ("gpl2-text", "GPL-2.0-only", ("gpl2-title", "gpl2-free", "gnu-hope", "gpl-details", "gpl-copy")),
    *_gnu_rules(),
    ("gpl3-title", "GPL-3.0-only", ("gpl3-title",)),
    ("gpl2-title", "GPL-2.0-only", ("gpl2-title",)),
    ("apache2-title", "Apache-2.0", ("apache2-title",)),
    ("apache2-header", "Apache-2.0", ("apache2-header",)),
    ("apache2-short", "Apache-2.0", ("apache2-short",)),
    ("mit-title", "MIT", ("mit-title",)),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-short", "MIT", ("mit-short",)),
    ("bsd3-short", "BSD-3-Clause", ("bsd3-short",)),
    ("bsd2-short", "BSD-2-Clause", ("bsd2-short",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("isc-short", "ISC", ("isc-short",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-header",)),
    ("mpl2-title", "MPL-2.0", ("mpl2-title",)),
    ("mpl2-short", "MPL-2.0", ("mpl2-short",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa",)),
    ("cc-by-nd", "CC-BY-ND-4.0", ("cc-by-nd",)),
    ("cc-by", "CC-BY-4.0", ("cc-by",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    *[(f"spdx-{n}", n, (f"spdx-{n}",)) for n in SPDX],
]
#: Sentences of warranty and copying: without a licence's own sentences they name none.
ASIDE = ("all-rights", "gnu-hope", "gpl-copy", "lgpl-copy", "agpl-copy", "apache2-copy", "mpl2-copy", "mit-notice", "mit-asis", "mit-liable", "bsd-asis", "bsd-liable", "isc-asis", "isc-liable")
RESERVED = "All-rights-reserved"

TRIGGERS = ("licens", "licenc", "software", "free of charge", "creative commons", "cc0", "public domain", "rights reserved", "redistribution", "permission notice", "shall", "in the hope that", "spdx", "mpl", "gpl", "cc by", "cc-by")
_TRIGGER = "(?i)(" + "|".join(TRIGGERS) + ")"
#: Longer sentences first: of two that begin at one place the longer one is meant.
_ORDERED = sorted(SENTENCES, key=lambda i: (i == "spdx", -len(SENTENCES[i]), i))
_ANY = "|".join(p if p.startswith("^") else rf"\b(?:{p})\b" for p in map(SENTENCES.__getitem__, _ORDERED))

#: Before a text is cut: (pattern, what takes its place). Wrapped lines join in the end.
_FLAT = (
    (r"\r\n?", "\n"),
    (r"\b(?:OR|AND) (" + "|".join(n.replace(".", r"\.") for n in SPDX) + r")\b", r". SPDX-License-Identifier: \1"),
    (r"(^|\n)[ \t]*(?:dnl|REM|rem)[ \t]", r"\1 "),
    (r"\n[^A-Za-z0-9\n]*\n", "\x01"),
    (r"\b([Vv])\.[^A-Za-z0-9]*([0-9])", r"\1 \2"),
)
_CUT = r"[.!?]+[\x22\x27)\]]*\s+|\x01"
#: Of a sentence, once it is in lower case.
_NORMAL = (
    (r"https?://[^\s>)]*", " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"[^a-z0-9.]+", " "),
    (r"(^|[^a-z0-9])[.]+", r"\1 "),
    (r"[.]+([^a-z0-9]|$)", r" \1"),
    (r" +", " "),
)


def sentences(text: Column) -> Column:
    """Normalised sentences with a trigger word; null where the text has none."""
    for pattern, by in _FLAT:
        text = F.regexp_replace(text, pattern, by.replace("\\", "$"))
    some = F.filter(F.split(text, _CUT, -1), lambda x: x.rlike(_TRIGGER))

    def normal(x: Column) -> Column:
        x = F.lower(x)
        for pattern, by in _NORMAL:
            x = F.regexp_replace(x, pattern, by.replace("\\", "$"))
        return F.trim(x)

    return F.transform(some, normal)


def identifiers(normalised: Column) -> Column:
    """The known sentences in an array of normalised ones, in order."""

    def name(m: Column) -> Column:
        out = None
        for i in _ORDERED:
            is_it = m.rlike(f"^(?:{SENTENCES[i]})$")
            out = F.when(is_it, i) if out is None else out.when(is_it, i)
        return out

    return F.flatten(F.transform(normalised, lambda x: F.transform(F.regexp_extract_all(x, F.lit(_ANY), F.lit(0)), name)))


def apply_rules(ids: Column) -> Column:
    """The sequence after the rules' turns: ``#rule`` in place of what it covered."""
    seq = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    for rule, _, of in RULES:
        seq = F.replace(seq, F.lit(f" {'  '.join(of)} "), F.lit(f" #{rule} "))
    seq = F.regexp_replace(seq, r"^( all-rights )+$", " #all-rights ")
    return F.filter(F.split(seq, " +"), lambda x: (x != "") & ~x.isin(*ASIDE))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, rules, licenses``, joined by commas; one row per document.

    ``n_sentences`` counts the licence sentences found.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    df = df.select("doc_id", F.when(F.col("t").rlike(_TRIGGER), sentences(F.col("t"))).alias("s"))
    df = df.select("doc_id", F.coalesce(identifiers(F.col("s")), F.array().cast("array<string>")).alias("ids"))
    df = df.select("doc_id", "ids", apply_rules(F.col("ids")).alias("hit"))
    licence = F.create_map(*[F.lit(x) for rule, name, _ in [*RULES, ("all-rights", RESERVED, ())] for x in (f"#{rule}", name)])
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.transform(F.filter("hit", lambda x: x.startswith("#")), lambda x: F.substr(x, F.lit(2))), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hit", lambda x: F.coalesce(F.try_element_at(licence, x), F.concat(F.lit("unknown:"), x))))), ",").alias("licenses"),
    )


def _rows(pairs) -> str:
    return "(VALUES " + ", ".join(f"({n}, '{a}', '{b}')" for n, (a, b) in enumerate(pairs)) + ")"


def oracle() -> str:
    """DuckDB SQL of its own build: sentences become rows, are joined with the table of
    known ones, and the sequences are strings again when the rules come."""
    flat = "text"
    for pattern, by in _FLAT:
        flat = f"regexp_replace({flat}, '{pattern}', '{by}', 'g')"
    normal = "lower(s)"
    for pattern, by in _NORMAL:
        normal = f"regexp_replace({normal}, '{pattern}', '{by}', 'g')"
    ruled = "seq"
    for rule, _, ids in RULES:
        ruled = f"replace({ruled}, ' {'  '.join(ids)} ', ' #{rule} ')"
    aside = ", ".join(f"'{i}'" for i in ASIDE)
    hits = f"list_filter(string_split(regexp_replace({ruled}, '^( all-rights )+$', ' #all-rights '), ' '), lambda x: x <> '')"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
known AS (SELECT * FROM {_rows((i, SENTENCES[i]) for i in _ORDERED)} AS v(nth, sid, pattern)),
rule AS (SELECT * FROM {_rows([*((r, x) for r, x, _ in RULES), ('all-rights', RESERVED)])} AS v(nth, rule, licence)),
p AS (SELECT r, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT r, string_split_regex({flat}, '{_CUT}') AS p FROM d WHERE regexp_matches(text, '{_TRIGGER}'))),
s AS (SELECT r, i, trim({normal}) AS s FROM p WHERE regexp_matches(s, '{_TRIGGER}')),
m AS (SELECT r, i, unnest(found) AS phrase, unnest(range(len(found))) AS k FROM (SELECT r, i, regexp_extract_all(s, '{_ANY}') AS found FROM s)),
of AS (SELECT phrase, arg_min(sid, nth) AS sid FROM (SELECT DISTINCT phrase FROM m) JOIN known ON regexp_full_match(phrase, pattern) GROUP BY 1),
q AS (SELECT r, count(*) AS n, string_agg(sid, ',' ORDER BY i, k) AS ids, ' ' || string_agg(sid, '  ' ORDER BY i, k) || ' ' AS seq FROM m JOIN of USING (phrase) GROUP BY 1),
u AS (SELECT r, unnest(hit) AS x, unnest(range(len(hit))) AS k FROM (SELECT r, {hits} AS hit FROM q)),
w AS (SELECT r, string_agg(substr(x, 2), ',' ORDER BY k) FILTER (WHERE x LIKE '#%') AS rules, string_agg(DISTINCT coalesce(licence, 'unknown:' || x), ',' ORDER BY coalesce(licence, 'unknown:' || x)) AS licences
  FROM u LEFT JOIN rule ON x = '#' || rule WHERE x NOT IN ({aside}) GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licenses
FROM d LEFT JOIN q USING (r) LEFT JOIN w USING (r)
"""
