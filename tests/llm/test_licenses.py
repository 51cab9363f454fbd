"""Licence scans: standard texts, wrapped and in comments, and a plain matcher of its own."""

import random
import re
import textwrap

import pytest

pytest.importorskip("bhashya.llm")

from pyspark.sql import functions as F  # noqa: E402

from bhashya.llm import licenses as L  # noqa: E402

MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED.",
]


def gnu(name, version, it="program"):
    return [
        f"This {it} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
        f"You should have received a copy of the {name} along with this {it}. If not, see <https://www.gnu.org/licenses/>.",
    ]


STANDARD = {
    "MIT": [MIT, ["MIT License", "Copyright (c) 2021 A. Name", *MIT]],
    "BSD-3-Clause": [BSD, ["Copyright 2020 Somebody, Inc. All rights reserved.", *BSD]],
    "BSD-2-Clause": [BSD[:3] + BSD[4:]],
    "Apache-2.0": [
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
            "http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ],
        ["Apache License Version 2.0, January 2004", "http://www.apache.org/licenses/"],
    ],
    "GPL-3.0-or-later": [gnu("GNU General Public License", "3")],
    "GPL-2.0-or-later": [gnu("GNU General Public License", "2")],
    "LGPL-2.1-or-later": [gnu("GNU Lesser General Public License", "2.1", "library")],
    "AGPL-3.0-or-later": [gnu("GNU Affero General Public License", "3")],
    "ISC": [
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
        ]
    ],
    "MPL-2.0": [["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]],
}
ONE_LINERS = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "x\nThis work is licensed under the GNU General Public License, version 3.\ny": "GPL-3.0-only",
    "Released under the MIT License. Also: Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0,MIT",
    "Licensed under the Apache License, Version 2.0 or released under the MIT License": "Apache-2.0,MIT",
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": "Apache-2.0,MIT",
    "SPDX-License-Identifier: Other": "unknown:spdx",
    "All rights reserved.": "All-rights-reserved",
    "The GNU Affero General Public License exists, and so does the MIT license.": "",
    "The software is provided as is, without warranty of any kind, express or implied.": "",
    "Distributed under the terms of the GNU GPL v3 or later": "GPL-3.0-or-later",
}


def wrapped(paragraphs, width, before="", sep="\n\n"):
    lines = sep.join("\n".join(textwrap.wrap(p, width - len(before))) for p in paragraphs).split("\n")
    return "\n".join((before + x).rstrip() for x in lines)


def layouts(paragraphs):
    yield "\n".join(paragraphs)
    for w in (60, 72, 80):
        yield wrapped(paragraphs, w)
        yield "/*\n" + wrapped(paragraphs, w, " * ") + "\n */\nint main() {}"
        yield wrapped(paragraphs, w, "# ") + "\nimport os"
        yield wrapped(paragraphs, w, "// ").replace("\n", "\r\n")
        yield "Some words before it\n" + wrapped(paragraphs, w, sep="\n") + "\nand more behind it"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_standard_texts_are_recognised_in_every_layout(spark):
    cases = [(licence, t) for licence, all_ in STANDARD.items() for paragraphs in all_ for t in layouts(paragraphs)]
    got = {r["doc_id"]: r["licenses"] for r in L.report(frame(spark, [t for _, t in cases])).collect()}
    wrong = [(licence, got[i], t) for i, (licence, t) in enumerate(cases) if got[i] != licence]
    assert not wrong, wrong[0]


def test_short_statements(spark):
    got = {r["doc_id"]: r["licenses"] for r in L.report(frame(spark, list(ONE_LINERS))).collect()}
    assert [got[i] for i in range(len(got))] == list(ONE_LINERS.values())


def test_sentences_have_triggers_and_rules_know_their_sentences():
    for name, p in L.SENTENCES.items():
        assert re.search(L._TRIGGER, p), name
    assert {i for _, _, ids in L.RULES for i in ids} <= set(L.SENTENCES) and set(L.ASIDE) <= set(L.SENTENCES)
    assert len({r for r, _, _ in L.RULES}) == len(L.RULES)


# -- a matcher in plain Python, from the docstring ----------------------------------


def plain(text):
    """(sentence ids, rules, licences)."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    names = "|".join(map(re.escape, L.SPDX))
    text = re.sub(rf"\b(?:OR|AND) ({names})\b", r". SPDX-License-Identifier: \1", text)
    lines = [re.sub(r"^[ \t]*(dnl|REM|rem)[ \t]", " ", x) for x in text.split("\n")]
    paragraphs, held = [], []
    for k, x in enumerate(lines):
        if 0 < k < len(lines) - 1 and not re.search("[A-Za-z0-9]", x):
            paragraphs.append("\n".join(held))
            held = []
        else:
            held.append(x)
    paragraphs.append("\n".join(held))
    ids = []
    for p in paragraphs:
        for s in re.split(r"[.!?]+[\"')\]]*\s+", re.sub(r"\b([Vv])\.[^A-Za-z0-9]*([0-9])", r"\1 \2", p)):
            s = re.sub(r"https?://[^\s>)]*", " ", s.lower()).replace("licence", "license").replace("sub-license", "sublicense")
            words = [w.strip(".") for w in re.findall("[a-z0-9.]+", s)]
            s, at = " ".join(w for w in words if w), 0
            while at < len(s):
                best = None
                for i in sorted(L.SENTENCES, key=lambda i: (i == "spdx", -len(L.SENTENCES[i]), i)):
                    m = re.compile(rf"\b(?:{L.SENTENCES[i]})\b").match(s, at) if not L.SENTENCES[i].startswith("^") or at == 0 else None
                    if m:
                        best = (i, m.end())
                        break
                if best:
                    ids.append(best[0])
                at = best[1] if best else at + 1
    left = list(ids)
    for rule, _, of in L.RULES:
        k = 0
        while k < len(left):
            if left[k : k + len(of)] == list(of):
                left[k : k + len(of)] = ["#" + rule]
            k += 1
    if left and set(left) == {"all-rights"}:
        left = ["#all-rights"]
    left = [x for x in left if x not in L.ASIDE]
    of = {"#" + r: x for r, x, _ in L.RULES} | {"#all-rights": L.RESERVED}
    return ",".join(ids), ",".join(x[1:] for x in left if x[0] == "#"), ",".join(sorted({of.get(x, "unknown:" + x) for x in left}))


def test_equal_to_the_plain_matcher(spark):
    rng = random.Random(3)
    parts = [p for all_ in STANDARD.values() for x in all_ for p in x] + list(ONE_LINERS) + ["some prose here", "the licence of it", "Copyright (c) 2020"]
    texts = [None, "", "  ", "...", "\n\n", "licens", "é 日本 software"] + [t for all_ in STANDARD.values() for x in all_ for t in layouts(x)]
    for _ in range(150):
        some = [rng.choice(parts) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "\n\n", ". ", "\n * \n", "\r\n"]).join(some))
    texts += [texts[9], "prose " * 30000 + MIT[0]]
    docs = frame(spark, texts).withColumn("s", F.lit("clash")).withColumn("ids", F.lit(1))
    got = {r["doc_id"]: (r["sentence_ids"], r["rules"], r["licenses"]) for r in L.report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t
    assert L.report(docs.limit(0)).count() == 0


def test_equal_to_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", "x"] + [t for all_ in STANDARD.values() for x in all_ for t in layouts(x)] + list(ONE_LINERS) * 2
    rows = [(i % 20, t) for i, t in enumerate(texts)]  # ids repeat
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    ours = sorted((tuple(r) for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert ours == sorted(c.execute(L.oracle()).fetchall(), key=key)
