"""Every operator of the subpackage against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import ann, jaccard, lcp, licenses, linededup, mixing, packing, quality, sharding, simhash, toxicity
from lexiloom.llm.components import connected_components
from lexiloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, shard int, h string, lines string, `__x` int"
LONG = "word another, third. " * 30_000
ROWS = [
    (1, "One line here is long enough to count. Another line follows it at once. And a third.\nLast", "en", "b"),
    (2, "One line here is long enough to count. Another line follows it at once. And a third.\nLast", "en", "a"),
    (2, "One line here is long enough to count. Another line follows it at once. And a third.\nLast", "en", "a"),
    (3, None, None, None), (4, "", "en", "a"), (5, "   \n\t ", "de", "a"), (None, "no id at all", "en", "b"), (6, LONG, "en", "a"),
    (7, "Licensed under the MIT License.\nü😀 x", None, "c"), (8, "two words", "en", None), (9, "\x00odd <|endoftext|> text", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "h", "l", 4) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(odd):  # noqa: ANN001, ANN201
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs():  # noqa: ANN201
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, None), (None, 0, 1), (6, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


# --- 1 line dedup ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):  # noqa: ANN001, ANN201
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    key = lambda d: sorted(tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert sorted(want.columns) == sorted(got.columns) and key(got) == key(want)


def test_line_dedup_odd(odd, none):  # noqa: ANN001, ANN201
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS) and linededup.dedup_lines(none).count() == 0
    text = defaultdict(list)
    for r in out.collect():
        text[r.doc_id].append(r.text)
    assert text[1] == [ROWS[0][1]] and text[3] == [None] and text[4] == [""] and len(text[2]) == 2
    assert text[2][0] == text[2][1] and len(text[2][0]) < len(ROWS[1][1])
    assert len(text[6][0]) < 1000  # a text that repeats itself keeps one of each chunk
    clash = odd.withColumnsRenamed({"size": "key", "fp": "found", "shard": "gone"})
    assert linededup.dedup_lines(clash).columns == clash.columns


def test_line_dedup_finds_shifted_passages(spark):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(1)
    line = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(9)) + "."
    passage = "\n".join(line() for _ in range(30))
    rows = [(i, "\n".join([*[line() for _ in range(i)], passage, line()])) for i in range(1, 6)] + [(9, "\n".join(line() for _ in range(20)))]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[9] == rows[-1][1]
    assert all(len(out[i]) < len(rows[i - 1][1]) - 0.7 * len(passage) for i in range(2, 6))


def words_of(rng, n: int) -> str:  # noqa: ANN001
    return " ".join("".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(n))


@pytest.mark.parametrize("sentences", [1, 2, 6])
def test_repeated_paragraphs_go_whatever_surrounds_them(spark, sentences: int):  # noqa: ANN001
    """A passage of over 50 words, of one sentence or several, alone or last in its document, in every document."""
    rng = np.random.default_rng(sentences)
    passage = " ".join(words_of(rng, 54 // sentences) + "." for _ in range(sentences))
    own = lambda: words_of(rng, int(rng.integers(5, 30))) + "."
    rows = [(i, "\n".join([f"{own()} {own()}", *([own()] * (i % 3)), passage, *([f"{own()} {own()} {own()}"] * (i % 2))])) for i in range(40)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and all(passage not in out[i] for i in range(1, 40))
    assert all(out[i].replace("\n", "") == t.replace(passage, "").replace("\n", "") for i, t in rows[1:])


def test_passages_inside_paragraphs_mostly_go(spark):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(8)
    passage = " ".join(words_of(rng, 8) + "." for _ in range(10))
    rows = [(i, f"{words_of(rng, 6)}. {words_of(rng, 9)}. {passage} {words_of(rng, 7)}. {words_of(rng, 7)}.") for i in range(60)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {i: {u for u in re.split(r"(?<=\.) ", t)} - {u for u in re.split(r"(?<=\.) ", passage)} for i, t in rows}
    lost = [len(rows[i][1]) - len(out[i]) for i in range(1, 60)]
    assert np.mean(lost) > 0.9 * len(passage) and all(u in out[i] for i in own for u in own[i])


def test_equal_hashes_of_different_texts_repeat_nothing(spark, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(linededup, "_CANDIDATES", linededup._CANDIDATES.replace("unhex(md5(", "unhex(concat('00', left(").replace(")) as h", ", 0))) as h"))
    rows = [(i, f"first line of {i}.\nsecond line of {i}.") for i in range(5)]
    assert sorted(r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [t for _, t in rows]


def test_line_dedup_of_a_text_of_20_mb(spark):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(9)
    body = "\n".join(". ".join(words_of(rng, 8) for _ in range(6)) + "." for _ in range(700))
    long = (body + "\n") * 98
    rows = [(1, long), (2, long), (3, body)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > 20_000_000 and out[1].strip() == body and out[2] == out[3] == ""


def test_lines_rejoin() -> None:
    for t in ["a. b! c?\nd", "...\n\n", "x", "3.5 and 2.", "é。\r\n", "  \n x.  \n\n y"]:
        assert "".join(re.findall(linededup.LINE.replace(r"\z", r"\Z"), t)) == t


# --- 2 near-duplicates -----------------------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_of(ids: list, linked) -> dict:  # noqa: ANN001
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def test_covering_masks_cover() -> None:
    for level in range(simhash.LEVELS):
        masks = [m & (2**64 - 1) for m in simhash.covering_masks(3, level)]
        rng = np.random.default_rng(level)
        for _ in range(3000):
            diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not m & diff for m in masks)


def test_near_duplicates_match_brute_force(spark, docs):  # noqa: ANN001, ANN201
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ids, fps = docs.doc_id.tolist(), [brute_fingerprint(t) for t in docs.text]
    want = components_of(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == {ids[i]: (fps[i], want[i]) for i in range(len(ids))}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_spanning_links_connect_exactly(points: list[int], radius: int) -> None:
    members, roots = simhash.spanning_links(np.array(points, np.uint64), radius)
    want = components_of(points, lambda i, j: (points[i] ^ points[j]).bit_count() <= radius)
    root = dict(zip(members.tolist(), roots.tolist(), strict=True))
    assert {p: root.get(p, p) for p in points} == {points[i]: c for i, c in want.items()}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(3)
    base = int(rng.integers(2**62))
    points = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, k, replace=False)) for k in (1, 2, 3) for _ in range(60)} | {int(x) for x in rng.integers(2**62, size=40)})
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), 3)
    got = {r.node: r.root for r in connected_components(found).collect()}
    want = components_of(points, lambda i, j: (points[i] ^ points[j]).bit_count() <= 3)
    assert {p: got.get(p, p) for p in points} == {points[i]: c for i, c in want.items()}


def test_components_of_a_long_chain(spark):  # noqa: ANN001, ANN201
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_duplicates_odd(odd, none):  # noqa: ANN001, ANN201
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[4] == by[5] == by[3] == 3 and by[None] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, None, 6, 7, 8, 9])


def brute_shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_near_dedup_reaches_similarity(spark):  # noqa: ANN001, ANN201
    from corpus_pipeline import near_dedup

    rng, rows = np.random.default_rng(3), []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60 + 5 * base)]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 2, 3, 5):
            copy = list(words)
            for at in rng.integers(0, len(copy), changes * len(copy) // 150 + 1):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, ""), (1001, None), (1002, "two words"), (1003, "Two  words"), (1004, "two other")]
    sets = [brute_shingles(t) for _, t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = components_of([i for i, _ in rows], like)
    got = [r.doc_id for r in near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert sorted(got) == sorted(set(want.values()))
    assert near_dedup(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count() == 0


# --- 3 licences ------------------------------------------------------------------------------------------------------


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from it.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
LICENCES = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL3,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance.\n#     http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "Public-Domain": "It is placed in the public-domain.", "Proprietary": "All rights\treserved",
    "MIT;Apache-2.0": "// SPDX-License-Identifier: (MIT OR Apache-2.0)", "GPL-2.0-only;Classpath-exception-2.0": "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */",
    "CC-BY-NC;Proprietary": "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "": "We license nothing", "LGPL-2.1": "GNU Lesser General Public License version 2.1",
}
# whole public licence texts, and what is said of licences in passing
BSD_FILE = """Copyright (c) 2019, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MIT_FILE = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC_FILE = """ISC License

Copyright (c) 2004-2010 by Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS.
"""
ZLIB_FILE = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
BOOST_FILE = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
SAID = [
    (BSD_FILE, "BSD-3-Clause"), (MIT_FILE, "MIT"), (ISC_FILE, "ISC"), (ZLIB_FILE, "Zlib"), (BOOST_FILE, "BSL-1.0"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Apache License 2.0", "Apache-2.0"),
    ("Copyright 2020 X. All rights reserved.\nLicensed under the Apache License, Version 2.0", "Apache-2.0"), ("The Apache Software License, Version 1.1", "Apache-1.1"), ("an Apache licence", "Apache"),
    ("Mozilla Public License Version 1.1", "MPL-1.1"), ("under the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("Eclipse Public License v1.0", "EPL-1.0"), ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "LGPL-2.0-or-later"), ("GNU Library General Public License as published by the Free Software Foundation, version 2", "LGPL-2.0"),
    ("GNU Lesser General Public License as published by the Free Software Foundation, either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"), ("LGPLv2.1", "LGPL-2.1"), ("the LGPL", "LGPL"),
    ("GNU Affero General Public License version 1", "AGPL-1.0"), ("GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "AGPL-3.0-or-later"), ("AGPLv3", "AGPL-3.0"),
    ("zlib License", "Zlib"), ("Boost Software License 1.0", "BSL-1.0"), ("the Artistic License 2.0", "Artistic-2.0"), ("Artistic Licence", "Artistic"), ("EUPL-1.2", "EUPL"), ("European Union Public Licence", "EUPL"), ("released under the WTFPL", "WTFPL"),
    ("All rights reserved.", "Proprietary"), ("All rights reserved. The weather is fine.", "Proprietary"), ("Released under the MIT license. All rights reserved.", "MIT;Proprietary"), ("All rights reserved. All rights reserved.", "Proprietary"),
    ("the ISC License", "ISC"), ("BSD 3-Clause License", "BSD"), ("licensed under a contract", "Unknown"), ("Apache 2.4 runs the server", ""), ("an EPL match and two MPL units", ""),
]


def test_everyday_licence_texts(spark):  # noqa: ANN001, ANN201
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string")).collect()}
    wrong = [(text[:60], want, got[i]) for i, (text, want) in enumerate(SAID) if got[i] != want]
    assert not wrong


def test_standard_licences(spark):  # noqa: ANN001, ANN201
    names = list(LICENCES)
    rows = [(i, f"int main;\n\n{LICENCES[n]}\n\nOther words here.") for i, n in enumerate(names)]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {names[i]: x for i, x in got.items()} == {n: n for n in names}


def test_every_sentence_has_its_word() -> None:
    """What a rule may match, written out, always has a word of the hint: else its texts would be passed over."""
    for name, _, pattern in licenses.SENTENCES:
        for one in re.split(r"\|(?![^(]*\))", pattern):
            plain = re.sub(r"\[a-z0-9 \][*+]|\\b", "", one).replace("licen[cs]e", "license").replace("licen[cs]ed", "licensed").replace("[0-9]{4}", "2020")
            for inner in re.findall(r"\(([^()]*)\)(\??)", plain):
                plain = plain.replace(f"({inner[0]}){inner[1]}", "" if inner[1] else inner[0].split("|")[0])
            assert re.search(licenses.HINT, plain.replace("?", "")), (name, plain)


def test_license_scan_odd(spark, odd, none):  # noqa: ANN001, ANN201
    assert {r.doc_id: r.licences for r in licenses.scan(odd).collect()}[7] == "MIT" and licenses.scan(odd).count() == len(ROWS)
    assert licenses.scan(none).count() == 0
    long = spark.createDataFrame([(1, "word another, third. " * 200_000 + MIT)], "doc_id long, text string")
    assert licenses.scan(long).first().licences == "MIT"


# --- 4 quality, 10 toxicity ------------------------------------------------------------------------------------------


def test_quality_ranks_held_out_documents(spark) -> None:  # noqa: ANN001
    d, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(d, quality.fit(d, marks)).join(marks, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])


def test_toxicity_of_held_out_documents(spark) -> None:  # noqa: ANN001
    d, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(d, toxicity.fit(d, marks)).join(marks, "doc_id").filter("held_out").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.7 and (1 - got.predicted[got.toxic == 0]).mean() > 0.98
    assert got.score[got.toxic == 1].median() > got.score[got.toxic == 0].quantile(0.95)


def test_window_lengths_match_brute_force() -> None:
    """Differences and numbers of a text, from compressors made anew for each window."""
    import zstandard

    rng = np.random.default_rng(6)
    toxic, ordinary = [f"{words_of(rng, 20)} Vilest, {words_of(rng, 9)} rotten!" for _ in range(60)], [words_of(rng, 40) for _ in range(120)]
    plain, bad = toxicity.dictionaries(toxic, ordinary)
    assert b"vilest" in bad and b"vilest" not in plain

    def length(window: bytes, content: bytes) -> int:
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for text in [toxic[0], ordinary[0], "", "x" * 1000 + " vilest", None]:
        words = [w.strip(b"!,") for w in (text or "").lower().encode().split()]
        words = [w[i : i + 64] for w in words for i in range(0, len(w), 64)] or [b""]
        x = sorted((length(bytes(range(128, 136)) + b" " + w + b" ", plain) - length(bytes(range(128, 136)) + b" " + w + b" ", bad) for w in words), reverse=True)
        kinds = list({w: length(bytes(range(128, 136)) + b" " + w + b" ", plain) - length(bytes(range(128, 136)) + b" " + w + b" ", bad) for w in words}.values())
        many = [sum(v >= 1 for v in x), sum(v >= 4 for v in x), sum(v >= 1 for v in kinds), sum(v >= 3 for v in kinds)]
        want = [x[0], sum(x[:3]) / len(x[:3]), *(min(n, 8) for n in many), min(sum(v for v in x if v > 0), 40), many[0] / len(x), np.log(len(x))]
        assert toxicity.Distance(plain, bad)(text) == pytest.approx(want)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_odd(odd, none, labels, op):  # noqa: ANN001, ANN201
    for marks in (labels, labels.limit(0)):
        got = op.score(odd, op.fit(odd, marks)).toPandas()
        assert len(got) == len(ROWS) and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert op.score(none, op.fit(none, labels)).count() == 0


def test_bradley_terry_orders_pairs() -> None:
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] - 2 * x[:, 1] > 0
    w, t = quality.bradley_terry(x, good, pairs=20_000)
    assert ((x @ w > t) == good).mean() > 0.95
    assert not quality.bradley_terry(x, np.ones(400, bool))[0].any()


# --- 5 packing -------------------------------------------------------------------------------------------------------


def check_packing(d: pd.DataFrame, texts: list[tuple], most: int = 2048) -> None:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first, s, piece = len(ids) % most or most, 0, 0
        while s < len(ids):
            n = first if piece == 0 else most
            want[i, piece, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
            s, piece = s + n, piece + 1
    assert Counter(zip(d.doc_id.astype(object).where(d.doc_id.notna(), None), d.piece, d.start, d.length, d.ids_crc32, strict=True)) == want
    for _, g in d.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= most


def test_packing(spark, docs):  # noqa: ANN001, ANN201
    d = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), tokenizer_path()).toPandas()
    check_packing(d, list(zip(docs.doc_id, docs.text, strict=True)))
    assert d.sequence_id.nunique() <= -(-d.length.sum() // 2048) + 1


def test_packing_odd(odd, none):  # noqa: ANN001, ANN201
    d = packing.pack(odd, tokenizer_path(), with_ids=True).toPandas()
    assert all(len(x) == n for x, n in zip(d.ids, d.length, strict=True))
    check_packing(d, [(r[0], r[1]) for r in ROWS])
    assert packing.pack(none, tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tab.,'s1é你", max_size=60))
def test_words_encode_as_the_tokenizer(text: str) -> None:
    words = packing._encoder(tokenizer_path())
    assert words.encode([text])[0] == words.whole(text)


def test_ranks_of_another_vocabulary_are_not_used(tmp_path):  # noqa: ANN001, ANN201
    from pathlib import Path

    own = Path(tokenizer_path())
    (tmp_path / own.name).write_bytes(own.read_bytes())
    lines = own.with_suffix(".tiktoken").read_bytes().splitlines()
    (tmp_path / own.with_suffix(".tiktoken").name).write_bytes(b"\n".join(lines))
    assert packing.Words(str(tmp_path / own.name)).ranked is not None
    ids = [x.split()[1] for x in lines]
    (tmp_path / own.with_suffix(".tiktoken").name).write_bytes(b"\n".join(x.split()[0] + b" " + i for x, i in zip(lines, ids[1:] + ids[:1], strict=True)))
    assert packing.Words(str(tmp_path / own.name)).ranked is None


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_pack_plan_covers_exactly(counts: dict[int, int]) -> None:
    plan, used = packing.pack_plan(counts, 64, rounds=40), Counter()
    for p, n in plan:
        assert sum(p) <= 64
        used.update({x: k * n for x, k in Counter(p).items()})
    assert used == Counter(counts)


@pytest.mark.parametrize("times", [1, 300])
def test_pack_plan_is_as_tight_for_many_pieces(times: int) -> None:
    lengths = np.clip(np.random.default_rng(5).lognormal(6, 1, 4000), 1, 2047).astype(int)
    counts = {int(x): int(n) * times for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan, used = packing.pack_plan(counts), Counter()
    for p, n in plan:
        assert sum(p) <= 2048
        used.update({x: k * n for x, k in Counter(p).items()})
    assert used == Counter(counts)
    assert sum(n for _, n in plan) <= 1.001 * -(-sum(x * n for x, n in counts.items()) // 2048) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_best_fit_of_counts_is_that_of_pieces(counts: dict[int, int]) -> None:
    rooms: list[int] = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = min((i for i, r in enumerate(rooms) if r >= x), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(64 - x)
        else:
            rooms[at] -= x
    assert sum(packing.best_fit(counts, 64).values()) == len(rooms)


# --- 6 mixing --------------------------------------------------------------------------------------------------------


def test_targets_reshare_the_excess() -> None:
    got = mixing.source_targets({"a": 100, "b": 1, None: 10, "c": 50})
    assert got["b"] == 3 and got["a"] + got["c"] + got[None] + 3 == pytest.approx(161)
    assert got[None] == pytest.approx(158 / 5) or got[None] == 30


def test_split_quotas_are_exact() -> None:
    q = np.array([5, 0, 17, 100])
    s = mixing.split_quotas(q, 7, 3)
    assert (s.sum(axis=0) == q).all() and s.sum(axis=1).max() - s.sum(axis=1).min() <= 3 and (s == mixing.split_quotas(q, 7, 3)).all()


def check_draws(d: pd.DataFrame, most: int = 3) -> None:
    """Against brute force: sizes, targets, words taken, and how many blocks each shard draws of each source."""
    d = d.assign(source=d.source.astype(object).where(d.source.notna(), None))
    assert (d["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in d.text]).all()
    sizes = defaultdict(int)
    for s, n in zip(d.source, d["size"], strict=True):
        sizes[s] += int(n)
    want = mixing.source_targets(sizes)
    taken, cut, shard_of = Counter(), Counter(), defaultdict(set)
    for r in d.itertuples():
        passes = [x["pass"] for x in r.draws]
        assert len(set(passes)) == len(passes) <= most and r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        for x in r.draws:
            taken[r.source] += x["words"]
            cut[r.source] += x["words"] < r.size
            shard_of[r.source, x["pass"], x["block"]].add(x["shard"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 and cut[s] <= 1, (s, taken[s], want[s])
        quota, quotas = next((r.quota, r.quotas) for r in d.itertuples() if r.source == s or (s is None and r.source is None))
        drawn = Counter(next(iter(x)) for (t, _, _), x in shard_of.items() if t == s)
        assert all(len(x) == 1 for x in shard_of.values()) and sum(quotas) == quota
        empty = quota - sum(drawn.values())  # blocks without a document
        assert empty >= 0 and all(drawn[i] <= q for i, q in enumerate(quotas))
        if (d.source == s).sum() > 6000:
            assert empty == 0 and all(drawn[i] == q for i, q in enumerate(quotas))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    parted = mixing.split_quotas(np.array([next(r.quota for r in d.itertuples() if r.source == s or (s is None and r.source is None)) for s in order]), 16, 7)
    for i, s in enumerate(order):
        assert list(parted[:, i]) == list(next(r.quotas for r in d.itertuples() if r.source == s or (s is None and r.source is None)))
    assert parted.sum(axis=1).max() - parted.sum(axis=1).min() <= 4


def flat(df) -> pd.DataFrame:  # noqa: ANN001
    return df.select("doc_id", "source", "text", "drawn.*").toPandas()


def test_mixing_meets_targets(spark):  # noqa: ANN001, ANN201
    base = spark.read.parquet(f"{SF}/documents.parquet")
    d = flat(mixing.draws(base))
    check_draws(d)
    got = QUERIES["op6_mixing_to_weights"](spark, SF).toPandas().sort_values("doc_id")
    assert got.taken.tolist() == [sum(x["words"] for x in r) for r in d.sort_values("doc_id").draws]
    mixed = mixing.mix(base).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).toPandas()
    assert got[got.taken > 0].set_index("doc_id").taken.to_dict() == mixed[mixed.n > 0].set_index("doc_id").n.to_dict()


def test_mixing_draws_whole_quotas_of_blocks(spark):  # noqa: ANN001, ANN201
    rows = [(i, "a" if i % 5 else "b", "w " * (i % 7 + 1)) for i in range(40_000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = flat(mixing.draws(d))
    check_draws(one)
    other = flat(mixing.draws(d.repartition(7, "text")))
    key = lambda x: sorted((r.doc_id, str(list(r.draws))) for r in x.itertuples())
    assert key(one) == key(other)


def test_mixing_of_repeated_and_null_ids(spark, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "a", "one two three four five six seven eight nine ten")] * 200 + [(5, "b", "x y z")] * 300 + [(i, "c", "p q r s t") for i in range(900)] + [(None, None, f"t{i} u") for i in range(250)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = flat(mixing.draws(d))
    assert len(got) == len(rows)
    check_draws(got)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    check_draws(flat(mixing.draws(d)))
    assert Counter(str(list(x)) for x in got.draws) == Counter(str(list(x)) for x in flat(mixing.draws(d.coalesce(1))).draws)


def test_mixing_odd(odd, none):  # noqa: ANN001, ANN201
    check_draws(flat(mixing.draws(odd)))
    odd = odd.withColumnsRenamed({"size": "drawn", "fp": "unit", "shard": "copy", "h": "draw", "lines": "plan"})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0 and mixing.mix(none).count() == 0
    with pytest.raises(ValueError, match="drawn"):
        mixing.draws(odd)


# --- 7 fingerprints --------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs):  # noqa: ANN001, ANN201
    got = lcp.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet"), parts=5).toPandas().sort_values("doc_id")
    texts = docs.sort_values("doc_id").text.tolist()
    changed = [lcp.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    alone = np.concatenate([lcp.fingerprints([t]) for t in texts])
    assert got.fingerprint.tolist() == lcp.as_hex(alone) and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.near_edited.mean() > 0.25 and got.near_next.median() < 0.05


def test_next_of_ids_of_any_type_and_spread(spark):  # noqa: ANN001, ANN201
    """Against a plain loop in order of ids: text ids, one far id, equal and null ids."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdef gh"), 90)) for _ in range(300)]
    far = [(10**15 if i == 7 else i - 150, t) for i, t in enumerate(texts)]
    named = [(f"https://example.org/{i:05d}", t) for i, t in enumerate(texts)]
    same = [(3, t) for t in texts[:200]] + [(None, t) for t in texts[200:]]
    for rows, kind in ((far, "long"), (named, "string"), (same, "int")):
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        dealt = lcp.with_next(df, 8).filter("not head").groupBy("bucket").count().toPandas()
        assert len(dealt) == 8 and dealt["count"].max() < 100
        mark = {r.text: r.m for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, mark[r[1]]))
        want = Counter((i, hashlib.sha256(lcp.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
        assert Counter((r.doc_id, r.edited_sha256) for r in lcp.fingerprint_documents(df, parts=8).collect()) == want


def brute_phrases(x: list[int], level: int) -> list[int]:
    """One level of parsing, symbol by symbol."""
    mask, mix = 2**64 - 1, lambda v: int(lcp._mix(np.array([v & (2**64 - 1)], np.uint64))[0])
    runs: list[list[int]] = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    x = [v if n == 1 else mix(v + n * 0x9E3779B97F4A7C15) for v, n in runs]
    lab = x
    for _ in range(lcp.ROUNDS):
        before = [~lab[0] & mask, *lab[:-1]]
        low = [(a ^ b) & -(a ^ b) for a, b in zip(lab, before, strict=True)]
        lab = [2 * (d.bit_length() - 1) + (a & d != 0) for a, d in zip(lab, low, strict=True)]
    cuts = [i for i in range(len(x)) if i == 0 or (1 < i + 1 < len(x) and lab[i] > lab[i - 1] and lab[i] > lab[i + 1])]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
        out.append(mix(sum(v * int(lcp._POWERS[min(i, 63)]) for i, v in enumerate(x[a:b])) + level))
    return out


def test_fingerprints_match_brute_force() -> None:
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abc dé\n"), n)) for n in (0, 1, 2, 3, 40, 700)] + ["aaaa" * 50, "ab" * 300]
    got = lcp.fingerprints(texts)
    for t, row in zip(texts, got, strict=True):
        x, names, level = [int(v) for v in lcp._mix(np.array([ord(c) + 1 for c in t], np.uint64))], [], 0
        while x:
            level += 1
            x = brute_phrases(x, level)
            if level >= 2:
                names += x
                if len(x) == 1:
                    break
        want = [lcp.EMPTY] * lcp.BINS
        for b in range(lcp.BINS):
            mine = [v >> 6 for v in names if v % lcp.BINS == b]
            if mine:
                want[b] = int(lcp._mix(np.array([min(mine)], np.uint64))[0]) % lcp.EMPTY
        assert row.tolist() == want


def test_substrings_share_phrases() -> None:
    rng = np.random.default_rng(2)
    body = "".join(rng.choice(list("abcdefghij klmno"), 4000))
    a, b = lcp.fingerprints(["x" * 7 + body, "completely different start " + body])
    assert lcp.likeness(a, b) > 0.8 and lcp.likeness(a, a) == 1 and lcp.likeness(*lcp.fingerprints(["", ""])) == 1


def test_fingerprints_odd(odd, none):  # noqa: ANN001, ANN201
    d = lcp.fingerprint_documents(odd, parts=3).toPandas()
    assert len(d) == len(ROWS) and d.near_edited.between(0, 1).all() and lcp.fingerprint_documents(none).count() == 0
    by = d.dropna(subset=["doc_id"]).groupby("doc_id").fingerprint.first()
    assert by[1] == by[2] and by[3] == by[4] and by[1] != by[8]


# --- 8 nearest neighbours --------------------------------------------------------------------------------------------


def test_walk_is_in_order() -> None:
    rng = np.random.default_rng(4)
    a, b, held = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    sums = (a[:, None] + b).ravel()
    want = [i for i in sums.argsort() if held[i]]
    assert ann.walk(a, b, held, 10**9) == want and ann.walk(a, b, held, 5) == want[: len(ann.walk(a, b, held, 5))]


def test_search_recall_and_scores(spark):  # noqa: ANN001, ANN201
    e = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = QUERIES["op8_nearest_neighbours"](spark, "/root/testdata/sf0.01").toPandas()
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = e.vec_id.to_numpy()
    hits = n = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        top = set(ids[np.lexsort((ids, -s))[:5]])
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        hits, n = hits + len(top & set(mine.vec_id)), n + 5
    assert hits / n >= 0.9


def test_index_recall_on_clustered_vectors(spark):  # noqa: ANN001, ANN201
    """10,000 vectors around 200 centres: candidates are under a tenth of them, and recall is 0.9 or more."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 32))[rng.integers(0, 200, 10_000)] + 0.35 * rng.normal(size=(10_000, 32))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c1, c2 = ann.kmeans(u[:, :16], 256), ann.kmeans(u[:, 16:], 256)
    assert ann.enough_share(u, c1, c2, 5) < 0.1
    v = spark.createDataFrame(pd.DataFrame({"vec_id": range(10_000), "embedding": [r.tolist() for r in x]}), "vec_id long, embedding array<float>")
    got = ann.search(v, v.filter("vec_id % 50 = 0"), share=0.1).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for i in range(0, 10_000, 50):
        s = u @ u[i]
        s[i] = -9
        hits += len(got[i] & set(np.lexsort((np.arange(10_000), -s))[:5].tolist()))
    assert hits / 1000 >= 0.9


def test_multiples_of_a_vector_tie(spark):  # noqa: ANN001, ANN201
    base = np.random.default_rng(8).normal(size=24)
    rows = [(0, base.tolist()), *[(i, (base * f).tolist()) for i, f in enumerate([3.7, 0.1, 11.3, 7e-5, 123.4, 2.2, 0.33, 5e6, 1 / 3, 9.9], 1)], (50, [1.0, 2.0]), (51, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(v, v.filter("vec_id in (0, 50)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 51] and got[-1].score == pytest.approx(0.8)


def test_search_odd(spark):  # noqa: ANN001, ANN201
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, []), (10, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    got = ann.search(v, v.filter("vec_id in (0, 5)")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    got = ann.search(many, many.filter("vec_id = 2")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 3, 4, 5]


# --- 9 sharding ------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs):  # noqa: ANN001, ANN201
    d = QUERIES["op9_kd_sharding"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert (d["size"] == [len(t.encode()) + 1 for t in d.text]).all() and (d.text_crc32 == [zlib.crc32(t.encode()) for t in d.text]).all()
    load = d.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(16)) and load.max() < 1.15 * load.mean()
    assert (d.groupby("text").shard.nunique() == 1).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in d.groupby("shard"))


def test_tree_places_groups_and_evens_large_ones(spark):  # noqa: ANN001, ANN201
    """Small documents of a source stay together as medians split them; sources of one long prefix are told apart."""
    rng = np.random.default_rng(5)
    rows = [(i, words_of(rng, 3), f"https://example.org/site{i % 4}", "en") for i in range(3000)]
    d = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 4).toPandas()
    d["source"] = [rows[i][2] for i in d.doc_id]
    assert d.groupby("shard").source.nunique().max() <= 2 and d.groupby("shard")["size"].sum().max() < 1.01 * d["size"].sum() / 4
    load, moves = [100, 10, 10], [(0, 30, "a"), (0, 29, "b"), (0, 41, "c")]
    got = sharding._evened(load, moves)
    new = [100 - sum(w for _, w, g in moves if g in got), 10, 10]
    for _, w, g in moves:
        if g in got:
            new[got[g]] += w
    assert max(new) <= 51
    some = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), target_bytes=2000).toPandas()
    assert some.shard.nunique() >= 25 and some.groupby("shard")["size"].sum().max() < 1.1 * 2000


def test_sharding_odd(odd, none):  # noqa: ANN001, ANN201
    d = sharding.kd_shards(odd, 4).toPandas()
    assert len(d) == len(ROWS) and all(sorted(g.slot) == list(range(len(g))) for _, g in d.groupby("shard"))
    assert d[d.doc_id.isin([1, 2])].shard.nunique() == 1 and sharding.kd_shards(none, 4).count() == 0
    assert sharding.kd_shards(odd, target_bytes=300_000).toPandas().shard.max() <= 3


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):  # noqa: ANN001, ANN201
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    one = corpus_pipeline.STAGES[0][1](spark, base, SF)
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    assert one.join(marks.filter("quality = 0"), "doc_id").count() <= 1 and one.columns == base.columns
    assert one.join(marks.filter("quality = 1"), "doc_id").count() >= 0.97 * base.join(marks.filter("quality = 1"), "doc_id").count()
    d = corpus_pipeline.run(spark, SF).toPandas()
    assert (d.groupby("sequence_id").length.sum() <= 2048).all() and len(d)
