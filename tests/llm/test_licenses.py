"""Known texts in their variants, and notices."""

from __future__ import annotations

import os
import textwrap

from fieldbook.llm import licenses
from fieldbook.llm.license_digests import DIGESTS
from fieldbook.llm.license_texts import LICENSES


def test_variants_of_whole_texts(spark):
    mit = LICENSES["MIT"][0]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;").replace("\n\n", "\r\n")),
        (3, mit.replace("MIT License\n\n", "MIT Licence\n\nCopyright 1999 A, B\n(c) others. All rights reserved.\n\n")),
        (4, mit + "and more"),
        (5, LICENSES["BSD-3-Clause"][1].replace("liability", "liability -")),
        (6, LICENSES["ISC"][1]),
        (7, "text\nReleased under the MIT licence!\n  LICENSED under CC BY-NC 4.0\nReleased under the MIT License."),
        (8, None), (9, ""), (None, "..."), (1, mit),
    ]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license_id", "1 AS digest")).collect()
    found = {r.doc_id: r for r in got}
    assert [found[k].license_id for k in (1, 2, 3, 4, 5, 6, 7, 9)] == ["MIT", "MIT", "MIT", None, "BSD-3-Clause", "ISC", None, None]
    assert len(got) == len(rows)
    assert (found[7].n_notices, found[7].notice_ids) == (3, "CC-BY-NC-4.0,MIT")
    assert found[8].text_digest is None and found[9].text_digest == found[None].text_digest
    assert found[8].n_notices == 0 and found[8].notice_ids == ""


def test_driver_and_columns_agree(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts) if t is not None] + [(1000 + k, x) for k, x in enumerate(t for ts in LICENSES.values() for t in ts)]
    got = {r.doc_id: r.text_digest for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: licenses.digest(t) for k, t in rows}


def test_empty_table(no_docs):
    assert licenses.license_scan(no_docs).collect() == []


def wrapped(text: str, width: int) -> str:
    """The paragraphs of a text, wrapped as licence files are."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def test_wraps_do_not_matter(spark):
    rows, want = [], {}
    for name, texts in LICENSES.items():
        for text in texts:
            for width in range(20, 101):
                assert licenses.digest(wrapped(text, width)) == licenses.digest(text), (name, width)
                if width in (40, 72, 76, 80):
                    want[len(rows)] = name
                    rows.append((len(rows), "Copyright (c) 2020 A Body\nCopyright The Owners\n\n" + wrapped(text, width)))
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in found} == want


def test_a_wrapped_body_line_is_no_statement():
    lines = "provided that the above\ncopyright notice appear", "THE AUTHORS OR\nCOPYRIGHT HOLDERS BE LIABLE", "retain the above\ncopyright \nnotice", "(b) that\n(c) You must retain"
    for text in lines:
        assert licenses.digest(text) == licenses.digest(" ".join(text.split()))
    for statement in ("Copyright 1999 A", "copyright (C) A", "Copyright: A", "Copyright A Company", "(c) others", "© 2000 A", "All rights reserved."):
        assert licenses.digest(f"text\n{statement}\nmore") == licenses.digest("text more"), statement


def test_long_licenses_and_gnu_notices(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [n for n in names if os.path.exists(f"{folder}/{n}")]
    texts = {n: open(f"{folder}/{n}", encoding="utf-8").read() for n in there}
    lines = {
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1-only",
        "Released under the GNU Affero General Public License, version 3 or later.": "AGPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    }
    rows = [*texts.items(), *[(k, k) for k in lines]]
    found = {r.name: r for r in licenses.license_scan(spark.createDataFrame(rows, "name string, text string"), "name").collect()}
    assert {n: found[n].license_id for n in texts} == {n: names[n] for n in texts}
    assert {k: found[k].notice_ids for k in lines} == lines
    assert licenses.digest(texts["Apache-2.0"].split("   APPENDIX")[0]) in DIGESTS["Apache-2.0"]


def test_spellings_side_by_side(spark):
    text = "authorised authorised use, sub-licence sub licence: per cent per cent per cent\nwhilst\nwhilst"
    want = "authorized authorized use sublicense sublicense percent percent percent while while"
    assert licenses.canonical_form(text).split() == want.split()
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text_digest == licenses.digest(want) == licenses.digest(text)


def test_a_long_text_of_many_lines_and_a_large_table_of_licences(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_KNOWN", 1)
    mit = LICENSES["MIT"][0]
    rows = [(1, "one line\n" * 200_000 + "Released under the MIT License."), (2, mit), (3, mit + "\n" * 100_000)]
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].license_id, found[1].n_notices) == (None, 1)
    assert found[2].license_id == found[3].license_id == "MIT"
