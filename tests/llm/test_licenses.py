"""Whole licence texts as they are published, and what must not be taken for a copyright line."""

import textwrap
from pathlib import Path

import duckdb
import pytest

from venation.llm import licence_texts, licenses

SHORT = {k: v[0] for k, v in licence_texts.LICENCES.items() if not k.endswith("notice") and k != "All-rights-reserved"}


def published(name, text):
    """As files print it: title, copyright lines, wrapped text, a margin."""
    title = licence_texts.TITLES.get(name, [""])[0]
    body = textwrap.fill(text.replace("acknowledgment", "acknowledgement"), 78, initial_indent="  ", subsequent_indent="  ")
    return f"{title}\n\nCopyright (c) 2019-2021, Some Body <a@b.org>\nAll rights reserved.\n© 2022 Others\n\n{body}\n"


def test_published_forms_are_found(spark):
    rows = [(i, published(k, v), "x") for i, (k, v) in enumerate(SHORT.items())]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string"), licenses.known(spark)).collect()}
    assert got == dict(enumerate(SHORT))


def test_operative_lines_that_begin_with_the_word_stay():
    lines = ["copyright notice and this permission notice appear in all copies", "copyright holders be liable", "copyright owner or entity", "Copyrights apply"]
    for line in lines:
        assert licenses.canonical(f"a\n{line}\nb".encode()) == f"a {line.lower()} b".replace("copyright owner", "copyright holder").encode()
    for line in ["Copyright (c) 2020 A", "(C) 1999 B", "Copyright 2011 C", "copyright by D", "© E", "  # Copyright © 2020", "Copyright <YEAR> <HOLDER>"]:
        assert licenses.canonical(f"a\n{line}\nb".encode()) == b"a b"


def test_spellings_are_whole_words():
    assert licenses.canonical(b"an organism organises Licence, LICENCE sub-licence") == b"an organism organises license license sublicense"


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause")])
def test_long_texts_by_digest(file, name):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no such text on this machine")
    text = path.read_text()
    assert licenses.known_digests()[licenses.digest(text.replace("\n", "\r\n   ").upper())] == name


def test_query_against_sql_on_planted_and_odd_rows(spark):
    rows = [(1, published("MIT", SHORT["MIT"])), (1, SHORT["ISC"]), (2, None), (3, ""), (4, " .\n"), (None, "All rights reserved.\nProse"), (5, "licence licence\nLicenced under the MIT Licence"), (5, "licence licence\nLicenced under the MIT Licence"), (6, "Copyright (c) 2020\nall rights reserved\nx"), (7, "word " * 50000 + "\nReleased under the MIT License.")]
    got = licenses.scan(spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, row long, notices string"), licenses.known(spark)).collect()
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, db.sql(licenses.SQL).fetchall()))
    assert {r["licence"] for r in got} == {"MIT", "ISC", None}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), licenses.known(spark)).count() == 0
