import re
import textwrap
from pathlib import Path

import duckdb
import pytest

from parcela.llm import license_scan as s


def found(documents, texts):
    rows = s.licensed(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    return {r.doc_id: r for r in rows}


VARIANTS = [
    "MIT License\n\nCopyright (c) 2020 Someone, Inc.\n\n" + s.MIT,
    "\n".join(f"# {line}" for line in textwrap.wrap(s.MIT.upper(), 60)),
    "© 2001 A\nAll rights reserved.\n" + s.MIT.replace('"Software"', "“Software”").replace("sublicense", "sub-licence"),
    "\n".join((s.BSD_HEAD, s.BSD_THIRD, s.BSD_TAIL)).replace("copyright holder", "Copyright Owner"),
    s.ZLIB.replace("acknowledgment", "acknowledgement"),
    "Licensed  under the Apache Licence, version 2.0",
]


def test_whole_texts(documents):
    got = found(documents, VARIANTS)
    assert [got[i].license for i in range(len(VARIANTS))] == ["MIT", "MIT", "MIT", "BSD-3-Clause", "Zlib", "Apache-2.0"]


def test_other_texts_match_nothing(documents):
    got = found(documents, [s.MIT + " More.", "", "MIT", s.MIT[:200], "copyright holders are listed here"])
    assert all(r.license is None and r.line_licenses == "" for r in got.values())


def test_lines(documents):
    got = found(documents, ["Some text.\n  Released under the MIT licence.\nx\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License", "Released under the MIT License. And more."])
    assert (got[0].line_licenses, got[1].line_licenses) == ("CC-BY-NC-4.0,MIT", "")


def test_same_as_sql(documents, odd_documents, tmp_path):
    odd_documents.union(documents([(20 + i, t, "en", "a") for i, t in enumerate(VARIANTS)])).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(s.licensed_sql()).fetchall()
    docs = odd_documents.sparkSession.read.parquet(str(tmp_path / "d"))
    got = s.licensed(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(documents):
    assert s.licensed(documents([])).collect() == []


@pytest.mark.parametrize(
    ("text", "dropped"),
    [("Copyright 2020 X", True), ("(c) 2020 X", True), ("Copyright X", True), (" * Copyright by X 2024", True), ("X Corp. All rights reserved.", True), ("Copyright holders may", False), ("see copyright 2020", False), ("(c) You must keep", False), ("copyright notice, this list", False)],
)
def test_copyright_lines(documents, text, dropped):
    row = documents([(1, text + "\na", "en", "a")]).select(s.canonical(s.F.col("text")).alias("c")).first()
    assert (row.c == "a") == dropped and "held" not in row.c


def test_texts_from_files(documents):
    files = sorted((Path(__file__).parent / "texts").glob("*.txt"))
    got = found(documents, [f.read_text() for f in files] + [f.read_text().replace("\n", "\r\n").upper() for f in files])
    assert [got[i].license for i in range(2 * len(files))] == [f.stem for f in files] * 2 and len(files) > 1


def test_line_ends_dont_matter(documents):
    """Whole licences, every paragraph wrapped at many widths; lines that state a copyright stay as they are."""
    texts, want = [], []
    for file in sorted(s.FILES.glob("*.txt")):
        blocks = re.split(r"\n\s*\n", file.read_text())
        for width in (44, 60, 71, 77, 90):
            wrap = lambda b, width=width: b if re.search(r"(?im)^\W*(portions )?copyright\W+(\(c\)|[0-9\[<{])|all rights reserved", b) else "\n".join(textwrap.wrap(b, width))
            texts.append("\n\n".join(map(wrap, blocks)))
            want.append(file.stem)
    got = found(documents, texts)
    assert [got[i].license for i in range(len(texts))] == want
