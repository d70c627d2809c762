import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from parcela.llm import warc as w


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def brute(rows):
    first = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, k), k)
    copies = {h: sum(h == x for _, _, x in rows) for h in first}
    out = []
    for k, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if copies.get(h, 0) > 1 and k != first.get(h) else None
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/b c\r\nX: y", "é" * 500), (2, None, "é" * 500), (3, "http://ü/", "é" * 500), (4, "u", "short"), (5, "u", "short"), (6, "", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (None, "u", "é" * 500), (10, "u", "z" * 300_000), (10, "u", "z" * 300_000), (11, "u", "WARC/1.1\r\n\r\nx: y\r\n" * 90)]


def test_records_come_back(spark):
    got = w.archived(pages(spark, ROWS), with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)
    for r in got:
        assert r.record_type == "revisit" or bytes(r.payload).decode() in {(h or "") for _, _, h in ROWS}
        assert "\n" not in r.url and " " not in r.url


def test_archives_are_warc(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    index = w.write_archives(w.with_types(pages(spark, ROWS)), path, archive_bytes=800)
    assert index.select("file").distinct().count() > 1
    for name in (r.file for r in index.select("file").distinct().collect()):
        data, n = (tmp_path / "a" / name).read_bytes(), 0
        while data:
            gzip = zlib.decompressobj(31)
            raw = gzip.decompress(data)
            data = gzip.unused_data
            head, http, payload = w.parsed(raw)
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and head["warc-record-id"].startswith("<urn:uuid:")
            assert head["warc-type"] == "revisit" or int(http["content-length"]) == len(payload)
            n += 1
        assert n == index.where(f"file = '{name}'").count()
    some = w.read_records(index.where("page_id in (4, 10)"), path).collect()
    assert sorted(r.page_id for r in some) == [4, 10, 10]


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), max_size=20), st.integers(0, 30), st.integers(1, 60))
def test_reads_cover_the_ranges(steps, gap, most):
    ranges, at = [], 0
    for skip, length in steps:
        ranges.append((at + skip, length))
        at += skip + length
    reads, k = list(w.coalesced(ranges, gap, most)), 0
    for begin, length, n in reads:
        own = ranges[k : k + n]
        assert own[0][0] == begin and own[-1][0] + own[-1][1] == begin + length and (n == 1 or length <= most)
        assert all(b[0] - a[0] - a[1] <= gap for a, b in zip(own, own[1:], strict=False))
        k += n
    assert k == len(ranges)


def test_empty_table(spark):
    assert w.archived(pages(spark, [])).collect() == []


@pytest.mark.parametrize(("url", "safe"), [(None, "urn:page:5"), ("", "urn:page:5"), ("a b\n", "a%20b%0A")])
def test_urls(url, safe):
    assert w.safe_url(url, 5) == safe
