"""Archives written and read back, by splits that cut through records."""

import gzip
import hashlib

import pytest
from pyarrow import fs

from auditmill.llm import queries, warc
from auditmill.session import scratch_path
from tools.check import compare, connect

BIG = "<p>é" + "x" * 1200
ROWS = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (9, None, BIG), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u", None),
        (6, "u", ""), (None, "u", BIG), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (8, "u", "z" * 300_000), (10, "u", "WARC/1.1\r\n\r\n" * 200)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        last = max(same) if len(data) >= 1000 else page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if page == last else "revisit", None if page == last else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [137, 64 << 20])
def test_round_trip(pages, split):
    assert sorted(map(tuple, warc.round_trip(pages, split_bytes=split).collect()), key=str) == expected(ROWS)


def test_members_are_valid_records(spark, pages):
    archives = warc.write(pages, scratch_path(spark, "warc"), roll_bytes=500)
    rows = archives.collect()
    assert sum(r.records for r in rows) == len(ROWS) and len(rows) > 3
    for r in rows:
        store, name = fs.FileSystem.from_uri(r.path)
        data = gzip.decompress(store.open_input_stream(name, compression=None).read())
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID:") == r.records
    got = warc.read(spark, archives, 50).collect()
    assert sorted((r.target_uri or "" for r in got)) == sorted((u or "").replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in ROWS)


def test_damaged_and_false_members_are_passed_over(tmp_path):
    good = [warc.pack(i, "u", b"x" * 50, "d", None, False, "2000-01-01T00:00:00Z") for i in range(3)]
    data = good[0] + warc.MAGIC + b"junk" + good[1][:40] + good[2] + warc.MAGIC
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    found = []
    for start in range(0, len(data), 7):
        with fs.LocalFileSystem().open_input_file(str(path)) as f:
            found += [at for at, _ in warc.records(warc.Source(f, start), min(len(data), start + 7))]
    assert found == [0, data.index(good[2])]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op2_warc"](spark, sf), connect(sf), queries.ORACLES["op2_warc"]) is None


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
