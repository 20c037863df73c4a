import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from lanternfish.llm import queries, warc


def brute(rows, least=1000):
    last = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            last[b] = max(last.get(b, i), i)
    for i, h in rows:
        b = (h or "").encode()
        to = last.get(b, i)
        yield i, len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op5_warc"](spark, sf).select(COLUMNS).collect())) == sorted(brute(rows))


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_splits_and_revisits(spark, tmp_path, split):
    long = "x é\r\n\r\nWARC/1.1" * 200
    rows = [(i, f"u\n{i}" if i % 3 else None, [long, "y" * 999, "z" * 1000, None, "", f"page {i} " * i][i % 6], 1) for i in range(40)] + [(39, "u", "q", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write(pages, f"file://{tmp_path}/w")
    assert sum(n for _, _, n in files) == len(rows)
    if split < 100:
        fs, _ = pafs.FileSystem.from_uri(files[0][0])
        for f, size, n in files:
            path = f.removeprefix("file://")
            found = [m for a in range(0, size, split) for m in warc.members(fs, path, a, a + split)]
            assert len(found) == n + 1
        return
    got = warc.read(spark, [f[:2] for f in files], split_bytes=split).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted((*b[:4], b[4] or 0) for b in brute([(r[0], r[2]) for r in rows]))
    assert all(r.payload == (dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode() for r in got if r.record_type == "response" and r.page_id != 39)
    for f, _, n in files:
        assert gzip.open(f.removeprefix("file://")).read().count(b"WARC-Type:") >= n


def test_false_magic_and_damage(tmp_path):
    fs = pafs.LocalFileSystem()
    one = warc._member(warc._record(1, "u", b"a" * 50, hashlib.sha1(b"a" * 50).hexdigest(), None, "d"), 6)
    two = warc._member(warc._record(2, "u", b"\x1f\x8b\x08" * 30, hashlib.sha1(b"\x1f\x8b\x08" * 30).hexdigest(), None, "d"), 0)
    (tmp_path / "f").write_bytes(b"junk\x1f\x8b\x08" + one + one[:-9] + gzip.compress(b"other") + two + two[:30])
    size = (tmp_path / "f").stat().st_size
    for split in (1, 5, size):
        found = [warc.parse(m)["page_id"] for a in range(0, size, split) for m in warc.members(fs, str(tmp_path / "f"), a, a + split)]
        assert found == [1, 2]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, f"file://{tmp_path}/e").count() == 0
