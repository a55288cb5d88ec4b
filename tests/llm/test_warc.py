"""The WARC source: round trips, predicates, skipped payloads, commits, files of other writers, pages against a plain version."""

import gzip
import hashlib

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tallgrass.llm import warc

PAGES = [
    (1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "http://a/4", "x" * 99), (5, "u\r\nWARC-Type: bad", None), (6, "u", ""), (None, "n", "é" * 50),
    (8, "http://b/8", "é" * 50), (7, "http://b/7", "é" * 50), (7, "http://b/7", "é" * 50), (9, "r", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9), (10, "long", "lorem <b>ipsum</b> " * 120_000),
    (None, "m", "only nulls " * 20), (None, "m2", "only nulls " * 20),
]


def plain(rows):
    least, out = {}, []
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    for i, _, h in rows:
        b, first = (h or "").encode(), least.get(h or "")
        again = len(b) >= 100 and first is not None and first != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, record_type string, n int").repartition(3)


def test_archived_pages(spark, pages, tmp_path):
    got = warc.archived_pages(pages, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(PAGES)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        if r.record_type == "revisit":
            assert r.payload == b"" and by_id[r.refers_to].record_type == "response" and by_id[r.refers_to].payload_digest == r.payload_digest
            assert r.http_headers["Content-Length"] == str(len(by_id[r.refers_to].payload)) and r.refers_to_uri == by_id[r.refers_to].target_uri
    assert warc.archived_pages(pages.filter("page_id < 0"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_roll_and_plan_by_size(spark, pages, tmp_path, compression):
    folder = str(tmp_path / "w")
    warc.register(spark)
    warc.page_records(pages).repartition(2).write.format("warc").option("compression", compression).option("file_bytes", 2000).mode("append").save(folder)
    names = [n for n, _ in warc.archives(folder)]
    assert len(names) > 2
    read = lambda **o: spark.read.format("warc").options(**o).load(folder)
    assert read(task_bytes="1").rdd.getNumPartitions() == len(names) and read().rdd.getNumPartitions() == 1
    for r in read(task_bytes="1").filter("record_type = 'response'").collect():
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest.removeprefix("sha256:")
    if compression == "gzip":  # other readers see plain gzip members
        with gzip.open(names[0]) as f:
            assert f.read().count(b"WARC-Record-ID") >= 1


def test_predicates_reach_the_source(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    warc.archived_pages(pages, folder).count()
    df = warc.read_warc(spark, folder)
    whole = df.collect()
    for sql, keep in [
        ("record_type = 'revisit'", lambda r: r.record_type == "revisit"), ("record_type IN ('revisit', 'warcinfo')", lambda r: r.record_type in ("revisit", "warcinfo")),
        ("target_uri LIKE 'http://a%'", lambda r: (r.target_uri or "").startswith("http://a")), ("NOT target_uri LIKE 'http://a%'", lambda r: r.target_uri is not None and not r.target_uri.startswith("http://a")),
        ("refers_to IS NULL AND content_length > 150", lambda r: r.refers_to is None and r.content_length > 150), ("target_uri <=> NULL", lambda r: r.target_uri is None),
        ("target_uri < 'http://b'", lambda r: r.target_uri is not None and r.target_uri < "http://b"), ("headers['X-Page-Id'] = '8' OR record_type = 'warcinfo'", lambda r: r.headers.get("X-Page-Id") == "8" or r.record_type == "warcinfo"),
    ]:
        key = lambda r: (r.file, r.offset)
        assert sorted(map(key, df.filter(sql).collect())) == sorted(key(r) for r in whole if keep(r)), sql
    assert df.count() == len(whole)  # not by the predicates of a plan before
    plan = df.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")


def test_unwanted_payloads_are_not_inflated(spark, tmp_path, monkeypatch):
    names = str(tmp_path / "one.warc.gz")
    with open(names, "wb") as f:
        for i, kind in enumerate(["response", "metadata", "response"]):
            f.write(warc.member(warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<{i}>"), ("Content-Type", "text/plain")], bytes(i % 251 for i in range(3_000_000)))))
    read: list[int] = []
    whole = warc._Record.block
    monkeypatch.setattr(warc._Record, "block", lambda self: read.append(self.at) or whole(self))
    reader = warc.PushingReader({"path": names})
    assert list(reader.pushFilters([D.EqualTo(("record_type",), "metadata"), D.EqualTo(("file",), "x")])) == [D.EqualTo(("file",), "x")]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(map(len, batches)) == 1 and len(read) == 1
    seen = list(warc.records(fs.LocalFileSystem().open_input_file(names), names))
    assert len(seen) == 3 and all(len(r.plain) < 20_000_00 and r.read - r.at <= 4096 for r in seen)


def test_archives_of_other_writers(spark, tmp_path):
    """Members without their length, folded header lines, bare line feeds, blocks that aren't HTTP."""
    block = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\nbody"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nX-Long: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    two = b"WARC/1.0\nWARC-Type: resource\nContent-Length: 3\n\nabc\n\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "d/b.warc").write_bytes(one + two + one)
    rows = warc.read_warc(spark, str(tmp_path / "d")).collect()
    assert sorted((r.record_type, bytes(r.payload), r.http_status) for r in rows) == sorted([("resource", b"abc", None)] * 2 + [("response", b"body", 404)] * 3, key=str)
    assert {r.headers["X-Long"] for r in rows if r.record_type == "response"} == {"a b"}
    assert warc.read_warc(spark, str(tmp_path / "d"), payload=False).filter(F.col("http_status") == 404).count() == 3
    (tmp_path / "d/c.warc").write_bytes(one[:-30])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(tmp_path / "d")).collect()


def test_only_listed_files_count(spark, tmp_path):
    folder = str(tmp_path / "w")
    row = pa.RecordBatch.from_pylist([{"record_type": "resource", "record_id": "<1>", "payload": b"x"}])
    lost, kept, again = (warc.WarcWriter({"path": folder}, overwrite) for overwrite in (False, False, True))
    left = lost.write(iter([row]))  # an attempt that is never committed
    kept.commit([kept.write(iter([row])), None, kept.write(iter([]))])
    assert len(warc.archives(folder)) == 1
    lost.abort([left, None])
    again.commit([again.write(iter([row, row]))])
    assert len(warc.archives(folder)) == 1 and warc.read_warc(spark, folder).filter("record_type = 'resource'").count() == 2
