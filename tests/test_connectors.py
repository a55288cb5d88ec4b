"""The register search, the event spool and the letters' sink."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallgrass.sources import search as Q
from tallgrass.sources import spool as P

from register_pages import CALLS


@pytest.fixture
def calls(tmp_path, monkeypatch):
    path = str(tmp_path / "calls")
    monkeypatch.setenv(CALLS, path)
    return path


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "register_pages.py"))


def asked(path):
    return sorted(open(path).read().split("\n"))[1:] if os.path.exists(path) else []


SHARDS = [(["62012"], "York"), (["62012"], "Leeds"), (["1"], "Hull")]


def test_shards_are_paged_to_their_end(calls):
    reader = Q.SearchReader({"fetch": "register_pages:pages", "shards": json.dumps([{"codes": c, "place": p} for c, p in SHARDS]), "page_size": "10"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    # Of 25 in York one has no number, one is gone, one is excluded and one comes twice; ten in Leeds fill a page, so that another is asked for.
    assert len([r for r in rows if r[7] == "York"]) == 21 and len([r for r in rows if r[7] == "Leeds"]) == 10
    assert asked(calls) == ["Hull 0 10", "Leeds 0 10", "Leeds 10 10", "York 0 10", "York 10 10", "York 20 10"]
    bare = [r for r in rows if r[0] == "York-7"][0]
    assert bare == ("York-7", "Firm 7", None, [], None, None, "", "York", 0)


def test_most_hits_and_the_last_offset(calls):
    options = {"fetch": "register_pages:endless", "shards": json.dumps([{"codes": ["1"], "place": "X"}]), "page_size": "1000"}
    take = lambda **o: list((r := Q.SearchReader(options | o)).read(r.partitions()[0]))
    assert len(take(max_hits="1500")) == 1500 and len(take(capped="keep")) == 10_000
    with pytest.raises(ValueError, match="part the shard"):
        take()


def test_busy_registers_are_asked_again(calls):
    options = {"fetch": "register_pages:flaky", "shards": json.dumps([{"codes": ["1"], "place": "X"}]), "page_size": "5", "wait": "0"}
    reader = Q.SearchReader(options | {"retries": "2"})
    assert len(list(reader.read(reader.partitions()[0]))) == 1
    os.remove(calls)
    reader = Q.SearchReader(options | {"retries": "1"})
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))


def test_predicates_leave_shards_out():
    from pyspark.sql import datasource as D

    reader = Q.PushingSearch({"fetch": "register_pages:pages", "shards": json.dumps([{"codes": c, "place": p} for c, p in SHARDS])})
    rest = list(reader.pushFilters([D.In(("place",), ("York", "Hull")), D.EqualTo(("number",), "x"), D.IsNotNull(("place",)), D.EqualTo(("shard",), 2)]))
    assert rest == [D.EqualTo(("number",), "x")] and [p.place for p in reader.partitions()] == ["Hull"]


def test_search_as_a_table(spark):
    df = Q.search_companies(spark, "register_pages:endless", [(["1"], "A"), (["2"], "B")], page_size="7", max_hits="20")
    assert df.count() == 40 and df.filter("place = 'B'").count() == 20 and df.count() == 40
    assert df.filter("place IN ('A') AND number = 'A-3'").select("name", "codes").collect()[0].asDict() == {"name": "Firm 3", "codes": ["62012", "7"]}
    assert Q.search_companies(spark, "register_pages:endless", []).count() == 0


def test_planned_queries(spark):
    rows = ["sic:1,2 loc: York ", "sic:,3, loc:x", "sic:1,2loc:York", "cafe in York", None, ""]
    got = [r.q and (r.q.codes, r.q.place) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(Q.parsed_query(F.col("t")).alias("q")).collect()]
    assert got == [(["1", "2"], "York"), (["3"], "x"), None, None, None, None]


def test_spool_goes_on_by_name(spark, tmp_path):
    folder, out = tmp_path / "spool", str(tmp_path / "out")
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text)
    put("01.json", json.dumps([{"kind": "reply", "email": "a"}, 7, {"kind": "bounce_hard", "extra": 1}]))
    put("02.json", '{"kind": "reply", "message_id": 12}')
    put("03.json", "{broken")
    put("04.json", '{"kind": "x"}\n{"kind": "y"}\n')
    put("ignored.txt", "[]")

    def run():
        query = P.read_spool(spark, str(folder), stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.file, r.kind or "", r.message_id or "", r.problem is not None) for r in spark.read.parquet(out).collect())

    want = [("01.json", "bounce_hard", "", False), ("01.json", "reply", "", False), ("02.json", "reply", "12", False), ("03.json", "", "", True), ("04.json", "x", "", False), ("04.json", "y", "", False)]
    assert run() == want
    put("05.json", '[{"kind": "late"}]')
    assert run() == [*want, ("05.json", "late", "", False)]
    assert P.read_spool(spark, str(folder)).count() == 7 and P.read_spool(spark, str(tmp_path / "none")).count() == 0


def test_letters_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "letters")
    rows = spark.createDataFrame([("a",), ("a",), ("é\r\n",), (None,)], "content string").repartition(2)
    P.write_letters(rows, folder, "eml")
    P.write_letters(rows, folder, "eml")
    found = {f: open(os.path.join(folder, f), newline="", encoding="utf-8").read() for f in os.listdir(folder) if not f.endswith(".crc")}
    assert sorted(found.values()) == ["a", "é\r\n"] and all(f.endswith(".eml") and len(f) == 24 for f in found)
    P.write_letters(spark.createDataFrame([("n1", "x")], "name string, content string"), folder)
    assert open(os.path.join(folder, "n1.txt")).read() == "x"


def test_a_write_that_fails_leaves_what_stood_before(tmp_path):
    import pyarrow as pa

    folder = str(tmp_path / "letters")
    batch = lambda *texts: pa.RecordBatch.from_pydict({"content": list(texts)})
    first = P.LetterWriter(folder, "txt")
    first.commit([first.write(iter([batch("one")]))])
    second = P.LetterWriter(folder, "txt")
    done = second.write(iter([batch("one", "two")]))

    def broken():
        yield batch("three")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        second.write(broken())
    second.abort([done, None])
    assert [open(os.path.join(folder, f)).read() for f in os.listdir(folder)] == ["one"]
