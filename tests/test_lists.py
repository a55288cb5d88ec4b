"""Lists of unknown make."""

import pytest

from tallgrass.sources import lists as N


@pytest.mark.parametrize("lines, want", [
    (["Company,Phone", "a,b"], (",", 0, ["company", "phone"])), (["Title; with, marks", "", "Queue Number\tCompany\tDM Direct Phone / Best Route\tOther Thing"], ("\t", 2, ["queue", "company", "dm_phone", "other_thing"])),
    (["a;b,c;d"], (";", 0, ["a", "b,c", "d"])), (["", "x|y"], ("|", 1, ["x", "y"])), (["only"], (",", 0, ["only"])), ([], (",", 0, [])), (["n,o", *["x"] * 6, "Company,Phone"], (",", 0, ["n", "o"])), (['"Company","Notes, more"', "a,b"], (",", 0, ["company", "notes,_more"])),
])
def test_rules(lines, want):
    assert N.rule_of(lines) == want


def test_files_by_their_own_rules(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("a.csv", "﻿Company,Phone,Notes,,Phone\r\n\"Kings, Ltd\", +1 ,,x,+2\r\n\r\nCafé,,n,y,+3,more\r\n".encode())
    put("b.tsv", "report of May\nPhone\tCompany\n1\tCaf\xe9\n".encode("cp1252"))
    put("c.csv", b'Company;Notes\nx;"open\nstill";y\nok;fine\n')
    put("d.csv", b"")
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.fields, r.problem) for r in N.read_lists(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", 1, {"company": "Kings, Ltd", "phone": "+1"}, None), ("a.csv", 3, {"company": "Café", "notes": "n", "phone": "+3"}, None), ("b.tsv", 2, {"phone": "1", "company": "Café"}, None),
        ("c.csv", 1, None, "open quote"), ("c.csv", 2, {"company": 'still"', "notes": "y"}, None), ("c.csv", 3, {"company": "ok", "notes": "fine"}, None),
    ]


def test_files_of_many_blocks(spark, tmp_path):
    rows = [f"c{i}|{i}" for i in range(30_000)]
    (tmp_path / "big.txt").write_text("intro\nCompany|Queue\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        found = N.read_lists(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 1 and found.filter("line IS NULL").count() > 20_000
        assert {(r.fields["company"], r.fields["queue"]) for r in found.collect()} == {(f"c{i}", str(i)) for i in range(30_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
