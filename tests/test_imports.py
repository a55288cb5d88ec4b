"""Imports row by row against the definition, and versions of several tables."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import imports as I
from tallgrass.sources import versions as V

COLUMNS = "row business_id domain website phone email channel outcome call_date contacted_at notes recorded_by".split()
SCHEMA = "row long, " + ", ".join(f"{c} string" for c in COLUMNS[1:])


def rows_of(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def known(spark):
    businesses = spark.createDataFrame([("b1", "one.com", "+1"), ("b2", "www.two.com", "+2"), ("b3", "same.com", "+2"), ("b4", "same.com", None), ("b5", None, "")], "id string, domain string, phone string")
    contacts = spark.createDataFrame([("b5", "A@five.com"), ("b5", "a@five.com"), ("b1", "two@x.com"), ("b2", "two@x.com")], "business string, value string")
    return businesses, contacts


def test_the_first_key_that_knows_one_decides(spark, known):
    old = spark.createDataFrame([], "business string, channel string, result string, contacted_at string, notes string")
    rows = [
        {"row": 1, "business_id": " b1 "}, {"row": 2, "business_id": "lost", "domain": "https://WWW.Two.com:80/x"}, {"row": 3, "website": "same.com", "phone": "+1"}, {"row": 4, "domain": "new.com", "phone": "(+1)"},
        {"row": 5, "phone": "+2", "email": "a@five.com"}, {"row": 6, "email": " A@FIVE.com"}, {"row": 7, "email": "two@x.com"}, {"row": 8}, {"row": 9, "domain": " ", "phone": "", "email": ""},
    ]
    got = {r.row: (r.business, r.reason, r.action) for r in I.import_outcomes(rows_of(spark, rows), *known, old).routes.collect()}
    assert got == {
        1: ("b1", "business_id", "imported"), 2: ("b2", "domain", "imported"), 3: (None, "ambiguous_domain", "ambiguous"), 4: ("b1", "phone", "duplicate"), 5: (None, "ambiguous_phone", "ambiguous"),
        6: ("b5", "contact", "imported"), 7: (None, "ambiguous_contact", "ambiguous"), 8: (None, "unmatched", "unmatched"), 9: (None, "unmatched", "unmatched"),
    }


def one_by_one(rows, old):
    """The rule as a loop: a row meets all that stand before it."""
    there, out = list(old), []
    for r in rows:
        key = (r["business_id"], r.get("channel") or "phone", r["outcome"], r.get("notes") or "")
        at = r.get("contacted_at")
        if any(k == key and (at is None or at == t) for k, t in there):
            out.append("duplicate")
        else:
            out.append("imported")
            there.append((key, at if at is not None else object()))
    return out


def test_duplicates_are_those_of_a_loop(spark, known):
    import random

    r = random.Random(5)
    rows = [{"row": i, "business_id": r.choice(["b1", "b2"]), "outcome": r.choice(["interested", "voicemail"]), "contacted_at": r.choice([None, "1", "2", "3", "4"]), "notes": r.choice([None, "", "n"])} for i in range(80)]
    old = [(("b1", "phone", "voicemail", ""), "2"), (("b2", "phone", "interested", "n"), "9")]
    table = spark.createDataFrame([(*k, t) for k, t in old], "business string, channel string, result string, notes string, contacted_at string")
    found = I.import_outcomes(rows_of(spark, rows).repartition(3), *known, table)
    got = {x.row: x.action for x in found.routes.collect()}
    assert [got[i] for i in range(80)] == one_by_one(rows, old)
    assert found.targets["outcomes"].count() == sum(a == "imported" for a in got.values())


def test_outcome_names(spark):
    df = spark.createDataFrame([("DNC",), (" Wrong / Disconnected",), ("Left a/b",), ("",), (None,)], "o string")
    assert [r.x for r in df.select(I.outcome_of(F.col("o")).alias("x")).collect()] == ["do_not_contact", "wrong_number", "left_a_b", "unknown", "unknown"]


def test_people(spark, known):
    names = "row business_id domain website phone email decision_maker dm_title dm_phone sheet".split()
    rows = [
        (1, "b1", None, "one.com", "(713) 555-0001", " Ann@One.com", "Ann Lee", "Owner", "713-555-0001", "S"), (2, "b1", None, None, None, "ann@one.com", "Ann Lee", "Owner", "713 555 0002", "S"),
        (3, "b1", None, None, None, None, "Ann Lee", "Owner", "+17135550001", "S"), (4, None, None, None, None, None, "Bob", None, "+1", "T"), (5, "b2", None, None, None, None, "Cy", "", "", None), (6, "b2", None, None, None, "", " ", "", " ", None),
        (7, None, None, None, None, None, "Dee", None, "999", None),
    ]
    old = spark.createDataFrame([("b1", "email", "ann@one.com", "human_calling:S", "Ann Lee\nOwner")], "business string, field string, value string, source string, person string")
    found = I.import_people(spark.createDataFrame(rows, "row long, " + ", ".join(f"{n} string" for n in names[1:])), *known, old)
    got = sorted((r.row, r.field or "", r.value, r.action) for r in found.routes.collect())
    assert got == [
        (1, "email", "ann@one.com", "duplicate"), (1, "phone", "+17135550001", "imported"), (2, "email", "ann@one.com", "duplicate"), (2, "phone", "+17135550002", "imported"), (3, "phone", "+17135550001", "duplicate"),
        (4, "phone", "+1", "imported"), (5, "", None, "person"), (6, "", None, "empty"), (7, "phone", "999", "unmatched"),
    ]
    assert {(r.business, r.name) for r in found.targets["people"].collect()} == {("b1", "Ann Lee"), ("b1", "Bob"), ("b2", "Cy")}
    assert {(r.value, r.phone_type) for r in found.targets["contacts"].collect()} == {("+17135550001", "main_line"), ("+17135550002", "direct"), ("+1", "direct")}
    assert {r.evidence for r in found.targets["observations"].collect()} == {"Operator workbook S: Ann Lee — Owner", "Operator workbook T: Bob"}


def test_versions_switch_all_tables_at_once(spark, tmp_path):
    folder = str(tmp_path / "v")
    n = lambda k: spark.range(k)
    assert V.manifest(spark, folder)["version"] == 0
    assert V.publish(spark, folder, {"a": n(3), "b": n(1)}) == 1
    before = V.current(spark, folder, "a")
    assert V.publish(spark, folder, {"a": n(2)}, {"b": n(7)}, expected=1) == 2
    assert before.count() == 3 and V.current(spark, folder, "a").count() == 5 and V.current(spark, folder, "b").count() == 7
    with pytest.raises(ValueError, match="stands"):
        V.publish(spark, folder, {"a": n(9)}, expected=1)
    with pytest.raises(ValueError, match="columns"):
        V.publish(spark, folder, {"a": n(9).withColumn("x", F.lit(1))})
    with pytest.raises(KeyError):
        V.current(spark, folder, "c")
    assert V.manifest(spark, folder)["version"] == 2 and V.current(spark, folder, "a").count() == 5


def test_a_version_that_someone_else_took(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "v")
    V.publish(spark, folder, {"a": spark.range(1)})
    stale = V.manifest(spark, folder)
    V.publish(spark, folder, {"a": spark.range(1)})
    monkeypatch.setattr(V, "manifest", lambda *_: stale)
    with pytest.raises(ValueError, match="meanwhile"):
        V.publish(spark, folder, {"a": spark.range(5)})
    monkeypatch.undo()
    assert V.current(spark, folder, "a").count() == 2
