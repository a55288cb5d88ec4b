"""Numbers of all planned countries, by what their plans say."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import phones as P

EXAMPLES = [
    ("US", "(201) 555-0123", "+12015550123", "either"), ("US", "1-800-234-5678 x12", "+18002345678", "toll_free"), ("US", "011 44 20 7946 0958", "+442079460958", "fixed"), ("US", "111-555-0123", None, None),
    ("US", "+1 416 234 5678", "+14162345678", "either"), ("CA", "506-234-5678", "+15062345678", "either"), ("GB", "07400 123456", "+447400123456", "mobile"), ("GB", "+44 (0)121 234 5678", "+441212345678", "fixed"),
    ("GB", "020 7946 0958 ext. 7", "+442079460958", "fixed"), ("GB", "44 20 7946 0958", "+442079460958", "fixed"), ("GB", "0800 123 4567", "+448001234567", "toll_free"), ("GB", "12345", None, None),
    ("FR", "01 23 45 67 89", "+33123456789", "fixed"), ("FR", "06.12.34.56.78", "+33612345678", "mobile"), ("DE", "030 123456", "+4930123456", "fixed"), ("DE", "01512 3456789", "+4915123456789", "mobile"),
    ("ES", "612 34 56 78", "+34612345678", "mobile"), ("ES", "810 12 34 56", "+34810123456", "fixed"), ("IT", "02 1234 5678", "+390212345678", "fixed"), ("IT", "312 345 6789", "+393123456789", "mobile"),
    ("NL", "06 12345678", "+31612345678", "mobile"), ("NL", "010 123 4567", "+31101234567", "fixed"), ("EG", "010 01234567", "+201001234567", "mobile"), ("AE", "050 123 4567", "+971501234567", "mobile"),
    ("AE", "02 234 5678", "+97122345678", "fixed"), ("SA", "051 234 5678", "+966512345678", "mobile"), ("MX", "222 123 4567", "+522221234567", "either"), ("MX", "+52 1 222 123 4567", "+522221234567", "either"),
    ("BR", "(11) 96123-4567", "+5511961234567", "mobile"), ("BR", "(11) 2345-6789", "+551123456789", "fixed"), ("IN", "081234 56789", "+918123456789", "mobile"), ("AU", "0412 345 678", "+61412345678", "mobile"),
    ("AU", "(02) 2123 4567", "+61221234567", "fixed"), ("NZ", "021 123 4567", "+64211234567", "mobile"), ("IE", "085 012 3456", "+353850123456", "mobile"), ("IE", "(01) 234 5678", "+35312345678", "fixed"),
    ("GB", "+81 3-1234-5678", "+81312345678", "unknown"), ("GB", "+999 123456789", None, None), ("GB", "tel:+44-20-7946-0958;phone-context=x", "+442079460958", "fixed"), ("GB", None, None, None), ("GB", "", None, None), (None, "020 7946 0958", None, None),
    (None, "+44 20 7946 0958", "+442079460958", "fixed"), ("GB", "９" * 30, None, None),
]


def test_examples_by_column(spark):
    df = spark.createDataFrame([(i, r, n) for i, (r, n, _, _) in enumerate(EXAMPLES)], "i int, region string, raw string")
    got = {x.i: (x.p and x.p.e164, x.p and x.p.kind) for x in df.select("i", P.parsed(F.col("raw"), F.col("region")).alias("p")).collect()}
    assert [(e, got[i]) for i, e in enumerate(EXAMPLES) if got[i] != e[2:]] == []


@pytest.mark.parametrize("region", ["US", "GB", "IT"])
def test_examples_by_name(spark, region):
    own = [e for e in EXAMPLES if e[0] == region]
    df = spark.createDataFrame([(i, e[1]) for i, e in enumerate(own)], "i int, raw string")
    got = {x.i: x.e for x in df.select("i", P.e164(F.col("raw"), region).alias("e")).collect()}
    assert [got[i] for i in range(len(own))] == [e[2] for e in own]


def test_canada_is_told_from_its_neighbour(spark):
    df = spark.createDataFrame([("+14165550123",), ("+12125550123",), ("+18005550123",)], "n string")
    assert [r.p.region for r in df.select(P.parsed(F.col("n")).alias("p")).collect()][:2] == ["CA", "US"]


def test_stored_numbers(spark):
    df = spark.createDataFrame([("+442079460958",), ("02079460958",), ("+4420",), (None,), ("x",)], "n string")
    assert [(r.v, r.k) for r in df.select(P.is_valid(F.col("n")).alias("v"), P.kind(F.col("n")).alias("k")).collect()] == [(True, "fixed"), (False, "unknown"), (False, "unknown"), (False, "unknown"), (False, "unknown")]


def test_numbers_in_pages(spark):
    html = '<a class="b" href="tel:+44%2020%207946%200958">Call</a> <a href=\'tel:0121 234 5678\'>x</a><a href="tel:nobody">'
    text = "Ring 0121 234 5678 or (020) 7946 0959, fax 01632 960 001 / 01632 960 002. Order 123456789012345678901, dated 2024-01-02, 07400 123456  07400 123457"
    df = spark.createDataFrame([(html, text), (None, None)], "h string, t string")
    got = [r.p for r in df.select(P.in_text(F.col("h"), F.col("t"), "GB").alias("p")).collect()]
    assert got[0] == ["+442079460958", "+441212345678", "+442079460959", "+441632960001", "+441632960002", "+447400123456", "+447400123457"] and got[1] == []
