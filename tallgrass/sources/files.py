"""File sources and sinks: listings as JSON lines, register CSV, lists with odd headers, labels, events; sheets and lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .scratch import shared_path

#: Columns that a register file must have.
REGISTER_COLUMNS = ["Site_Number", "Trading_Name", "Town", "Postcode", "Phone"]


def read_listings(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or one array; lines that don't parse come back in _bad instead of ending the scan."""
    reader = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return reader.option("multiLine", array).json(path)


def mapped(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A source's rows through its field map: each target takes the first candidate column that has a value."""
    have = set(rows.columns)
    pick = lambda names: T.first_present(*[F.col(n).cast("string") for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")
    return rows.select(*[pick(names).alias(target) for target, names in fields.items()])


def read_register(spark: SparkSession, path: str, town: str | None = None) -> DataFrame:
    """A register's CSV in Windows-1252, refused without its columns, filtered by town."""
    rows = spark.read.option("header", True).option("encoding", "iso-8859-1").csv(path)
    # Spark reads no Windows-1252; it differs from ISO-8859-1 in these bytes.
    pairs = [(chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))]
    rows = rows.select(*[F.translate(F.col(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)).alias(c) for c in rows.columns])
    if missing := [c for c in REGISTER_COLUMNS if c not in rows.columns]:
        raise ValueError(f"register file without {', '.join(missing)}")
    return rows.filter(F.lower(F.trim("Town")) == town.strip().lower()) if town else rows


def read_list(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A list with headers of any case and spacing, which become lower-case names; a byte-order mark goes."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    return rows.toDF(*[c.replace("﻿", "").strip().lower().replace(" ", "_") for c in rows.columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels, a line each: JSON with biz and pick, else two fields between tabs; other lines go."""
    lines = spark.read.text(path).withColumn("j", F.from_json("value", "biz string, pick int"))
    cut = F.split("value", "\t")
    biz = F.coalesce("j.biz", F.when(F.size(cut) >= 2, cut[0]))
    pick = F.coalesce("j.pick", F.when(F.size(cut) >= 2, F.expr("try_cast(split(value, '\t')[1] AS int)")))
    return lines.select(biz.alias("biz"), pick.alias("pick")).filter("biz IS NOT NULL AND pick IS NOT NULL")


def write_sheet(rows: DataFrame, path: str) -> None:
    """CSV with quoted cells that no program takes for a formula, blanks as a dash; as many files as the data has partitions."""
    cells = [F.coalesce(T.absent(T.safe_cell(F.col(c).cast("string"))), F.lit("-")).alias(c) for c in rows.columns]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with the latest row of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def publish(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """A table as a new version beside the old ones; readers keep theirs."""
    path = f"{folder}/v={version:08d}"
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(StructType(rows.schema.fields)).parquet(path)


def quarantined(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold and rows that don't; null doesn't."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


__all__ = ["mapped", "publish", "quarantined", "read_labels", "read_list", "read_listings", "read_register", "shared_path", "upserted", "write_lines", "write_sheet"]
