"""Lists of unknown make: for each file its delimiter and its header row are found from its first lines, then all lines are read by their file's rule."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What headers are called, and cells by which a header row is known.
ALIASES = {
    "queue": "queue", "queuenumber": "queue", "company": "company", "decisionmaker": "decision_maker", "decisionmakeraskfor": "decision_maker", "dmname": "decision_maker", "dmemail": "email", "email": "email",
    "phone": "phone", "primaryphone": "phone", "dmdirectphonebestroute": "dm_phone", "dmtitle": "dm_title", "website": "website", "city": "city", "disposition": "outcome", "outcome": "outcome", "notes": "notes",
    "dialedby": "recorded_by", "agent": "recorded_by", "dialedat": "contacted_at", "timestampcairo": "contacted_at", "originalcallbacknote": "callback_note", "opportunitysignal": "opportunity_signal",
    "priority": "priority", "source": "source", "provider": "provider", "contacttype": "contact_type", "campaign": "campaign",
}
MARKS = {"company", "queuenumber", "phone", "primaryphone"}
#: First lines that are looked at, those among which a header may stand, and delimiters in the order of preference.
HEAD, SEARCHED, DELIMITERS = 20, 6, ",\t;|"


def key(cell: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", cell.casefold())


def decoded(line: bytes) -> str:
    """A line in UTF-8, or, where it isn't, in the code page of western Windows; without a byte-order mark."""
    try:
        text = line.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = line.decode("cp1252", "replace")
    return text.rstrip("\r")


def cells(line: str, delimiter: str) -> list[str] | None:
    """The cells of a line; None where a quote isn't closed."""
    try:
        return next(csv.reader([line], delimiter=delimiter, strict=True), [])
    except csv.Error:
        return None


def rule_of(lines: list[str]) -> tuple[str, int, list[str]]:
    """Delimiter, number of the header row and names of columns of a file that begins with these lines.

    The header is the first of SEARCHED lines with a cell that marks one, by
    the delimiter that gives it most cells of known names; without one it is the
    first line that isn't blank, by the delimiter that parts it most.  Known
    headers get their names, others their own in lower case with lines for
    blanks, blank ones none.
    """
    best: tuple | None = None
    for rank, d in enumerate(DELIMITERS):
        for i, line in enumerate(lines[:SEARCHED]):
            found = [key(c) for c in cells(line, d) or []]
            if MARKS & set(found):
                score = sum(c in ALIASES for c in found), len(found), -rank
                if best is None or score > best[0]:
                    best = score, d, i
                break
    if best is None:
        i = next((i for i, line in enumerate(lines) if line.strip()), 0)
        first = lines[i] if lines else ""
        best = None, max(DELIMITERS, key=lambda d: (len(cells(first, d) or []), -DELIMITERS.index(d))), i
    _, d, i = best
    names = [ALIASES.get(key(c)) or re.sub(r"\s+", "_", c.strip().lower()) for c in (cells(lines[i], d) if lines else None) or []]
    return d, i, names


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 in a file's first block, null behind it) and bytes of each line."""
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:  # a block's lines come in order
            out = []
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                at, n = (file, block), (n + 1 if at == (file, block) else 0)
                out.append(None if block else n)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.int64()), batch.column("bytes")], names=["file", "line", "bytes"])

    return raw.mapInArrow(number, "file string, line long, bytes binary")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """file, delimiter, header (number of its line) and names of every file of a list's path."""
    heads = _numbered(spark, path).filter(F.col("line") < HEAD).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "bytes"))).alias("head"))  # HEAD lines of a file

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rule_of([decoded(x["bytes"]) for x in head]) for head in batch.column("head").to_pylist()]
            d, i, names = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(d, pa.string()), pa.array(i, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["file", "delimiter", "header", "names"])

    return heads.mapInArrow(find, "file string, delimiter string, header long, names array<string>")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fields, problem): every row behind the header of every file, fields by name, trimmed, blank ones left out.

    line is null behind a file's first block.  Blank lines go.  Surplus cells
    have no name and go; a row with a quote that isn't closed, as of a cell of
    several lines, has no fields but a problem.  Of columns of one name the
    first that isn't blank counts.
    """
    lines = _numbered(spark, path).join(rules(spark, path), "file").filter(F.col("line").isNull() | (F.col("line") > F.col("header")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, fields, problems = [], [], []
            for k, (raw, d, names) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bytes", "delimiter", "names")))):
                text = decoded(raw)
                if not text.strip():
                    continue
                row = cells(text, d)
                found: dict[str, str] = {}
                for name, cell in zip(names, row or []):
                    if name and cell.strip():
                        found.setdefault(name, cell.strip())
                keep.append(k)
                fields.append(None if row is None else list(found.items()))
                problems.append("open quote" if row is None else None)
            where = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file").take(where), batch.column("line").take(where), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(problems, pa.string())], names=["file", "line", "fields", "problem"])

    return lines.select("file", "line", "bytes", "delimiter", "names").mapInArrow(parse, "file string, line long, fields map<string,string>, problem string")
