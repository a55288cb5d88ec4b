"""WARC archives as a Python data source, and pages archived with revisit records.

Reading plans partitions of whole files.  Predicates on the record type and
other header fields are pushed into the scan: a record's header is parsed
first, and a record that fails is passed over.  Members of a compressed file
that carry their length (the `sl` extra field, which this writer sets) and
records of a plain file are passed over by a seek, without reading or
inflating what is in them.

Writing keeps every attempt's files under names of their own and commits them
by a list: readers of a folder with lists see only files that a list names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .common import scratch_path, stash

#: Bytes of a file after which the writer begins another, and of files that one task reads.
FILE_BYTES = 128 << 20
#: Bytes of a batch that the reader gives, and of a read.
BATCH_BYTES, WINDOW = 8 << 20, 1 << 20
#: Bytes that a header may have.
HEADER_BYTES = 1 << 20

LISTED = "_committed-"

#: Columns that come from header fields; predicates on them are pushed down.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "content_length": "Content-Length",
}
_MAP = pa.map_(pa.string(), pa.string())
COLUMNS = {
    **{c: pa.string() for c in FIELDS}, "content_length": pa.int64(), "headers": _MAP, "http_status": pa.int32(), "http_headers": _MAP, "payload": pa.binary(),
    "file": pa.string(), "offset": pa.int64(),
}
SCHEMA = ", ".join(f"{c} {'map<string,string>' if t == _MAP else {'string': 'string', 'int64': 'long', 'int32': 'int', 'binary': 'binary'}[str(t)]}" for c, t in COLUMNS.items())


# Predicates


def holds(f: D.Filter, row: dict) -> bool | None:
    """A predicate's value by SQL's three-valued logic."""
    if isinstance(f, D.Not):
        return None if (v := holds(f.child, row)) is None else not v
    value = row[f.attribute[0]]
    if isinstance(f, D.IsNull):
        return value is None
    if isinstance(f, D.IsNotNull):
        return value is not None
    if isinstance(f, D.EqualNullSafe):
        return value == f.value
    if value is None or f.value is None:
        return None
    if isinstance(f, D.In):
        return True if value in f.value else None if None in f.value else False
    return _TESTS[type(f)](value, f.value)


_TESTS = {
    D.EqualTo: lambda v, x: v == x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x, D.LessThanOrEqual: lambda v, x: v <= x,
    D.StringStartsWith: lambda v, x: v.startswith(x), D.StringEndsWith: lambda v, x: v.endswith(x), D.StringContains: lambda v, x: x in v,
}


def pushable(f: D.Filter) -> bool:
    """Whether a predicate can be decided by a record's header; strings are ordered by UTF-8 as Spark orders them, so those comparisons stay there."""
    if isinstance(f, D.Not):
        return pushable(f.child)
    if not isinstance(f, (*_TESTS, D.In, D.IsNull, D.IsNotNull, D.EqualNullSafe)) or len(f.attribute) != 1 or f.attribute[0] not in FIELDS:
        return False
    ordered = isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual))
    return not ordered or f.attribute[0] == "content_length"


# Reading


class _Window:
    """Bytes of a file by offset, read some at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, WINDOW))
        return self.data[at - self.at : at - self.at + n]


def _lines(head: bytes) -> dict[str, str]:
    """Fields of a header block without its first line; a line that opens with white space goes on with the field before it; the first of equal names counts."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in " \t" and last and line.strip():
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip()
            out.setdefault(last, value.strip())
    return out


def _header_end(data: bytes) -> int:
    """Where the block behind a header begins; -1 if the header goes on."""
    ends = [i + len(m) for m in (b"\r\n\r\n", b"\n\n") if (i := data.find(m)) >= 0]
    return min(ends, default=-1)


def _skip_lengths(extra: bytes) -> tuple[int, int] | None:
    """Compressed and plain length of a gzip member by its `sl` field."""
    at = 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"sl" and n == 8:
            return struct.unpack_from("<II", extra, at + 4)
        at += 4 + n
    return None


class _Record:
    """A record whose header is read; block() reads the rest, end() says where the next one begins."""

    def __init__(self, window: _Window, at: int, packed: bool, name: str):
        self.window, self.at, self.packed, self.name = window, at, packed, name
        self.inflate = zlib.decompressobj(31) if packed else None
        self.read, self.plain, self.length = at, b"", None
        if packed:
            start = window.get(at, 12)
            if start[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at {at} of {name}")
            if start[3] & 4:
                lengths = _skip_lengths(window.get(at + 12, struct.unpack_from("<H", start, 10)[0]))
                self.length = lengths[0] if lengths else None
        while (cut := _header_end(self.plain)) < 0:
            if len(self.plain) > HEADER_BYTES or not self._more(4096):
                raise ValueError(f"no header at {at} of {name}")
        self.fields = _lines(self.plain[:cut])
        self.cut = cut
        if not self.plain.startswith(b"WARC/") or not self.fields.get("Content-Length", "").isdigit() or "WARC-Type" not in self.fields:
            raise ValueError(f"no record at {at} of {name}")
        self.n = int(self.fields["Content-Length"])

    def _more(self, n: int) -> bool:
        """Reads on; False at the end of the member or file."""
        if self.packed:
            if self.inflate.eof or self.read >= self.window.size:
                return False
            data = self.window.get(self.read, n)
            self.plain += self.inflate.decompress(data)
            self.read += len(data) - len(self.inflate.unused_data)
            return True
        data = self.window.get(self.read, n)
        self.plain += data
        self.read += len(data)
        return bool(data)

    def block(self) -> bytes:
        parts, have = [self.plain], len(self.plain)
        while have < self.cut + self.n:
            self.plain = b""
            if not self._more(1 << 18 if self.packed else self.cut + self.n - have):
                raise ValueError(f"record cut short at {self.at} of {self.name}")
            parts.append(self.plain)
            have += len(self.plain)
        self.plain = b"".join(parts)
        return self.plain[self.cut : self.cut + self.n]

    def end(self) -> int:
        if self.packed:
            if self.length:
                return self.at + self.length
            while not self.inflate.eof:  # a member without its length can only be passed by inflating it
                self.plain = b""
                if not self._more(1 << 18):
                    raise ValueError(f"record cut short at {self.at} of {self.name}")
            return self.read
        at = self.at + self.cut + self.n
        while (data := self.window.get(at, 4)) and (blank := len(data) - len(data.lstrip(b"\r\n"))):
            at += blank
        return at


def records(file: pa.NativeFile, name: str) -> Iterator[_Record]:
    """The records of a plain or compressed file in order."""
    window = _Window(file)
    packed, at = window.get(0, 2) == b"\x1f\x8b", 0
    while at < window.size:
        record = _Record(window, at, packed, name)
        yield record
        at = record.end()


def _http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, fields and body of an HTTP message; a block that isn't one is all body."""
    cut = _header_end(block)
    first = block[:64].split(b"\n")[0].split()
    if cut < 0 or not first or not first[0].startswith(b"HTTP/"):
        return None, {}, block
    status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
    return status, _lines(block[:cut]), block[cut:]


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def archives(path: str) -> list[tuple[str, int]]:
    """Names and bytes of a folder's archives (those that its lists name, where it has lists), or of one file."""
    files, root = _where(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
    lists = [i for i in found if i.base_name.startswith(LISTED)]
    sizes = {i.path: i.size for i in found if i.base_name.endswith((".warc", ".warc.gz"))}
    if lists:
        names: list[str] = []
        for i in lists:
            with files.open_input_stream(i.path) as f:
                names += [f"{root}/{n}" for n in json.loads(f.read())]
        missing = [n for n in names if n not in sizes]
        if missing:
            raise FileNotFoundError(missing[0])
        sizes = {n: sizes[n] for n in names}
    return sorted(sizes.items())


@dataclass
class _Files(D.InputPartition):
    names: list[str]


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.task_bytes = int(options.get("task_bytes", FILE_BYTES))
        self.filters: list[D.Filter] = []

    def partitions(self) -> list[_Files]:
        """Runs of files of about task_bytes; a file is never cut."""
        out: list[_Files] = []
        size = self.task_bytes
        for name, n in archives(self.path):
            if size + n > self.task_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files = _where(self.path)[0]
        rows: list[dict] = []
        size = 0
        for name in partition.names:
            with files.open_input_file(name) as file:
                for record in records(file, name):
                    row = {c: record.fields.get(h) for c, h in FIELDS.items()} | {"content_length": record.n}
                    if any(holds(f, row) is not True for f in self.filters):
                        continue
                    row |= {"headers": list(record.fields.items()), "file": name, "offset": record.at, "http_status": None, "http_headers": None, "payload": None}
                    block = record.block() if self.payload or record.n < 1 << 16 else b""
                    body = block
                    if (row["content_type"] or "").startswith("application/http"):
                        row["http_status"], found, body = _http(block)
                        row["http_headers"] = list(found.items())
                    if self.payload:
                        row["payload"] = body
                    rows.append(row)
                    size += len(block) + 1024
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


class PushingReader(WarcReader):
    """The same, with predicates on header fields decided in the source."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in COLUMNS.items()], names=list(COLUMNS))


# Writing


@dataclass
class _Written(D.WriterCommitMessage):
    names: list[str]


def _clean(value: str) -> str:
    """A header value on one line: control characters are escaped as in addresses."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{n}: {_clean(v)}\r\n" for n, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that carries its own length where 32 bits hold it."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) if max(total, len(data)) < 1 << 32 else struct.pack("<H", 0)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(D.DataSourceArrowWriter):
    """Writes rows with some of the reader's columns: record_type and record_id are needed; http_status makes a block an HTTP message."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.job = uuid.uuid4().hex

    def _fields(self, row: dict) -> list[tuple[str, str]]:
        named = [(h, row.get(c)) for c, h in FIELDS.items() if c not in ("warc_date", "content_length", "content_type")]
        date = row.get("warc_date") or self.date
        kind = row.get("content_type") or ("application/http; msgtype=response" if row.get("http_status") is not None else "application/octet-stream")
        return [(h, v) for h, v in [*named, ("WARC-Date", date), ("Content-Type", kind), *(row.get("headers") or [])] if v is not None]

    def _block(self, row: dict) -> bytes:
        body = row.get("payload") or b""
        if row.get("http_status") is None:
            return body
        head = "".join(f"{n}: {_clean(v)}\r\n" for n, v in row.get("http_headers") or [] if v is not None)
        return f"HTTP/1.1 {row['http_status']}\r\n{head}\r\n".encode() + body

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _where(self.path)
        names: list[str] = []
        out, size = None, 0
        put = (lambda data: out.write(member(data))) if self.packed else (lambda data: out.write(data))
        for batch in iterator:
            for at in range(0, len(batch), 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        files.create_dir(root, recursive=True)
                        names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc" + (".gz" if self.packed else ""))
                        out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        put(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", names[-1]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    block = self._block(row)
                    put(record_bytes(self._fields(row), block))
                    size = out.tell()
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _where(self.path)
        files.create_dir(root, recursive=True)
        old = [i for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
        name = f"{LISTED}{self.job}.json"
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        if self.overwrite:
            for i in old:
                if self.job not in i.base_name and i.base_name.startswith((LISTED, "part-")):
                    files.delete_file(i.path)

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _where(self.path)
        for m in messages:
            for n in m.names if m else []:
                files.delete_file(f"{root}/{n}")


class Warc(D.DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder); df.write.format("warc").mode("append").save(folder).

    Options of reads: payload (false: payloads stay null, and only small blocks
    are read, for their HTTP fields), task_bytes, pushdown (set by read_warc);
    of writes: compression (gzip or none), file_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingReader if self.options.get("pushdown") == "true" else WarcReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets predicates reach sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder's archives, with predicates pushed down.

    Spark plans a scan without new predicates by those of the scan before, where
    both are of one DataFrame (seen in 4.1); the predicate that all records meet
    gives every plan predicates of its own.
    """
    register(spark)
    records_ = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", "true").load(path)
    return records_.filter(F.col("record_type").isNotNull())


# Pages


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """The records of (page_id, url, html), one for each row.

    The payload is the html in UTF-8, null as empty.  Of equal payloads of at
    least `least` bytes those of the smallest page_id are responses (all of
    them where rows repeat it, or where all ids are null) and the others
    revisits, which hold no payload but its length and digest.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    # A written table, so that its size is known where the join is planned.
    groups = stash(groups.filter("rows > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "groups")
    joined = rows.join(groups, F.when(F.col("n") >= least, F.col("digest")) == F.col("_digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda id_, url: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("\n", F.col(id_).cast("string"), F.col(url), "digest")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("page_id", "url").alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(again, name("first_id", "first_url")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_to_uri"),
        F.create_map(
            F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Refers-To-Page-Id"), F.when(again, F.col("first_id").cast("string")),
            F.lit("WARC-Profile"), F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ).alias("headers"),
        F.lit(200).alias("http_status"), F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.col("n").cast("string")).alias("http_headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of (page_id, url, html), from archives in a folder.

    Responses are read with their payloads, of which length and digest are
    worked out anew; revisits by their headers alone.  Null html is empty, a
    null page_id stays null and comes last among equal payloads; null
    addresses give no field; repeated rows stay; an empty table gives none;
    other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    folder = folder or scratch_path(spark, "warc")
    page_records(pages, least).write.format("warc").mode("append").save(folder)
    id_ = F.col("headers")["X-Page-Id"].cast("long").alias("page_id")
    whole = read_warc(spark, folder).filter(F.col("record_type") == "response")
    whole = whole.select(id_, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = read_warc(spark, folder, payload=False).filter(F.col("record_type") == "revisit")
    heads = heads.select(id_, F.col("http_headers")["Content-Length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("headers")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"))
    return whole.unionByName(heads)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1),
r AS (SELECT p.*, CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""
