"""A folder of event files as a stream by name, and letters as files of their own."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

EVENTS = "kind string, email string, message_id string, occurred_at string, body string, file string, problem string"
#: Characters of a list that are read at a time.
CHARACTERS = 1 << 20
BLANK = re.compile(r"[ \t\n\r]*")
FIELDS = ("kind", "email", "message_id", "occurred_at", "body")


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def spooled(path: str) -> list[str]:
    """The names of a folder's .json files in order; a folder that isn't there has none."""
    files, root = _where(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(".json") and not i.base_name.startswith(("_", ".")))


@dataclass
class Spooled(D.InputPartition):
    name: str


def _lines(files: fs.FileSystem, path: str) -> Iterator:
    """What the lines of a file hold; an error where one isn't JSON."""
    with files.open_input_stream(path) as f:
        for line in io.TextIOWrapper(f, encoding="utf-8"):
            if line.strip():
                try:
                    yield json.loads(line)
                except ValueError:  # other marks than those of lines may stand between objects
                    yield from [json.loads(part) for part in line.splitlines() if part.strip()]


def _listed(files: fs.FileSystem, path: str) -> Iterator:
    """The elements of a file that is one list; an error where it isn't."""
    decoder, text, at, last = json.JSONDecoder(), "", 0, False
    with files.open_input_stream(path) as f:
        source = io.TextIOWrapper(f, encoding="utf-8", newline="")

        def more() -> None:
            nonlocal text, at, last
            part = source.read(max(CHARACTERS, len(text) - at))  # twice as much, so that long elements are read a few times only
            text, at, last = text[at:] + part, 0, not part

        def mark() -> str:
            nonlocal at
            while True:
                at = BLANK.match(text, at).end()
                if at < len(text) or last:
                    return text[at : at + 1]
                more()

        if mark() != "[":
            raise ValueError("not a list")
        at += 1
        empty = mark() == "]"
        while not empty:
            mark()
            try:
                item, end = decoder.raw_decode(text, at)
                end = BLANK.match(text, end).end()
                if text[end : end + 1] not in (",", "]"):  # a number may go on in what isn't read yet
                    raise ValueError("no end of an element")
            except ValueError:
                if last:
                    raise
                more()
                continue
            yield item
            at = end
            if mark() == "]":
                break
            at += 1
        at += 1
        if mark():
            raise ValueError("something behind the list")


def events_of(path: str, name: str) -> Iterator[tuple]:
    """A file's events: a list, one object, or an object on each line.  What isn't an object goes; a file that can't be read gives one row that says why.

    Lists and lines are read twice, first to see whether all of the file can be
    read, and never held as a whole; other files are.
    """
    files, root = _where(path)
    where = f"{root}/{name}"
    for form in (_listed, _lines):
        try:
            if not sum(1 for _ in form(files, where)) and form is _lines:
                continue
        except (OSError, ValueError):
            continue
        found = form(files, where)
        break
    else:
        try:
            with files.open_input_stream(where) as f:
                data = json.loads(f.read().decode("utf-8"))
        except (OSError, ValueError) as e:
            yield (*[None] * len(FIELDS), name, f"{type(e).__name__}: {e}"[:300])
            return
        found = iter(data if isinstance(data, list) else [data])
    for item in found:
        if isinstance(item, dict):
            yield (*[None if item.get(k) is None else str(item[k]) for k in FIELDS], name, None)


class SpoolStream(D.DataSourceStreamReader):
    """Offsets are names: a batch holds the files behind one name, up to another.  Files must come in the order of their names, as time stamps give them."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        names = spooled(self.path)
        return {"upto": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Spooled]:
        return [Spooled(n) for n in spooled(self.path) if start["upto"] < n <= end["upto"]]

    def read(self, partition: Spooled) -> Iterator[tuple]:
        return events_of(self.path, partition.name)

    def commit(self, end: dict) -> None:
        pass  # files stay; who owns the folder clears it


class SpoolReader(D.DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Spooled]:
        return [Spooled(n) for n in spooled(self.path)] or [Spooled("")]

    def read(self, partition: Spooled) -> Iterator[tuple]:
        return events_of(self.path, partition.name) if partition.name else iter(())


class EventSpool(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_spool"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"])

    def streamReader(self, schema) -> SpoolStream:
        return SpoolStream(self.options["path"])


def read_spool(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    spark.dataSource.register(EventSpool)
    return (spark.readStream if stream else spark.read).format("event_spool").load(path)


@dataclass
class _Files(D.WriterCommitMessage):
    made: list[str]


class LetterWriter(D.DataSourceArrowWriter):
    """Rows of (content, and name where it is given) as files: a name is the digest of the content, so that a task that is tried again writes the same files."""

    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        files, root = _where(self.path)
        files.create_dir(root, recursive=True)
        made: list[str] = []
        try:
            for batch in iterator:
                names = batch.column("name").to_pylist() if "name" in batch.schema.names else [None] * len(batch)
                for name, content in zip(names, batch.column("content").to_pylist()):
                    if content is None:
                        continue
                    data = content.encode()
                    target = f"{root}/{name or hashlib.sha1(data).hexdigest()[:20]}.{self.ending}"
                    there = files.get_file_info(target).type == fs.FileType.File
                    # Readers see whole files only: they are written aside and moved.
                    draft = f"{root}/.{uuid.uuid4().hex}"
                    with files.open_output_stream(draft) as f:
                        f.write(data)
                    files.move(draft, target)
                    if not there:
                        made.append(target)
        except BaseException:
            self._remove(files, made)
            raise
        return _Files(made)

    @staticmethod
    def _remove(files: fs.FileSystem, names: list[str]) -> None:
        for name in names:
            if files.get_file_info(name).type == fs.FileType.File:
                files.delete_file(name)

    def commit(self, messages: list[_Files | None]) -> None:
        pass  # the files stand

    def abort(self, messages: list[_Files | None]) -> None:
        """Takes away what this write has made; files that stood before stay."""
        files = _where(self.path)[0]
        for m in messages:
            self._remove(files, m.made if m else [])


class LetterFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "letter_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> LetterWriter:
        return LetterWriter(self.options["path"], self.options.get("ending", "txt"))


def write_letters(rows: DataFrame, path: str, ending: str = "txt") -> None:
    """Rows (content, perhaps name) as files of a folder, one each; equal contents without a name are one file, null contents none.

    A file takes a few calls however short it is, so equal rows go before, and
    what is left is dealt to all tasks by hash, however few its bytes.
    """
    spark = rows.sparkSession
    spark.dataSource.register(LetterFiles)
    rows = rows.filter("content IS NOT NULL").distinct()
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, *rows.columns)
    rows.write.format("letter_files").option("ending", ending).mode("append").save(path)
