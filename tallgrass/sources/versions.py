"""Several tables as one version: each is written beside the old ones, and a manifest that readers go by switches all at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str:
    p, files = _hadoop(spark, path)
    stream = files.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> dict:
    """version (0: none yet) and tables (folder and schema by name) of the newest manifest."""
    p, files = _hadoop(spark, f"{folder}/_manifests")
    if not files.exists(p):
        return {"version": 0, "tables": {}}
    names = [s.getPath().getName() for s in files.listStatus(p)]
    newest = max((n for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=None)
    return json.loads(_text(spark, f"{folder}/_manifests/{newest}")) if newest else {"version": 0, "tables": {}}


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as the newest manifest has it; what is published later doesn't change it."""
    found = manifest(spark, folder)["tables"].get(name)
    if found is None:
        raise KeyError(name)
    return spark.read.schema(found["schema"]).parquet(*[f"{folder}/{p}" for p in found["paths"]])


def publish(spark: SparkSession, folder: str, appended: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, expected: int | None = None) -> int:
    """Publishes rows to append and tables to replace as one version; the others stay as they are.

    Files are written first; the manifest is then made under a name of its own
    and renamed to its version's, which only one writer can do.  Whoever comes
    second, or expects another version than the newest, gets a ValueError and
    has changed nothing that readers see.
    """
    before = manifest(spark, folder)
    if expected is not None and before["version"] != expected:
        raise ValueError(f"version {before['version']} stands, not {expected}")
    tables, own = dict(before["tables"]), uuid.uuid4().hex
    for name, rows, keep in [(n, r, True) for n, r in appended.items()] + [(n, r, False) for n, r in (replaced or {}).items()]:
        old = tables.get(name, {"paths": [], "schema": rows.schema.simpleString()[7:-1]}) if keep else {"paths": []}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        if keep and old["paths"] and old["schema"] != schema:
            raise ValueError(f"{name} has other columns")
        path = f"{name}/{own}"
        rows.write.parquet(f"{folder}/{path}")
        tables[name] = {"paths": [*old["paths"], path], "schema": schema}
    version = before["version"] + 1
    text = json.dumps({"version": version, "tables": tables})
    draft, files = _hadoop(spark, f"{folder}/_manifests/.{own}")
    final, _ = _hadoop(spark, f"{folder}/_manifests/{version:010d}.json")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise ValueError(f"version {version} was published meanwhile")
    return version
