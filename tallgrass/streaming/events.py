"""Events as streams: staged by time, deduplicated within a watermark, and counted by windows; states and deadlines are in advance.py."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_events(spark: SparkSession, path: str, files: int = 8, time: str = "ts") -> DataFrame:
    """A stream of a table's files (one file, or a folder of part files), the earlier written first, with event times in UTC."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        # A stream takes a single file only as what a pattern finds.
        path = re.sub(r"([{}\[\]?*\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def slice_files(spark: SparkSession) -> int:
    """Files of a slice of a staged table."""
    return max(8, spark.sparkContext.defaultParallelism)


def staged(rows: DataFrame, path: str, slices: int = 10, time: str = "ts") -> tuple[str, int]:
    """Writes a table as the files of a stream, slice by slice of its time span, and a closing row; returns the delay in which no row is late, and the span's end in microseconds.

    Within a slice rows stand in any order, in slice_files at most: whoever reads
    as many at once has no more batches for a longer table.  The closing row has a time beyond
    the end and nulls elsewhere; it lets the watermark pass the end.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        rows.limit(0).write.parquet(path)
        return "1 hour", 0
    width = (high - low) // slices + 1
    for k in range(slices):
        part = rows.filter((at >= low + k * width) & (at < low + (k + 1) * width))
        part.coalesce(slice_files(rows.sparkSession)).write.mode("append").parquet(path)
    delay = width // 1_000_000 + 3600
    kind = rows.schema[time].dataType
    closing = F.timestamp_micros(F.lit(high + delay * 1_000_000 + 86_400_000_000))
    one = rows.sparkSession.range(1).select(*[(closing.cast(kind) if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    one.coalesce(1).write.mode("append").parquet(path)
    return f"{delay} seconds", high


def dedupe_key() -> F.Column:
    """A digest of what makes an event the same one."""
    return F.substring(F.sha1(F.concat_ws("|", "event_type", "user_id", F.date_trunc("hour", "ts").cast("string"))), 1, 20)


def deduplicated(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first of the events of one key; the state of a key is dropped when the watermark passes it."""
    return events.withColumn("dedupe_key", dedupe_key()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def windowed(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_to_table(rows: DataFrame, path: str, mode: str, keys: list[str] | None = None, each: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into a Parquet table beside its checkpoint; with keys the latest row of each stays.

    each: what becomes of a batch, given the latest rows of the batches before it (None: the first); schema: of its result.
    """
    spark = rows.sparkSession
    schema = schema or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def latest(spark: SparkSession, before: int | None = None) -> DataFrame:
        found = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "true").parquet(f"{path}/rows")
        if before is not None:
            found = found.filter(F.col("batch") < before)
        names = [n for n in found.columns if n != "batch"]
        if keys:
            found = found.groupBy(*keys).agg(F.max_by(F.struct(*[n for n in names if n not in keys]), "batch").alias("v")).select(*keys, "v.*")
        return found.select(*names)

    def write(batch: DataFrame, number: int) -> None:
        if each:
            batch = each(batch, latest(batch.sparkSession, number) if number else None)
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/batch={number:08d}")

    # Each partition of a store costs a load, a worker and a commit in every batch, however little it holds: as many as run at once will do.
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), slice_files(spark))))
    try:
        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return latest(spark)
