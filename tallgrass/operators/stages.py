"""A run of named stages over tables, each written before the next reads it, so that a run can go on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[SparkSession, DataFrame], DataFrame]]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_stages(spark: SparkSession, start: DataFrame, stages: list[Stage], folder: str) -> tuple[DataFrame, list[str]]:
    """The last stage's table, and the names of the stages that ran now; those with a finished table in the folder are skipped."""
    rows, ran = start, []
    for number, (name, stage) in enumerate(stages):
        path = f"{folder}/{number:02d}-{name}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            stage(spark, rows).write.mode("overwrite").parquet(path)
            ran.append(name)
        rows = spark.read.parquet(path)
    return rows, ran
