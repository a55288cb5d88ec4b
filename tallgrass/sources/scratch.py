"""Where queries may keep tables: the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or, where that is unset as in tests, in a folder of this process, which only a session on one machine can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="tallgrass-"))
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again, where it is used more than once or a lost executor would cost much."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
