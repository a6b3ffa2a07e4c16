"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only in a local session without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("pressmill.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("pressmill.scratch", base)
    return f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once: written to shared storage and read from there, so no later step evaluates it again or depends on
    the executors that did."""
    path, conf = scratch_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")  # what was shuffled for this write isn't read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
