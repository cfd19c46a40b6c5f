"""The Spark session of tests, benchmarks and examples, and the folder that its executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow, as many shuffle partitions as CPUs unless told otherwise."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: what follows does not compute it anew."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
