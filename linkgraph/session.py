"""Session construction and durable intermediate tables.

Iterative operators cut their lineage by writing a parquet table below
``spark.checkpoint.dir``.  A written table survives the loss of any executor,
is columnar, and carries a file size, so Catalyst broadcasts it only while
that measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Held so that a local run's own scratch folder is removed at interpreter exit.
_local_scratch: list[tempfile.TemporaryDirectory] = []


def local_session(app_name: str = "linkgraph", cores: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster supplies its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        holder = tempfile.TemporaryDirectory(prefix="linkgraph-")
        _local_scratch.append(holder)
        root = holder.name
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused location below the scratch root."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/linkgraph/{app}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system it names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


class Written(NamedTuple):
    """A durable table and the number of rows its write observed."""

    table: DataFrame
    rows: int


def write_counted(df: DataFrame, label: str) -> Written:
    """Write ``df`` once and learn its row count from the same job."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), int(seen.get["rows"]))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the scratch root and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
