"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "sitegauge", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    # local-cluster has executors of its own, which don't share the driver's folders.
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="sitegauge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so later passes over the result neither repeat the work
    behind it nor depend on any executor that did it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table scan over all cores when its files are too few to do so.

    For work that is heavy per row, such as long texts.  A scan that already has
    a task per core, as any large table, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


#: Bytes of stored texts that one task should take apart into words, and into how many parts a split may go.
TASK_BYTES, MOST_PARTS = 4 << 20, 32


def dealt(df: DataFrame) -> DataFrame:
    """Deal texts over tasks of bounded size, for work whose rows are many times the text, such as counting terms.

    A split of a scan may hold 128 MB of stored texts; the words and pairs of as many would not fit a task's memory.
    """
    splits = df.rdd.getNumPartitions()
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(MOST_PARTS * splits, -(-stored // TASK_BYTES))
    return df if parts <= splits else df.repartition(parts)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few rows, already in hand, as a DataFrame; they are written into the plan."""
    names = [f.name for f in spark.range(0).select(
        F.from_json(F.lit("[]"), f"array<struct<{schema}>>").alias("r")).schema["r"].dataType.elementType]
    records = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(records), f"array<struct<{schema}>>")))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
