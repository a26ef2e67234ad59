"""Readers and writers for the files at the edges and between stages."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sitegauge.functions.scalars import pad_code
from sitegauge.session import small_table
from sitegauge.sources import schemas
from sitegauge.sources.fixed_values import FALLBACK_WEIGHTS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark marks a finished write."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS") or (exists(spark, path) and _is_file(spark, path))


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def landed(spark: SparkSession, path: str) -> bool:
    """Whether a table is there to be read, whoever wrote it: other tools leave no mark of a finished write.

    A folder that holds no data, or that Spark was still writing to, does not count.
    """
    if finished(spark, path):
        return True
    if not exists(spark, path):
        return False
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    return "_temporary" not in names and any(not n.startswith(("_", ".")) for n in names)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(schemas.POSTS_RAW).json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, letters beyond ASCII kept as they are."""
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def read_table(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of the Parquet paths that holds a finished table, or None."""
    for path in paths:
        if finished(spark, path):
            return spark.read.parquet(path)
    return None


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, code: str | None = None) -> DataFrame | None:
    """CSV with a header; the code column, if named, is padded back to five digits."""
    if not exists(spark, path):
        return None
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(code, pad_code(code)) if code else df


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame | None:
    return read_csv(spark, path, schemas.CROSSWALK, "county_fips")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def parse_list(column: str) -> F.Column:
    """A JSON text cell back to a list of strings."""
    return F.from_json(F.col(column), "array<string>")


def write_weights(spark: SparkSession, document: Mapping, path: str) -> None:
    """One JSON document with the weights and how they came about."""
    fields = [f.split(" ")[0] for f in schemas.WEIGHTS.split(", ")]
    row = [document.get(f) for f in fields]
    small_table(spark, [row], schemas.WEIGHTS).coalesce(1).write.mode(
        "overwrite").json(path)


def read_weights(spark: SparkSession, path: str) -> dict | None:
    """The weights document, or None where there is none or its write broke off."""
    if not finished(spark, path):
        return None
    row = spark.read.schema(schemas.WEIGHTS).json(path).head()
    return row.asDict() if row else None


def load_weights(spark: SparkSession, path: str) -> dict[str, float]:
    document = read_weights(spark, path)
    return dict(document["weights"]) if document else dict(FALLBACK_WEIGHTS)


def land_payloads(df: DataFrame, path: str) -> None:
    """Keep answers as they came: a key column and the nested record, as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_payloads(spark: SparkSession, path: str, key: str, payload: str) -> DataFrame:
    """Landed answers with their nested record typed by one of the payload schemas."""
    return spark.read.schema(f"{key} string, payload struct<{_colons(payload)}>").json(path)


def read_answers(spark: SparkSession, path: str, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Landed answers that parse, and the others: ``file``, ``line`` and what it holds.

    A line is broken if it is no JSON, or its record has another shape; one broken line costs no other.
    """
    schema = f"{key} string, payload struct<{_colons(payload)}>, _broken string"
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.length(F.trim("value")) > 0)
    read = lines.select("file", "value", F.from_json("value", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    return read.where(~broken).select(f"r.{key}", "r.payload"), read.where(broken).select("file", F.col("value").alias("line"))


def quarantine(broken: DataFrame, path: str) -> DataFrame:
    """Keep broken lines as they came, beside the table they are missing from; the number of them per file."""
    write_table(broken, path)
    kept = broken.sparkSession.read.schema("file string, line string").parquet(path)
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("broken"))


def _colons(fields: str) -> str:
    name, kind = fields.split(" ", 1)
    return f"{name}: {kind}"


def records_per_file(spark: SparkSession, path: str) -> DataFrame:
    """How many records each landed file holds."""
    text = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return text.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("records"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Parquet in ``buckets`` hash buckets of ``key``, one file each: tables with equal buckets join without a shuffle.

    For tables with few rows per key, such as one row per location.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Overwrites, as the other writers do; a table can't be created over files.
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    # The files stay; only this session's name for them goes.
    spark.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed``, with its buckets known to the planner."""
    name = f"bucketed_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)


def input_digest(df: DataFrame) -> str:
    """Digest of what a table would be read from: its plan, and its files' names, sizes and times; no file is opened.

    A table that does not come from files alone is read and digested by content.
    """
    from sitegauge.sources.publish import content_hash

    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    files = sorted(df.inputFiles())
    if not files or any(kind in plan for kind in ("LogicalRDD", "LocalRelation", "InMemoryRelation")):
        return content_hash(df).head().data_hash
    conf = df.sparkSession._jsc.hadoopConfiguration()
    states = []
    for name in files:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(name))
        state = target.getFileSystem(conf).getFileStatus(target)
        states.append(f"{name}:{state.getLen()}:{state.getModificationTime()}")
    return hashlib.sha256("\n".join([plan, *states]).encode()).hexdigest()


def digest(*inputs: DataFrame | None, **parameters) -> str:
    """Digest of a stage's inputs and parameters; unlike parameters or inputs give another one."""
    parts = ["-" if df is None else input_digest(df) for df in inputs]
    parts.append(json.dumps(parameters, sort_keys=True, default=str))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def note(spark: SparkSession, path: str, made_from: str) -> None:
    """Say beside a table what it was made from; done last, so a run cut short before it computes again."""
    spark.range(1).select(F.lit(made_from)).coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.made-from")


def noted(spark: SparkSession, path: str) -> str | None:
    """What a table was made from, if that was noted."""
    place = f"{path.rstrip('/')}.made-from"
    found = spark.read.text(place).head() if finished(spark, place) else None
    return found[0] if found else None


def materialize(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False, made_from: str | None = None,
    write: Callable[[DataFrame, str], None] = write_table, read: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    """Reuse a stage's table if it was written to its end, else compute and write it.

    With ``made_from``, a digest of inputs and parameters, it is reused only if it was made from just these.
    """
    if force or not finished(spark, path) or not (made_from is None or noted(spark, path) == made_from):
        write(compute(), path)
        if made_from is not None:
            note(spark, path, made_from)
    return (read or spark.read.parquet)(path)


def availability(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row count per named table, zero where it is missing."""
    rows = [(name, spark.read.parquet(p).count() if landed(spark, p) else 0)
            for name, p in paths.items()]
    return small_table(spark, rows, "dataset string, n long")


def write_site_lists(spark: SparkSession, folder: str) -> None:
    """The labelled sites as three CSV tables: stopped, built and both."""
    from sitegauge.sources import dimensions as dims

    both = dims.labelled_sites(spark, scored_only=False)
    write_csv(dims.blocked_sites(spark), f"{folder}/cancelled_sites")
    write_csv(dims.built_sites(spark), f"{folder}/successful_sites")
    write_csv(both.select("name", "county_fips", "state", "outcome", "label", "year"),
              f"{folder}/all_validation_sites")


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])
