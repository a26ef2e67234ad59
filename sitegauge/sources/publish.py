"""Versioned, repeatable publishing of score tables as Parquet.

A publish folder holds ``scores`` and ``locations`` partitioned by version and a
``model_versions`` registry.  The registry is append-only: the last entry is the
active one, so nothing is rewritten to deactivate its predecessors.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sitegauge.functions.scalars import finite_columns, pad_code, point
from sitegauge.session import small_table
from sitegauge.sources import schemas
from sitegauge.sources.files import exists


def _hashable(field: T.StructField) -> Column:
    """A value as its length and text, so that neighbours can't run together; null as its own mark."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    c = F.col(field.name)
    text = F.to_json(c) if isinstance(field.dataType, nested) else c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null"))


def content_hash(df: DataFrame) -> DataFrame:
    """Twelve hex digits that depend on the rows but not on their order.

    The two halves of each row's MD5 (60 bits of each) are summed, so the table is read
    once and only three numbers per task travel.
    """
    row = F.md5(F.concat_ws("|", *[_hashable(f) for f in sorted(df.schema, key=lambda f: f.name)]).cast("binary"))
    first, second = (F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17))
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(first), F.lit(0)).cast("string").alias("a"),
        F.coalesce(F.sum(second), F.lit(0)).cast("string").alias("b"))
    names = ",".join(sorted(df.columns))
    digest = F.sha2(F.concat_ws("|", F.lit(names), F.col("n").cast("string"), "a", "b"), 256)
    return sums.select(F.substring(digest, 1, 12).alias("data_hash"), F.col("n").alias("n_rows"))


def read_registry(spark, folder: str) -> DataFrame:
    """All published versions; only the newest is active."""
    path = f"{folder}/model_versions"
    if not exists(spark, path):
        return small_table(spark, [], schemas.MODEL_VERSIONS)
    entries = spark.read.schema(schemas.MODEL_VERSIONS).parquet(path)
    newest = entries.agg(F.max("seeded_at"))
    return entries.withColumn("is_active", F.col("seeded_at") == newest.scalar())


def publish(
    scores: DataFrame, folder: str, version: str, weights: Mapping[str, float] | None = None,
    locations: DataFrame | None = None, key: str = "county_fips",
) -> dict:
    """Publish once per (version, content); a repeat does nothing.

    The rows of this version are replaced as one partition, others stay.
    """
    spark = scores.sparkSession
    scores = finite_columns(scores.withColumn(key, pad_code(key)))
    hashed = content_hash(scores).head()
    data_hash, n_rows = hashed["data_hash"], hashed["n_rows"]
    known = read_registry(spark, folder).filter(
        (F.col("model_version") == version) & (F.col("data_hash") == data_hash))
    if known.limit(1).count():
        return {"published": False, "model_version": version, "data_hash": data_hash,
                "n_locations": n_rows}
    if weights is None and "weights_used" in scores.columns:
        first = scores.select("weights_used").head()
        weights = json.loads(first[0]) if first and first[0] else {}
    _replace_version(
        scores.withColumn("_data_hash", F.lit(data_hash)), f"{folder}/scores", version)
    if locations is not None:
        places = finite_columns(locations.withColumn(key, pad_code(key)))
        if {"lat", "lon"} <= set(places.columns):
            places = places.withColumn("coordinates", point("lon", "lat"))
        _replace_version(places, f"{folder}/locations", version)
    entry = spark.range(1).select(
        F.lit(version).alias("model_version"), F.lit(data_hash).alias("data_hash"),
        F.current_timestamp().alias("seeded_at"), F.lit(n_rows).cast("long").alias("n_locations"),
        F.from_json(F.lit(json.dumps(dict(weights or {}))), "map<string,double>").alias("weights"),
        F.lit(True).alias("is_active"))
    # Registered last: a publish cut short is simply done again.
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/model_versions")
    return {"published": True, "model_version": version, "data_hash": data_hash,
            "n_locations": n_rows}


def _replace_version(df: DataFrame, path: str, version: str) -> None:
    (df.withColumn("_model_version", F.lit(version))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_model_version").parquet(path))


def active_scores(spark, folder: str) -> DataFrame:
    """Scores of the active version; only its partition is read."""
    active = read_registry(spark, folder).filter("is_active").select("model_version").head()
    found = spark.read.parquet(f"{folder}/scores").schema
    text_version = T.StructType([  # a version such as 1.0 must not turn into a number
        T.StructField(f.name, T.StringType()) if f.name == "_model_version" else f for f in found])
    scores = spark.read.schema(text_version).parquet(f"{folder}/scores")
    return scores.filter(F.col("_model_version") == (active[0] if active else ""))
