"""Joins and set operations.

Only equi-joins are needed.  Sides of fixed size are local relations that Spark
broadcasts by itself; all others are left to its own size rule, so a side that
outgrows the limit is shuffled instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions.text import lookup_key
from sitegauge.operators.skew import salted_join


def left_chain(spine: DataFrame, key: str, *sides: DataFrame | None) -> DataFrame:
    """Left-join several tables on the same key; missing or column-less sides are skipped."""
    out = spine
    for side in sides:
        if side is not None and len(side.columns) > 1:
            out = out.join(side, key, "left")
    return out


def left_renamed(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on keys of different names; both key columns stay."""
    if left_key == right_key:
        return left.join(right, left_key, "left")
    return left.join(right, left[left_key] == right[right_key], "left")


def inner_suffixed(
    left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Inner join, many to one; other columns present on both sides get suffixes.

    Keys with very many rows on the left are spread over several tasks.
    """
    shared = [c for c in left.columns if c in set(right.columns) and c != key]
    for c in shared:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return salted_join(left, right, [key])


def with_records(spine: DataFrame, key: str, **sides: tuple[DataFrame, str]) -> DataFrame:
    """Attach each side's matching row as a nested record, null where there is none."""
    out = spine
    for name, (side, side_key) in sides.items():
        record = side.select(
            F.col(side_key).alias(key), F.struct(*side.columns).alias(name))
        out = out.join(record, key, "left")
    return out


def override(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of ``over`` replace all rows of ``base`` with the same key."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over)


def absent(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``known``."""
    return df.join(known.select(*keys), list(keys), "left_anti")


def labelled_union(*parts: tuple[DataFrame, dict[str, object]]) -> DataFrame:
    """Union by name after adding constant columns to each part."""
    frames = []
    for df, constants in parts:
        for name, value in constants.items():
            df = df.withColumn(name, F.lit(value))
        frames.append(df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, which must be unique within a key.

    The smallest order per key is a small aggregate; the wide rows are matched
    on key and order together, so a key with very many rows is spread out.
    """
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).select(
        key, *[F.col(f"_first.{c}").alias(c) for c in order])
    return df.join(firsts, [key, *order], "left_semi")


def ordered_lists(df: DataFrame, key: str, value: str, pos: str, out: str) -> DataFrame:
    """Distinct values per key as an array, by first position."""
    firsts = df.groupBy(key, value).agg(F.min(pos).alias("_pos"))
    packed = F.array_sort(F.collect_list(F.struct("_pos", value)))
    return firsts.groupBy(key).agg(F.transform(packed, lambda s: s[value]).alias(out))


def distinct_in_order(df: DataFrame, key: str, name: str, pos: str, keep: Sequence[str] = ()) -> DataFrame:
    """First occurrence of each name per key, letter case ignored; ``keep`` columns are those of the key."""
    firsts = df.groupBy(key, *keep, F.lower(name).alias("_folded")).agg(
        F.min(F.struct(pos, name)).alias("_first"))
    return firsts.select(
        key, *keep, F.col(f"_first.{pos}").alias(pos), F.col(f"_first.{name}").alias(name))


def first_known(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The first non-null value per key in position order."""
    return (df.filter(F.col(value).isNotNull())
            .groupBy(key).agg(F.min_by(value, pos).alias(value)))


def with_cached(
    df: DataFrame, cache: DataFrame, place: str, hint: str, computed: Column, out: str,
) -> DataFrame:
    """Take the cached answer, hit or miss, where there is one; else the computed one."""
    known = cache.select(
        F.col("key").alias("_key"), F.col("fips").alias("_cached"), F.lit(True).alias("_seen"))
    probed = salted_join(df.withColumn("_key", lookup_key(place, hint)), known, ["_key"], "left")
    answer = F.when(F.col("_seen"), F.col("_cached")).otherwise(computed)
    return probed.withColumn(out, answer).drop("_key", "_cached", "_seen")


def cache_rows(df: DataFrame, place: str, hint: str, answer: str) -> DataFrame:
    """Answers as cache rows, one per key, misses kept as null."""
    return df.groupBy(lookup_key(place, hint).alias("key")).agg(F.max(answer).alias("fips"))
