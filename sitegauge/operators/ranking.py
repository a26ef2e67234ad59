"""Ranks, running totals and exact quantiles over a whole table.

An unpartitioned window would pull the table into one task.  Here a column is
first cut into value ranges with approximate quantiles (an aggregate of fixed
size); running totals are then formed inside each range and shifted by the
range's offset.  Equal values are counted together before anything is sorted,
so one very frequent value is a single row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitegauge.session import shuffle_width, stage

MAX_RANGES = 4096


class ValueRanges:
    """Cut points of some numeric columns, and the values so frequent that they span ranges."""

    def __init__(self, splits: dict[str, list[float]], hot: dict[str, list[float]], salts: int):
        self.splits = splits
        self.hot = hot
        self.salts = salts


def value_ranges(df: DataFrame, columns: Sequence[str]) -> ValueRanges:
    """Cut points for each column, read as one row from one pass over the table.

    A value holding more than two ranges' share of the rows shows up twice or
    more among the quantiles; those are remembered as hot.
    """
    width = shuffle_width(df.sparkSession)
    ranges = max(8, min(MAX_RANGES, 2 * width))
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), probs, F.lit(20 * ranges)).alias(f"q{i}")
        for i, c in enumerate(columns)
    ]).head()
    splits, hot = {}, {}
    for i, c in enumerate(columns):
        cuts = [v for v in (row[i] or []) if math.isfinite(v)]
        distinct = sorted(set(cuts))
        splits[c] = [-math.inf, *distinct, math.inf]
        hot[c] = [v for v in distinct if cuts.count(v) > 1]
    return ValueRanges(splits, hot, min(1024, max(2, width)))


def with_range(df: DataFrame, column: str, ranges: ValueRanges, out: str = "_range") -> DataFrame:
    """Add the number of the value range a row falls into; null values get the last one."""
    if len(ranges.splits[column]) < 3:  # no known value, or none that is finite
        return df.withColumn(out, F.lit(0))
    as_double = df.withColumn("_as_double", F.col(column).cast("double"))
    cut = Bucketizer(splits=ranges.splits[column], inputCol="_as_double", outputCol=out,
                     handleInvalid="keep")
    return cut.transform(as_double).withColumn(out, F.col(out).cast("int")).drop("_as_double")


def with_preceding(
    counts: DataFrame, value: str, weights: Sequence[str], by: Sequence[str] = (),
    range_col: str = "_range",
) -> DataFrame:
    """For each weight add ``<w>_before`` (sum over smaller values) and ``<w>_total``.

    ``counts`` holds one row per (by, value) and the number of its value range;
    rows without a group drop out, as in any equi-join.  The only window without a range key runs over one row per range.
    """
    cell = [*by, range_col]
    # The join below would add these filters to one branch only; stated here, both
    # branches plan the same exchange and the counts are formed once.
    counts = counts.dropna(subset=[*cell, value])
    per_range = counts.groupBy(*cell).agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    lower = Window.partitionBy(*by).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_range.select(
        *cell,
        *[F.coalesce(F.sum(f"_{w}").over(lower), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(f"_{w}").over(whole).alias(f"{w}_total") for w in weights],
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most MAX_RANGES + 1 rows
    inside = Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_inside") for w in weights])
    joined = summed.join(offsets, cell)
    return joined.select(
        *counts.columns,
        *[(F.col(f"_{w}_offset") + F.col(f"_{w}_inside")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def value_counts_ranked(
    df: DataFrame, value: str, by: Sequence[str] = (), ranges: ValueRanges | None = None,
) -> DataFrame:
    """One row per (by, value): how many rows hold it, how many come before, how many there are.

    Columns: by, value, n, n_before, n_total.  Nulls are left out.
    """
    known = df.filter(F.col(value).isNotNull())
    ranges = ranges or value_ranges(known, [value])
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = with_range(counts, value, ranges)
    return with_preceding(counts, value, ["n"], by).drop("_range")


def average_rank(descending: bool = False) -> Column:
    """Mean rank of equal values, from n, n_before and n_total."""
    if descending:
        return F.col("n_total") - F.col("n_before") - (F.col("n") - 1) / 2.0
    return F.col("n_before") + (F.col("n") + 1) / 2.0


def hot_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, ranges: ValueRanges,
    how: str = "left",
) -> DataFrame:
    """Join a table to one row per key, spreading hot and missing values over many tasks.

    Rows of ``left`` with a hot value take a salt from their input partition;
    the matching right rows, few by construction, are repeated per salt.
    """
    hot = ranges.hot[value]
    spread = F.col(value).isNull()
    if hot:
        spread = spread | F.col(value).isin(hot)
    salted = left.withColumn(
        "_salt", F.when(spread, F.spark_partition_id() % ranges.salts).otherwise(F.lit(0)))
    copies = F.array(F.lit(0))
    if hot:
        copies = F.when(F.col(value).isin(hot), F.sequence(F.lit(0), F.lit(ranges.salts - 1))
                        ).otherwise(copies)
    repeated = right.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def with_average_rank(
    df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False,
    percent: bool = False, ranges: ValueRanges | None = None,
) -> DataFrame:
    """Rank rows by a column, equal values sharing their mean rank; null has no rank.

    ``percent`` gives 100 * rank / number of known values.  The table is read
    for its ranges, its counts and the result: stage it first if it is costly.
    """
    ranges = ranges or value_ranges(df, [value])
    rank = average_rank(descending)
    if percent:
        rank = rank / F.col("n_total") * 100.0
    ranked = value_counts_ranked(df, value, by, ranges).select(*by, value, rank.alias(out))
    columns = [c for c in df.columns if c != out]
    joined = hot_safe_join(df.select(*columns), ranked, [*by, value], value, ranges)
    return joined.select(*columns, out)


def with_sequence(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Number the rows 1..N in the given order.

    Spark's range sort spreads the rows; the sorted table is staged with the
    position of each row inside its sort partition, and the partitions' offsets
    (one row per partition) are added on reading it back.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed, "sequence")
    part = F.shiftright(F.col("_place"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per sort partition
        .select(*df.columns, (F.col("_offset") + inside + 1).cast("long").alias(out))
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
    rule: str = "linear",
) -> DataFrame:
    """Exact quantiles of several columns: one row per (by, column) with q0, q1, ...

    ``linear`` interpolates between neighbours; ``upper`` takes the value at
    0-based position floor(n * p), so p = 0.5 is the upper median.
    """
    ranges = value_ranges(df, columns)
    narrow = df.select(*by, *columns)
    for c in columns:
        narrow = with_range(narrow, c, ranges, f"_range_{c}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                 F.col(f"_range_{c}").alias("_range")) for c in columns])
    long = narrow.select(*by, F.inline(cells)).filter(F.col("value").isNotNull())
    keys = [*by, "column"]
    placed = _around(long, probs, rule) if not by else with_preceding(
        long.groupBy(*keys, "_range", "value").agg(F.count(F.lit(1)).alias("n")), "value", ["n"], keys)

    def at(position: Column) -> Column:
        hit = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    picks, outs = [], []
    for i, p in enumerate(probs):
        place = _position(p, rule)
        if rule == "upper":
            picks.append(at(place).alias(f"q{i}"))
            outs.append(F.col(f"q{i}"))
        else:
            picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"),
                      F.max(place - F.floor(place)).alias(f"_part{i}")]
            outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
                         * F.col(f"_part{i}")).alias(f"q{i}"))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *outs)


def _position(p: float, rule: str) -> Column:
    """0-based place of a quantile among n_total sorted values."""
    if rule == "upper":
        return F.least(F.floor(F.col("n_total") * F.lit(p)), F.col("n_total") - 1)
    return (F.col("n_total") - 1) * F.lit(float(p))


def _around(long: DataFrame, probs: Sequence[float], rule: str) -> DataFrame:
    """Value counts of only those ranges that hold a wanted quantile.

    A first pass counts rows per range; all others never reach a shuffle.
    """
    by_column = Window.partitionBy("column")
    lower = by_column.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = long.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_size")).select(
        "*", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_size").over(by_column).alias("n_total"))
    inside = F.lit(False)
    for p in probs:
        for place in (F.floor(_position(p, rule)), F.ceil(_position(p, rule))):
            inside = inside | ((F.col("_offset") <= place) & (place < F.col("_offset") + F.col("_size")))
    needed = F.broadcast(sizes.filter(inside).drop("_size"))  # at most two ranges per quantile
    counts = long.join(needed, ["column", "_range"]).groupBy(
        "column", "_range", "_offset", "n_total", "value").agg(F.count(F.lit(1)).alias("n"))
    smaller = (Window.partitionBy("column", "_range").orderBy("value")
               .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn(
        "n_before", F.col("_offset") + F.coalesce(F.sum("n").over(smaller), F.lit(0)))


def top_k(df: DataFrame, order: str, k: int, key: str, smallest: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) value, ties broken by key."""
    first = F.asc_nulls_last(order) if smallest else F.desc_nulls_last(order)
    return df.orderBy(first, F.asc(key)).limit(k)


def top_k_with_ties(df: DataFrame, order: str, k: int) -> DataFrame:
    """The k largest and every row equal to the last of them."""
    bar = (df.filter(F.col(order).isNotNull()).select(order)
           .orderBy(F.desc(order)).limit(k).agg(F.min(order)))
    return df.filter(F.col(order) >= bar.scalar())


def rank_movers(
    df: DataFrame, before: str, after: str, k: int | None = None,
) -> DataFrame:
    """Descending ranks by two columns, their difference, and optionally the k biggest climbs."""
    ranges = value_ranges(df, [before, after])
    ranked = with_average_rank(df, before, "raw_rank", descending=True, ranges=ranges)
    ranked = with_average_rank(ranked, after, "corrected_rank", descending=True, ranges=ranges)
    moved = ranked.withColumn("rank_change", F.col("raw_rank") - F.col("corrected_rank"))
    # Finding the k-th value and picking the rows are two passes over the ranks.
    return moved if k is None else top_k_with_ties(stage(moved, "movers"), "rank_change", k)
