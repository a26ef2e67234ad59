"""Counting, describing and correlating columns, one wide aggregate at a time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions.scalars import clip, col, collinearity, half_even, numeric_columns
from sitegauge.operators.ranking import quantiles
from sitegauge.session import small_table


def skew_g1(c: str | Column) -> Column:
    """Bias-corrected skewness: null below three values, zero for a constant."""
    c = col(c).cast("double")
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    constant = F.coalesce(F.var_pop(c), F.lit(0.0)) * n < 1e-14
    return F.when(n < 3, F.lit(None).cast("double")).when(constant, F.lit(0.0)).otherwise(
        F.skewness(c) * factor)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation over rows where both are known; null if either is constant there."""
    a, b = col(a).cast("double"), col(b).cast("double")
    left, right = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return clip(F.try_divide(F.covar_pop(left, right), spread), -1.0, 1.0)


def null_pct(c: str | Column) -> Column:
    missing = F.avg(F.when(col(c).isNull(), 1.0).otherwise(0.0)) * 100.0
    return half_even(missing, 1)


def drop_all_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that hold no value at all."""
    columns = list(columns or df.columns)
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).head()
    return df.drop(*[c for c in columns if seen[c] == 0])


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, max, null share and skewness: one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"),
                 F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                 F.max(v).alias(f"max{i}"), null_pct(c).alias(f"null{i}"),
                 skew_g1(c).alias(f"skew{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                 F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                 F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
                 F.col(f"null{i}").alias("null_pct"), F.col(f"skew{i}").alias("skew"))
        for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(rows))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The profile with exact quartiles."""
    columns = list(columns or numeric_columns(df))
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return column_profile(df, columns).join(quarters, "column", "left")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature_1, feature_2, r for every column pair in column order."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    if not pairs:
        return small_table(df.sparkSession, [], "feature_1 string, feature_2 string, r double")
    wide = df.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                 F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per feature and one column per feature, mirrored, 1 on the diagonal."""
    columns = list(columns or numeric_columns(df))
    at = {frozenset(p): i for i, p in enumerate(combinations(columns, 2))}
    wide = df.agg(
        *[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(combinations(columns, 2))],
        *[F.when(F.stddev_pop(c) > 0, 1.0).alias(f"one{j}") for j, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("feature"), *[
            F.col(f"one{j}" if a == b else f"r{at[frozenset((a, b))]}").alias(b)
            for j, b in enumerate(columns)])
        for a in columns])
    return wide.select(F.inline(rows))


def collinear_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs beyond the threshold, strongest first, with a note on how strong."""
    return (
        pairs.filter(F.abs("r") > threshold)
        .select("feature_1", "feature_2", half_even("r", 4).alias("r"),
                collinearity("r").alias("action"))
        .orderBy(F.desc(F.abs("r")), "feature_1", "feature_2"))


# Wording of the recommendations.
DROP_ONE = "DROP '%s' (near-duplicate of '%s', r=%+.3f)"
COMBINE = "COMBINE '%s' and '%s' into composite feature, or monitor"
KEEP_BOTH = "KEEP both"


def recommend(pairs: DataFrame, priority: Sequence[str]) -> DataFrame:
    """What to do about each pair: drop one, combine, or keep both."""
    strength = F.abs("r")
    keep = F.when(F.col("feature_1").isin(list(priority)), F.col("feature_1")).otherwise(
        F.col("feature_2"))
    drop = F.when(keep == F.col("feature_1"), F.col("feature_2")).otherwise(F.col("feature_1"))
    text = (
        F.when(strength > 0.9, F.format_string(DROP_ONE, drop, keep, F.col("r")))
        .when(strength > 0.7, F.format_string(COMBINE, F.col("feature_1"), F.col("feature_2")))
        .otherwise(KEEP_BOTH))
    return pairs.select("feature_1", "feature_2", "r", text.alias("recommendation"))


def value_shares(df: DataFrame, *columns: str) -> DataFrame:
    """How often each combination occurs and its percentage of all rows.

    The total is summed over the counted groups, not over the rows again.
    """
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total.scalar())


def match_rate(df: DataFrame, matched: str, alarm_below: float = 60.0) -> DataFrame:
    """total, matched, unmatched, rate in percent, and whether the rate is too low."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count(matched).alias("matched"))
    rate = F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")).otherwise(0.0)
    return counts.select(
        "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"),
        rate.alias("rate"), (rate < alarm_below).alias("below_alarm"))


def list_frequency(df: DataFrame, items: str, out: str = "item") -> DataFrame:
    """How often each element occurs over all lists."""
    return df.select(F.explode(items).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins are kept."""
    v = F.col(column).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).head()
    spark = df.sparkSession
    if low is None:
        return small_table(spark, [], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    place = F.least(F.floor((v - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * step).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * step).alias("high"))
    return edges.join(F.broadcast(counts), "bin", "left").select(  # at most one row per bin
        "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def length_spread(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and upper-median length, overall or per group."""
    middle = quantiles(df, [length], [0.5], by, rule="upper").select(
        *by, F.col("q0").cast("long").alias("median_length"))
    ends = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("min_length"),
        F.max(length).alias("max_length"))
    return ends.join(middle, list(by), "left") if by else ends.withColumn(
        "median_length", middle.select("median_length").scalar())


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the column's exact median."""
    gaps = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).head()
    open_columns = [c for c in columns if gaps[c]]
    if not open_columns:
        return df
    rows = quantiles(df, open_columns, [0.5]).collect()  # one row per column
    return df.fillna({r["column"]: r["q0"] for r in rows if r["q0"] is not None})


def group_signal(df: DataFrame, key: str, signal: str, sentiment: str) -> DataFrame:
    """Mean, max, count and spread of a signal, mean sentiment and share of negatives per group.

    All partial aggregates, so a very large group is combined before it moves.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(signal).alias("raw_resistance_mean"),
        F.max(signal).alias("raw_resistance_max"),
        F.count(signal).alias("post_count"),
        F.stddev_samp(signal).alias("std_resistance"),
        F.avg(sentiment).alias("avg_sentiment"),
        (F.avg(F.when(F.col(sentiment) < -0.05, 1.0).otherwise(0.0)) * 100.0).alias("negative_pct"),
    )


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Rows, mean score, how many reach 70 and how many stay below 50."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"),
        F.count_if(F.col(score) >= 70).alias("n_high"),
        F.count_if(F.col(score) < 50).alias("n_low"))
