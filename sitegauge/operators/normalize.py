"""Adaptive normalization of numeric columns to 0-100.

One wide aggregate reads count, mean, spread and skewness of every column;
columns that are not heavily skewed then need nothing but arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions.scalars import clip, invert, numeric_columns
from sitegauge.operators.profile import skew_g1
from sitegauge.operators.ranking import value_ranges, with_average_rank
from sitegauge.session import small_table
from sitegauge.sources.fixed_values import ID_COLUMNS

SKEW_LIMIT = 2.0


class ColumnStats(NamedTuple):
    n: int
    mean: float | None
    std: float | None
    skew: float | None

    @property
    def method(self) -> str:
        if self.n < 2:
            return "too_few"
        if self.skew is not None and abs(self.skew) > SKEW_LIMIT:
            return "percentile"
        return "z-score"


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"),
                 F.stddev_pop(v).alias(f"s{i}"), skew_g1(c).alias(f"g{i}")]
    row = df.agg(*aggs).head()
    return {c: ColumnStats(row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"g{i}"])
            for i, c in enumerate(columns)}


def z_score_100(c: str, stats: ColumnStats) -> Column:
    """z clipped to [-3, 3] and mapped to 0-100; a constant column gives null."""
    if not stats.std:
        return F.lit(None).cast("double")
    z = clip((F.col(c).cast("double") - stats.mean) / stats.std, -3.0, 3.0)
    return (z + 3.0) / 6.0 * 100.0


def normalize(
    df: DataFrame, columns: Sequence[str], inverted: Iterable[str] = (),
    fill_too_few: bool = True,
) -> DataFrame:
    """Replace the columns by their 0-100 form, higher being worse turned around.

    A column with fewer than two values keeps a lone value as it is; its nulls
    become 50 unless ``fill_too_few`` is off.
    """
    stats = column_stats(df, columns)
    skewed = [c for c in columns if stats[c].method == "percentile"]
    out = df
    if skewed:
        ranges = value_ranges(df, skewed)
        for c in skewed:
            out = with_average_rank(out, c, f"_pct_{c}", percent=True, ranges=ranges)
    inverted = set(inverted)
    exprs = []
    for c in df.columns:
        if c not in stats:
            exprs.append(F.col(c))
            continue
        method = stats[c].method
        if method == "percentile":
            value = F.col(f"_pct_{c}")
        elif method == "z-score":
            value = z_score_100(c, stats[c])
        elif fill_too_few:
            value = F.coalesce(F.col(c).cast("double"), F.lit(50.0))
        else:
            value = F.col(c)
        exprs.append((invert(value) if c in inverted else value).alias(c))
    return out.select(*exprs)


def normalize_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Normalize every numeric column but the identifying ones.

    Columns with fewer than two values are left as they are.
    """
    columns = numeric_columns(df, [*exclude, *ID_COLUMNS])
    return normalize(df, columns, fill_too_few=False)


def normalization_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness and chosen method per column."""
    stats = column_stats(df, columns)
    return small_table(
        df.sparkSession, [(c, s.skew, s.method) for c, s in stats.items()],
        "column string, skew double, method string")


def normalize_dimension(df: DataFrame, column: str, inverted: bool = False) -> DataFrame:
    return normalize(df, [column], [column] if inverted else [])
