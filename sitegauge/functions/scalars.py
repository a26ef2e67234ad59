"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_code(c: str | Column, width: int = 5) -> Column:
    """Left-pad a code with zeros; longer codes keep all their characters."""
    text = F.trim(col(c).cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def state_prefix(c: str | Column) -> Column:
    return F.substring(col(c), 1, 2)


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a column on either side; null stays null."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.when(c < lower, F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(c > upper, F.lit(upper)).otherwise(out)
    return F.when(c.isNotNull(), out)


def finite(c: str | Column) -> Column:
    """NaN and infinities become null, the only mark for a missing number here."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating point column."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def nonzero(c: str | Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(col(c), F.lit(0.0))


def number(c: str | Column) -> Column:
    """Parse text as a double; what does not parse is null."""
    return finite(col(c).try_cast("double"))


def scale_from(c: str | Column, low: float, width: float) -> Column:
    """Map [low, low + width] to 0-100, clipping what lies outside."""
    return clip((col(c) - low) / width, 0.0, 1.0) * 100


def half_even(c: str | Column, places: int) -> Column:
    """Scale, round to the even neighbour on a tie, and scale back."""
    scale = float(10 ** places)
    return F.rint(col(c) * scale) / scale


def invert(c: str | Column) -> Column:
    return F.lit(100.0) - col(c)


def _known_count(cols: Sequence[Column]) -> Column:
    return reduce(add, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Sum over columns, nulls counted as zero."""
    return reduce(add, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean over the known columns of a row; null if none is known."""
    cols = [col(c) for c in cols]
    return F.try_divide(row_sum(cols), F.nullif(_known_count(cols), F.lit(0)))


def row_known_share(cols: Sequence[str | Column]) -> Column:
    cols = [col(c) for c in cols]
    return _known_count(cols) / F.lit(float(len(cols)))


def first_max_index(cols: Sequence[str | Column]) -> Column:
    """0-based position of the largest column, the first one on ties."""
    values = F.array(*[col(c) for c in cols])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def point(lon: str | Column, lat: str | Column) -> Column:
    """A GeoJSON point, null unless both coordinates are known and not zero."""
    lon, lat = col(lon), col(lat)
    return F.when(
        nonzero(lon).isNotNull() & nonzero(lat).isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")),
    )


# The bounds and labels of the four classes below.
def tier(score: str | Column) -> Column:
    """high from 70, moderate from 50, else low."""
    score = col(score)
    return F.when(score >= 70, "high").when(score >= 50, "moderate").when(score.isNotNull(), "low")


def viable(score: str | Column, threshold: float = 60.0) -> Column:
    return F.when(col(score) >= threshold, 1).otherwise(0)


def stability(tau: str | Column) -> Column:
    tau = col(tau)
    return F.when(tau > 0.8, "STABLE").when(tau > 0.5, "moderate").otherwise("FRAGILE")


def collinearity(r: str | Column) -> Column:
    return F.when(F.abs(col(r)) > 0.85, "CONSIDER DROPPING ONE").otherwise("monitor")


def share_pct(part: str | Column, whole: str | Column) -> Column:
    """100 * part / whole, zero when there is nothing to share."""
    return F.coalesce(F.try_divide(col(part) * 100.0, col(whole)), F.lit(0.0))


def class_ratio(majority: str | Column, minority: str | Column) -> Column:
    return col(majority) / F.greatest(col(minority), F.lit(1))


def with_costly(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is expensive to compute and will be filtered on.

    A filter on a plain column is pushed below it, repeating its expression; a
    one-element generator keeps the filter above, so each value is computed once.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns the table has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
