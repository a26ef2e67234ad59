"""Joins that stay even when a few keys hold most of the rows.

A frequent-items sketch of fixed size finds the hot keys of the larger side in one aggregate.  Exactly those keys are
salted: their rows are dealt over as many parts as they are heavy, and the other side's rows of these keys are repeated
for each part.  All other keys are joined as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.session import shuffle_width

#: Keys that the sketch names at most, and that it keeps track of; both are fixed.
HOT_KEYS, TRACKED = 64, 4096
#: Parts that a hot key gets per shuffle partition it would fill.
GRAINS = 8


def _mark(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], width: int | None = None) -> dict[int, int]:
    """Hash of each key with more rows than a fair share of ``width`` tasks, and the number of parts to deal it over."""
    width = width or shuffle_width(df.sparkSession)
    top, n = df.select(_mark(keys).alias("mark")).agg(
        F.call_function("approx_top_k", "mark", F.lit(HOT_KEYS), F.lit(TRACKED)), F.count(F.lit(1))).head()
    fair = max(1.0, n / width)
    return {r["item"]: max(2, int(GRAINS * r["count"] / fair)) for r in top or () if r["count"] > fair / 2 and r["count"] > 1}


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; ``left`` may have any number of rows per key, ``right`` few.  ``how``: inner, left, semi or anti."""
    hot = hot_keys(left, keys)
    if not hot:
        return left.join(right, list(keys), how)
    parts = F.create_map(*[F.lit(x).cast(t) for mark, n in hot.items() for x, t in ((mark, "long"), (n, "int"))])

    def of(df: DataFrame) -> DataFrame:
        # Looked up once per row.
        return df.withColumn("_parts", F.coalesce(F.try_element_at(parts, _mark(keys)), F.lit(1)))

    salt = F.pmod(F.monotonically_increasing_id(), F.col("_parts").cast("long")).cast("int")
    salted = of(left).withColumn("_salt", F.when(F.col("_parts") > 1, salt).otherwise(F.lit(0))).drop("_parts")
    repeated = of(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
