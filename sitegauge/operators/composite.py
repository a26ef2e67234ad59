"""The composite suitability score, its confidence and its ranking."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions.scalars import existing, half_even, row_known_share, row_mean
from sitegauge.operators.normalize import normalize
from sitegauge.operators.ranking import with_sequence
from sitegauge.session import small_table
from sitegauge.sources.fixed_values import DIMENSIONS, INVERTED_FEATURES, MODEL_VERSION

Dimensions = Mapping[str, Sequence[str]]


def feature_columns(df: DataFrame, dimensions: Dimensions) -> list[str]:
    return existing(df, [c for cols in dimensions.values() for c in cols])


def dimension_scores(
    df: DataFrame, dimensions: Dimensions, inverted: Iterable[str], keep: Sequence[str],
) -> DataFrame:
    """Mean of each dimension's normalized features; 50 where none of them exists.

    The known-feature share of the raw row is kept as ``confidence``.
    """
    features = feature_columns(df, dimensions)
    total = sum(len(cols) for cols in dimensions.values())
    share = len(features) / total if total else 0.0
    confidence = (half_even(F.lit(share) * row_known_share(features), 3)
                  if features else F.lit(share))
    narrow = df.select(*keep, *features, confidence.alias("confidence"))
    scaled = normalize(narrow, features, [c for c in inverted if c in features])
    scores = [
        (row_mean(existing(df, cols)) if existing(df, cols) else F.lit(50.0)).alias(f"{dim}_score")
        for dim, cols in dimensions.items()]
    return scaled.select(*keep, *scores, "confidence")


def weighted_score(dimensions: Iterable[str], weights: Mapping[str, float]) -> Column:
    """Sum of weight times dimension score; an unknown dimension makes it unknown."""
    parts = [F.lit(float(weights.get(d, 0))) * F.col(f"{d}_score") for d in dimensions]
    return reduce(add, parts) if parts else F.lit(50.0)


def score_locations(
    df: DataFrame, weights: Mapping[str, float], dimensions: Dimensions = DIMENSIONS,
    inverted: Iterable[str] = tuple(INVERTED_FEATURES), key: str = "county_fips",
    ids: Sequence[str] = ("state", "county_name", "lat", "lon", "state_fips"),
    version: str = MODEL_VERSION, ranked: bool = True,
) -> DataFrame:
    """Score every location 0-100, with confidence and, by default, rank.

    Unknown scores come last; equal scores are ordered by key.
    """
    keep = [key, *existing(df, ids)]
    scores = dimension_scores(df, dimensions, inverted, keep)
    out = scores.select(
        *keep, *[f"{d}_score" for d in dimensions],
        weighted_score(dimensions, weights).alias("psi"), "confidence",
        F.lit(version).alias("model_version"),
        F.lit(json.dumps(dict(weights))).alias("weights_used"))
    if not ranked:
        return out
    return with_sequence(out, [F.desc_nulls_last("psi"), F.asc(key)])


def head_and_tail(scores: DataFrame, best: int = 10, worst: int = 5) -> DataFrame:
    """The best and worst locations, numbers rounded for display."""
    shown = [half_even(c, 1).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in scores.dtypes]
    top = scores.orderBy(F.asc("rank")).limit(best).withColumn("part", F.lit("top"))
    low = scores.orderBy(F.desc("rank")).limit(worst).withColumn("part", F.lit("bottom"))
    return top.select(*shown, "part").unionByName(low.select(*shown, "part"))


def weight_shift(
    spark, derived: Mapping[str, float], assumed: Mapping[str, float],
) -> DataFrame:
    """Derived minus assumed weight per dimension."""
    return small_table(
        spark, [(d, float(assumed.get(d, 0)), float(w), float(w) - float(assumed.get(d, 0)))
         for d, w in derived.items()],
        "dimension string, assumed double, derived double, delta double")
