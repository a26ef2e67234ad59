"""Read queries over finished score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sitegauge.functions.scalars import existing, finite_columns, state_prefix
from sitegauge.operators.joins import with_records
from sitegauge.operators.profile import sorted_distinct
from sitegauge.session import small_table
from sitegauge.sources import dimensions as dims
from sitegauge.sources.files import read_table
from sitegauge.sources.fixed_values import SORTABLE_SCORES, STATES


class Page(NamedTuple):
    """Rows of a limited list, and the table before the limit."""

    data: DataFrame
    matching: DataFrame

    def total(self) -> int:
        return self.matching.count()


def in_state(scores: DataFrame, state: str | None, key: str = "county_fips") -> DataFrame:
    """Rows of one state, by its column or, without one, by the code's prefix."""
    if not state:
        return scores
    state = state.upper()
    if "state" in scores.columns:
        return scores.filter(F.col("state") == state)
    prefix = dict(STATES).get(state)
    if prefix and "state_fips" in scores.columns:
        return scores.filter(F.col(key).startswith(prefix))
    return scores


def list_scores(
    scores: DataFrame, min_psi: float = 0, state: str | None = None, sort: str = "psi",
    order: str = "desc", limit: int = 50, key: str = "county_fips",
) -> Page:
    """Scores from ``min_psi`` up in one state, sorted and limited to 1-500 rows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if not 0 <= min_psi <= 100:
        raise ValueError("min_psi must be between 0 and 100")
    found = scores.filter(F.col("psi") >= min_psi) if min_psi > 0 else scores
    found = in_state(found, state, key)
    column = sort if sort in SORTABLE_SCORES and sort in scores.columns else "psi"
    first = F.asc_nulls_last(column) if order.lower() == "asc" else F.desc_nulls_last(column)
    return Page(finite_columns(found.orderBy(first, F.asc(key)).limit(limit)), found)


def score_detail(
    scores: DataFrame, code: str, features: DataFrame | None = None,
    resistance: DataFrame | None = None, key: str = "county_fips",
) -> DataFrame:
    """One location with its raw features and resistance as nested records; empty if unknown."""
    one = F.lit(code.zfill(5)) if isinstance(code, str) else F.lit(code)
    found = finite_columns(scores.filter(F.col(key) == one))
    sides = {}
    if features is not None:
        sides["raw_features"] = (finite_columns(features.filter(F.col(key) == one)), key)
    if resistance is not None:
        side_key = "matched_county_fips" if "matched_county_fips" in resistance.columns else key
        sides["resistance_detail"] = (
            finite_columns(resistance.filter(F.col(side_key) == one)), side_key)
    return with_records(found, key, **sides)


def dimension_breakdown(scores: DataFrame, key: str = "county_fips") -> DataFrame:
    wanted = [key, "state", "power_score", "environmental_score", "social_score", "psi",
              "confidence", "rank"]
    out = finite_columns(scores.select(*existing(scores, wanted)))
    return out.orderBy(F.desc_nulls_last("psi"), F.asc(key)) if "psi" in out.columns else out


def compare(scores: DataFrame, codes: Sequence, key: str = "county_fips") -> DataFrame:
    """Two to five locations side by side; those not found are simply absent."""
    if not 2 <= len(codes) <= 5:
        raise ValueError("give 2 to 5 codes to compare")
    wanted = [c.zfill(5) if isinstance(c, str) else c for c in codes]
    return finite_columns(scores.filter(F.col(key).isin(wanted)))


def scored_states(scores: DataFrame, key: str = "county_fips") -> DataFrame:
    """States with scored locations, sorted."""
    if "state" in scores.columns:
        return sorted_distinct(scores, "state")
    codes = scores.select(state_prefix(key).alias("state_fips")).distinct()
    names = codes.join(dims.states(scores.sparkSession), "state_fips", "left")
    return names.select(F.coalesce("state", "state_fips").alias("state")).orderBy("state")


def topic_list(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.coalesce(F.col("topic_id").cast("int"), F.lit(0)).alias("topic_id"),
        F.coalesce("label", F.lit("")).alias("label"), "top_words")


def validation_summary(
    spark, weights: Mapping | None = None, metrics: Mapping | None = None,
    match_rate: float | None = None, sensitivity: DataFrame | None = None,
    model_version: str | None = None,
) -> DataFrame:
    """One row with everything known about how well the model does."""
    weights, metrics = weights or {}, metrics or {}
    stops, built = weights.get("n_blocked"), weights.get("n_successful")
    row = small_table(spark, [(
        model_version, metrics.get("auc"), weights.get("macro_f1"), metrics.get("p_value"),
        (built or 0) + (stops or 0) if weights else None, {"successful": built, "blocked": stops} if weights else None,
        weights.get("strategy"), match_rate, weights.get("weights"))],
        "model_version string, auc double, macro_f1 double, social_test_p_value double, "
        "n_validation_sites long, class_balance struct<successful: long, blocked: long>, "
        "imbalance_strategy string, geocoding_match_rate double, weights map<string,double>")
    if sensitivity is None:
        return row
    # One entry per pair of weight scenarios.
    pairs = sensitivity.agg(F.array_sort(F.collect_list(F.struct(*sensitivity.columns))).alias("s"))
    return row.withColumn("sensitivity", pairs.scalar())


def stored_summary(spark, folder: str) -> DataFrame:
    """The summary that a run kept under ``folder``; all unknown where there is none."""
    found = read_table(spark, f"{folder.rstrip('/')}/validation_summary")
    return found if found is not None else validation_summary(spark)


def availability(**tables: DataFrame | None) -> dict[str, int]:
    """Rows per table, zero where there is none."""
    return {name: df.count() if df is not None else 0 for name, df in tables.items()}
