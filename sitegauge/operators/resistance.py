"""Social resistance per county, corrected for how few people may be behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions.scalars import clip, col, existing, row_sum
from sitegauge.operators.joins import left_renamed
from sitegauge.operators.normalize import normalize
from sitegauge.operators.profile import group_signal
from sitegauge.operators.ranking import rank_movers, top_k
from sitegauge.session import stage

# Fixed values of the correction.
PER_CAPITA_SCALE = 100_000
FULL_VOLUME_POSTS = 50
MAX_VOLUME = 1.5


def relevance(df: DataFrame, topics: Sequence[int]) -> Column:
    """Summed weight of the resistance topics; 1 where the table has no topic weights."""
    cols = existing(df, [f"topic_{i}_weight" for i in topics])
    return row_sum(cols) if cols else F.lit(1.0)


def intensity(per_capita: str | Column) -> Column:
    return F.log1p(col(per_capita) * PER_CAPITA_SCALE)


def volume(posts: str | Column) -> Column:
    return clip(F.log1p(col(posts)) / F.log1p(F.lit(float(FULL_VOLUME_POSTS))), upper=MAX_VOLUME)


def resistance_scores(
    posts: DataFrame, populations: DataFrame, topics: Sequence[int] = range(5),
    county: str = "matched_county_fips", sentiment: str = "sentiment",
) -> DataFrame:
    """One row per county with its raw signal, the correction factors and the 0-100 score.

    Counties without a known population keep null factors and a null score.
    """
    signal = -F.col(sentiment) * relevance(posts, topics)
    narrow = posts.select(county, sentiment, signal.alias("resistance_signal"))
    per_county = group_signal(narrow, county, "resistance_signal", sentiment)
    joined = left_renamed(per_county, populations.select("county_fips", "population"),
                          county, "county_fips")
    per_capita = F.col("post_count") / clip(F.col("population").cast("double"), lower=1.0)
    scored = (
        joined.withColumn("posts_per_capita", per_capita)
        .withColumn("intensity_factor", intensity("posts_per_capita"))
        .withColumn("volume_factor", volume("post_count"))
        .withColumn("social_resistance_score_raw", F.col("raw_resistance_mean")
                    * F.col("intensity_factor") * F.col("volume_factor")))
    # One row per county from here on; the posts are not read again.
    scored = stage(scored, "resistance")
    scored = scored.withColumn("social_resistance_score", F.col("social_resistance_score_raw"))
    return normalize(scored, ["social_resistance_score"])


def correction_report(
    scores: DataFrame, county: str = "matched_county_fips", k: int = 5,
) -> dict[str, DataFrame]:
    """Typical post counts, the top counties before and after correction, and the movers."""
    shown = ["post_count", "population"]
    return {
        "posts_per_county": scores.agg(
            F.count(F.lit(1)).alias("counties"), F.avg("post_count").alias("mean_posts")),
        "top_raw": top_k(scores, "raw_resistance_mean", k, county).select(
            county, "raw_resistance_mean", *shown),
        "top_corrected": top_k(scores, "social_resistance_score", k, county).select(
            county, "social_resistance_score", *shown),
        "movers": rank_movers(
            scores.select(county, "raw_resistance_mean", "social_resistance_score", *shown),
            "raw_resistance_mean", "social_resistance_score", k),
    }
