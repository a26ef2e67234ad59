"""Collecting a corpus from ordered search results, and describing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitegauge.operators.joins import first_per_key
from sitegauge.operators.profile import length_spread, value_shares
from sitegauge.session import stage

# Fixed value: part of every address that belongs to the forum.
FORUM_HOST = "reddit.com"


def collect_results(results: DataFrame, host: str = FORUM_HOST) -> DataFrame:
    """Search results of the forum, each address once, from where it was first seen.

    Results are ordered by phase, query and place in the query's answer.
    """
    ours = results.filter(F.col("url").contains(host))
    return first_per_key(ours, "url", ["phase", "query_no", "result_no"])


def corpus_stats(posts: DataFrame) -> dict[str, DataFrame]:
    """Posts per source and per query, and the spread of content lengths."""
    # The texts are read once, for their lengths; the rest reads the narrow table.
    known = stage(posts.select(
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("query", F.lit("unknown")).alias("query"),
        F.length(F.coalesce("content", F.lit(""))).alias("length")), "lengths")
    return {
        "by_source": value_shares(known, "source").orderBy("source"),
        "by_query": value_shares(known, "query").orderBy(F.desc("n"), "query"),
        "length": length_spread(known, "length"),
    }
