"""Lexicon sentiment of texts.

Valences of the terms found are summed and squashed to (-1, 1) as
s / sqrt(s^2 + 15); a term after a negation counts -0.74 times.  A text is read
from left to right: at each place the longest term counts, and nothing that
begins inside it counts again.  The rule is the same for a lexicon of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.operators.joins import override
from sitegauge.operators.phrases import phrase_form, phrase_hits
from sitegauge.sources import dimensions as dims

# Fixed values of the published compound score.
ALPHA = 15.0
NEGATED = -0.74
# Words that turn the meaning around, besides those ending in n't.
NEGATIONS = [
    "no", "not", "never", "none", "neither", "nor", "nobody", "nothing", "nowhere",
    "without", "cannot", "hardly", "barely", "scarcely", "rarely", "seldom", "despite",
]
REACH = 3


def full_lexicon(spark, base: DataFrame | None = None) -> DataFrame:
    """The domain terms, on top of a general lexicon (term, valence) if one is given."""
    domain = dims.domain_lexicon(spark)
    return domain if base is None else override(base, domain, "term")


def compound(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + ALPHA), 4)


def with_sentiment(
    posts: DataFrame, key: str = "url", text: str = "clean_text",
    lexicon: DataFrame | None = None, out: str = "sentiment",
    negations: Sequence[str] = NEGATIONS,
) -> DataFrame:
    """Add the sentiment of each text; ``key`` must be unique.

    A text's hits are added up from left to right, skipping those that begin
    inside the last one counted.
    """
    lexicon = lexicon if lexicon is not None else full_lexicon(posts.sparkSession)
    lexicon = lexicon.select(phrase_form("term").alias("term"), "valence").filter("term <> ''")
    hits = phrase_hits(posts, key, text, lexicon, "term", negations, REACH)
    value = F.when(F.col("negated"), F.col("valence") * NEGATED).otherwise(F.col("valence"))
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("pos", "len", value.cast("double").alias("value")))).alias("_hits"))

    def add(acc: Column, hit: Column) -> Column:
        free = hit["pos"] >= acc["end"]
        return F.struct(
            F.when(free, hit["pos"] + hit["len"]).otherwise(acc["end"]).alias("end"),
            (acc["total"] + F.when(free, hit["value"]).otherwise(0.0)).alias("total"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("total"))
    totals = listed.select(key, F.aggregate("_hits", start, add)["total"].alias("_total"))
    return posts.join(totals, key, "left").withColumn(
        out, compound(F.coalesce("_total", F.lit(0.0)))).drop("_total")
