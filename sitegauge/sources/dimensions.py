"""The fixed lookup tables as DataFrames.

Each is built from an Arrow table, so Spark sees a local relation of known,
constant size and broadcasts it by its own size rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.sources import fixed_values as fixed


def local_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    arrays = {name: pa.array(values, kind) for name, (kind, values) in columns.items()}
    return spark.createDataFrame(pa.table(arrays))


def _strings(values):
    return (pa.string(), [v or None for v in values])


def states(spark: SparkSession) -> DataFrame:
    data = fixed.STATES
    return local_table(spark, {
        "state": _strings(r[0] for r in data),
        "state_fips": _strings(r[1] for r in data),
    })


def target_counties(spark: SparkSession) -> DataFrame:
    data = fixed.COUNTY_POPULATIONS
    return local_table(spark, {
        "county_fips": _strings(r[0] for r in data),
        "pos": (pa.int32(), list(range(len(data)))),
    })


def target_states(spark: SparkSession) -> DataFrame:
    """States with at least one county in scope."""
    prefixes = target_counties(spark).select(
        F.substring("county_fips", 1, 2).alias("state_fips")).distinct()
    return states(spark).join(prefixes, "state_fips", "left_semi")


def populations(spark: SparkSession) -> DataFrame:
    data = fixed.COUNTY_POPULATIONS
    return local_table(spark, {
        "county_fips": _strings(r[0] for r in data),
        "population": (pa.int64(), [r[1] for r in data]),
    })


def centroids(spark: SparkSession) -> DataFrame:
    data = fixed.CENTROIDS
    return local_table(spark, {
        "county_fips": _strings(r[0] for r in data),
        "lat": (pa.float64(), [r[1] for r in data]),
        "lon": (pa.float64(), [r[2] for r in data]),
    })


def place_aliases(spark: SparkSession) -> DataFrame:
    """One row per alias and candidate county; pos is the candidate's place in the list."""
    data = [
        (place, pos, code)
        for place, codes in fixed.PLACE_ALIASES
        for pos, code in enumerate(codes)
    ]
    return local_table(spark, {
        "place": _strings(r[0] for r in data),
        "pos": (pa.int32(), [r[1] for r in data]),
        "county_fips": _strings(r[2] for r in data),
    })


def county_names(spark: SparkSession) -> DataFrame:
    data = fixed.COUNTY_NAMES
    return local_table(spark, {
        "county_name": _strings(r[0] for r in data),
        "state": _strings(r[1] for r in data),
        "county_fips": _strings(r[2] for r in data),
        "pos": (pa.int32(), list(range(len(data)))),
    })


def forum_states(spark: SparkSession) -> DataFrame:
    data = fixed.FORUM_STATES
    return local_table(spark, {
        "subreddit": _strings(r[0] for r in data),
        "state_hint": _strings(r[1] for r in data),
    })


def domain_lexicon(spark: SparkSession) -> DataFrame:
    data = fixed.DOMAIN_LEXICON
    return local_table(spark, {
        "term": _strings(r[0] for r in data),
        "valence": (pa.float64(), [r[1] for r in data]),
    })


def stop_words(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"word": _strings(fixed.DOMAIN_STOP_WORDS)})


def state_climate(spark: SparkSession) -> DataFrame:
    data = fixed.STATE_CLIMATE
    return local_table(spark, {
        "state_fips": _strings(r[0] for r in data),
        "avg_temp_f": (pa.float64(), [r[1] for r in data]),
        "cooling_degree_days": (pa.float64(), [r[2] for r in data]),
    })


def topic_keywords(spark: SparkSession) -> DataFrame:
    data = fixed.TOPIC_KEYWORDS
    return local_table(spark, {
        "label": _strings(r[0] for r in data),
        "pos": (pa.int32(), list(range(len(data)))),
        "keywords": (pa.list_(pa.string()), [list(r[1]) for r in data]),
    })


def blocked_sites(spark: SparkSession) -> DataFrame:
    data = fixed.BLOCKED_SITES
    return local_table(spark, {
        "name": _strings(r[0] for r in data),
        "county_fips": _strings(r[1] for r in data),
        "state": _strings(r[2] for r in data),
        "year_proposed": (pa.int32(), [r[3] for r in data]),
        "outcome": _strings(r[4] for r in data),
        "reason": _strings(r[5] for r in data),
    })


def built_sites(spark: SparkSession) -> DataFrame:
    data = fixed.BUILT_SITES
    return local_table(spark, {
        "name": _strings(r[0] for r in data),
        "county_fips": _strings(r[1] for r in data),
        "state": _strings(r[2] for r in data),
        "year_built": (pa.int32(), [r[3] for r in data]),
        "outcome": _strings(r[4] for r in data),
    })


def labelled_sites(spark: SparkSession, scored_only: bool = True) -> DataFrame:
    """Both site lists in one table; label 1 was built, 0 was stopped.

    ``scored_only`` leaves out sites without a county, which no score can match.
    """
    stopped = blocked_sites(spark).withColumnRenamed("year_proposed", "year").withColumn(
        "label", F.lit(0))
    built = (
        built_sites(spark).withColumnRenamed("year_built", "year")
        .withColumn("reason", F.lit(None).cast("string")).withColumn("label", F.lit(1))
    )
    sites = stopped.unionByName(built)
    return sites.filter(F.col("county_fips").isNotNull()) if scored_only else sites
