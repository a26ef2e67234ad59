"""Named queries over the test tables, each with the SQL that must give the same rows.

A query takes a session and the folder of the tables and returns a DataFrame.
Queries whose result SQL cannot state (fitted models, digests) carry no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitegauge.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


# The normal tail q of z as the fixed series 7.1.26 of Abramowitz and Stegun, good to seven places.
TAIL_SQL = """
erf AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS e FROM z),
tail AS (SELECT *, 0.5 * e * (0.254829592 + e * (-0.284496736 + e * (1.421413741 + e * (-1.453152027 + e * 1.061405429))))
                * exp(-z * z / 2) AS q FROM erf)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, spread over the cores."""
    return spread(table(spark, folder, "documents"), "doc_id")


def r(c: str | Column, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, so that both engines agree on the last digits."""
    return df.select(*[r(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from sitegauge.catalog import (  # noqa: F401
        aggregates, evidence, joining, outcomes, ranks, scores, storage, texts,
    )

    return QUERIES, SQL
