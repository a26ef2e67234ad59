"""Ranks, totals and quantiles against pandas, with heavy ties and hot values."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitegauge.operators import ranking


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def skewed(n=6000, seed=3):
    """A third of the rows share one value, some are missing."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n), 2)
    v[: n // 3] = 7.25
    v[n // 3: n // 3 + 100] = np.nan
    rng.shuffle(v)
    return pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 4, n), "v": v})


@pytest.fixture(scope="module")
def data():
    return skewed()


@pytest.fixture(scope="module")
def table(spark, data):
    df = spark.createDataFrame(data)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_average_rank(table, data, descending):
    got = ranking.with_average_rank(table, "v", "r", descending=descending).toPandas().set_index("id")
    want = data.set_index("id").v.rank(ascending=not descending)
    assert np.allclose(got.r.loc[want.index].astype(float), want, equal_nan=True)
    assert len(got) == len(data)


def test_percent_rank_within_group(table, data):
    got = ranking.with_average_rank(table, "v", "r", by=["g"], percent=True).toPandas().set_index("id")
    want = data.set_index("id").groupby("g").v.rank(pct=True) * 100
    assert np.allclose(got.r.loc[want.index].astype(float), want, equal_nan=True)


def test_percent_rank_example(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "x double")
    got = sorted((r.x or 0, r.p) for r in ranking.with_average_rank(df, "x", "p", percent=True).collect())
    assert [p for _, p in got] == [None, 50.0, 50.0, 100.0]


def test_hot_value_is_known_and_spread(table):
    ranges = ranking.value_ranges(table, ["v"])
    assert 7.25 in ranges.hot["v"]
    ranked = ranking.value_counts_ranked(table, "v", ranges=ranges).select("v", "n")
    joined = ranking.hot_safe_join(table, ranked, ["v"], "v", ranges)
    assert joined.count() == table.count()


def test_sequence_counts_every_row_once(table, data):
    got = ranking.with_sequence(table, [F.desc_nulls_last("v"), F.asc("id")]).toPandas()
    want = data.sort_values(["v", "id"], ascending=[False, True], na_position="last").id.tolist()
    assert got.sort_values("rank").id.tolist() == want
    assert sorted(got["rank"]) == list(range(1, len(data) + 1))


@pytest.mark.parametrize("rule", ["linear", "upper"])
def test_quantiles(table, data, rule):
    got = ranking.quantiles(table, ["v", "id"], [0.25, 0.5, 0.9], rule=rule).toPandas().set_index("column")
    for c in ("v", "id"):
        known = np.sort(data[c].dropna().to_numpy())
        for i, p in enumerate([0.25, 0.5, 0.9]):
            want = np.quantile(known, p) if rule == "linear" else known[min(int(len(known) * p), len(known) - 1)]
            assert got.loc[c, f"q{i}"] == pytest.approx(want)


def test_top_k_with_ties(spark):
    df = frame(spark, k=[1, 2, 3, 4, 5], v=[9.0, 5.0, 5.0, 5.0, 1.0])
    assert ranking.top_k_with_ties(df, "v", 2).count() == 4
    assert [r.k for r in ranking.top_k(df, "v", 2, "k").collect()] == [1, 2]


def test_movers_keep_ties(spark):
    df = frame(spark, k=[1, 2, 3, 4], a=[1.0, 2.0, 3.0, 4.0], b=[3.0, 4.0, 1.0, 2.0])
    got = {r.k: r.rank_change for r in ranking.rank_movers(df, "a", "b").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: -2.0, 4: -2.0}
    assert ranking.rank_movers(df, "a", "b", 1).count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_do_not_gather_rows_in_one_task(table):
    ranges = ranking.value_ranges(table, ["v"])
    plan = plan_of(ranking.with_average_rank(table, "v", "r", ranges=ranges))
    # The one gathering step runs over per-range totals, and is broadcast.
    assert plan.count("Exchange SinglePartition") <= 1
    assert "BroadcastExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([1e12, -1e-9, 0.5])), min_size=1, max_size=40))
def test_percentile_ranks_average_to_the_middle(spark, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double")
    got = [r.p for r in ranking.with_average_rank(df, "v", "p", percent=True).collect()]
    want = pd.Series([np.nan if v is None else float(v) for v in values]).rank(pct=True) * 100
    known = [p for p in got if p is not None]
    assert sorted(known) == pytest.approx(sorted(want.dropna()))
    if known:
        assert sum(known) / len(known) == pytest.approx((len(known) + 1) / (2 * len(known)) * 100)
