import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import profile
from sitegauge.sources.fixed_values import PRIORITY_FEATURES


def one(spark, values, expr):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(expr.alias("r")).head().r


def test_skewness(spark):
    assert one(spark, [1.0, 2.0, 3.0, 10.0, None], profile.skew_g1("x")) == pytest.approx(1.763632614803888)
    assert one(spark, [1.0, 2.0], profile.skew_g1("x")) is None
    assert one(spark, [4.0, 4.0, 4.0], profile.skew_g1("x")) == 0.0
    assert one(spark, [None], profile.skew_g1("x")) is None


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("abc"))
    pdf["c"] = pdf.a * 2 + pdf.c * 0.1
    pdf.loc[3:20, "b"] = np.nan
    pdf.loc[15:30, "a"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = profile.correlation_matrix(df).toPandas().set_index("feature")
    assert np.allclose(got[list("abc")].loc[list("abc")].astype(float), pdf.corr())


def test_correlation_with_a_constant_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert profile.correlation_pairs(df).head().r is None


def test_recommendations(spark):
    pairs = spark.createDataFrame(
        [("renewable_pct", "x", 0.95), ("x", "y", -0.97), ("x", "renewable_pct", 0.92), ("p", "q", -0.8), ("p", "r", 0.1)],
        "feature_1 string, feature_2 string, r double")
    got = [r.recommendation for r in profile.recommend(pairs, PRIORITY_FEATURES).collect()]
    assert got[0] == "DROP 'x' (near-duplicate of 'renewable_pct', r=+0.950)"
    assert got[1] == "DROP 'x' (near-duplicate of 'y', r=-0.970)"
    assert got[2] == "DROP 'x' (near-duplicate of 'renewable_pct', r=+0.920)"
    assert got[3] == "COMBINE 'p' and 'q' into composite feature, or monitor"
    assert got[4] == "KEEP both"


def test_collinear_pairs_strongest_first(spark):
    pairs = spark.createDataFrame([("a", "b", 0.75), ("a", "c", -0.9), ("b", "c", 0.7)],
                                  "feature_1 string, feature_2 string, r double")
    got = [(r.feature_2, r.action) for r in profile.collinear_pairs(pairs).collect()]
    assert got == [("c", "CONSIDER DROPPING ONE"), ("b", "monitor")]


def test_histogram_matches_numpy_and_closes_the_last_bin(spark):
    values = [0.0, 1.0, 1.0, 2.5, 4.0, 10.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r.n for r in profile.histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=5)[0].tolist()
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.n for r in profile.histogram(flat, "x", 4).orderBy("bin").collect()] == np.histogram([3, 3], bins=4)[0].tolist()


def test_fill_medians_and_drop_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 6.0), (4.0, None, 7.0)], "a double, b double, c double")
    assert profile.drop_all_null(df).columns == ["a", "c"]
    assert sorted(r.a for r in profile.fill_medians(df, ["a", "c"]).collect()) == [1.0, 2.5, 4.0]


def test_match_rate_alarm(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    row = profile.match_rate(df, "x").head()
    assert (row.total, row.matched, row.unmatched, row.rate, row.below_alarm) == (2, 1, 1, 50.0, True)
    assert profile.match_rate(df.limit(0), "x").head().rate == 0.0


def test_null_groups_are_dropped(spark):
    df = spark.createDataFrame([("a", 1.0, -0.2), (None, 2.0, 0.1), ("a", None, None)], "k string, s double, m double")
    row = profile.group_signal(df, "k", "s", "m").collect()
    assert [(r.k, r.post_count, r.negative_pct) for r in row] == [("a", 1, 50.0)]


def test_profile_uses_one_aggregate(spark):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2.0).alias("b"))
    plan = profile.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
