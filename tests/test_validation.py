import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import significance as sig
from sitegauge.operators import composite, validation
from sitegauge.sources import dimensions as dims
from sitegauge.sources.fixed_values import FALLBACK_WEIGHTS


def labelled(spark, pairs):
    return spark.createDataFrame([(float(s) if s is not None else None, l) for s, l in pairs], "s double, y int")


def brute_u(pairs):
    pos = [s for s, l in pairs if l == 1 and s is not None]
    neg = [s for s, l in pairs if l == 0 and s is not None]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg), len(pos), len(neg)


def test_auc_example(spark):
    row = validation.auc(labelled(spark, [(3, 1), (2, 1), (2, 0), (1, 0)]), "s", "y").head()
    assert (row.u, row.auc) == (3.5, 0.875)


def test_auc_on_hot_ties(spark):
    rng = np.random.default_rng(1)
    pairs = [(v, int(l)) for v, l in zip(np.where(rng.random(900) < 0.33, 5, rng.integers(0, 40, 900)).tolist(), rng.integers(0, 2, 900))]
    pairs += [(None, 1), (None, 0)]
    u, n1, n0 = brute_u(pairs)
    row = validation.auc(labelled(spark, pairs).repartition(5), "s", "y").head()
    assert (row.u, row.n_pos, row.n_neg) == (u, n1, n0) and row.auc == pytest.approx(u / n1 / n0)


def test_one_class_has_no_auc(spark):
    assert validation.auc(labelled(spark, [(1, 1), (2, 1)]), "s", "y").head().auc is None
    assert validation.roc_points(labelled(spark, [(1, 1), (2, 1)]), "s", "y").count() == 0


def test_mann_whitney(spark):
    out = validation.mann_whitney(labelled(spark, [(5, 0), (6, 0), (7, 0), (1, 1), (2, 1), (3, 1), (4, 1)]), "s", "y", greater=0)
    assert out["u"] == 12 and out["p_value"] == round(1 / 35, 4)
    assert validation.mann_whitney(labelled(spark, [(5, 0), (1, 1), (2, 1)]), "s", "y")["p_value"] is None
    tied = [(v % 4, int(v % 3 == 0)) for v in range(60)]
    u, n1, n0 = brute_u(tied)
    counts = pd.Series([s for s, _ in tied]).value_counts()
    out = validation.mann_whitney(labelled(spark, tied), "s", "y", greater=1)
    assert out["p_value"] == round(sig.u_greater_p(u, n1, n0, float((counts ** 3 - counts).sum())), 4)


def test_report_counts_undefined_as_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, predicted int")
    got = {r["class"]: r for r in validation.classification_report(df, "label", "predicted").collect()}
    assert got["1"].precision == 0.0 and got["1"].f1 == 0.0 and got["0"].recall == 1.0
    assert got["macro avg"].f1 == pytest.approx(0.25) and got["accuracy"].f1 == pytest.approx(1 / 3)
    cells = {(r.label, r.predicted): r.n for r in validation.confusion(df, "label", "predicted").collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_matching_keeps_every_labelled_row(spark):
    labels = dims.labelled_sites(spark)
    counties = dims.target_counties(spark).withColumn("state", F.lit("ZZ"))
    matched = validation.match_outcomes(labels, counties)
    assert (labels.count(), matched.count()) == (39, 33)
    assert {"state_x", "state_y"} <= set(matched.columns)


def test_too_few_matches_give_nothing(spark):
    scores = spark.createDataFrame([("51107", 70.0, 50.0)], "county_fips string, psi double, social_score double")
    out = validation.validate_scores(scores, dims.labelled_sites(spark))
    assert out["n"] == 3 and out["auc"] is None and out["p_value"] is None


def brute_tau(x, y):
    s = dx = dy = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, dx, dy = s + a * b, dx + (a != 0), dy + (b != 0)
    return s / math.sqrt(dx) / math.sqrt(dy)


@pytest.mark.parametrize("seed, n, spread", [(0, 40, 1000), (1, 150, 12), (2, 97, 3)])
def test_tau_by_bits_equals_tau_by_pairs(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    psi = {s: rng.integers(0, spread, n).astype(float) for s in "abc"}
    psi["c"] = -psi["a"]
    long = spark.createDataFrame([(i, s, float(v[i])) for s, v in psi.items() for i in range(n)],
                                 "k long, scenario string, psi double").repartition(3)
    ranks = validation.scenario_ranks(long, "k")
    got = {(r.scenario_1, r.scenario_2): r for r in validation.kendall_pairs(ranks, list("abc"), "k").collect()}
    for a, b in combinations("abc", 2):
        assert got[a, b].kendall_tau == round(brute_tau(psi[a], psi[b]), 3)
    assert got["a", "c"].kendall_tau == -1.0 and got["a", "c"].stability == "FRAGILE"
    assert got["a", "c"].p_value < 0.05


@pytest.mark.parametrize("seed, xs, ys", [(0, 500, 500), (1, 9, 40), (2, 1, 400), (3, 400, 1), (4, 3, 3)])
def test_discordant_pairs_over_small_blocks_equal_all_pairs(spark, seed, xs, ys):
    rng = np.random.default_rng(seed)
    drawn = pd.DataFrame({"pair": rng.integers(0, 3, 400), "x": rng.integers(0, xs, 400), "y": rng.integers(0, ys, 400)})
    points = drawn.groupby(["pair", "x", "y"]).size().reset_index(name="w")
    met = points.merge(points, on="pair", suffixes=("", "2"))
    met = met[(met.x < met.x2) & (met.y > met.y2)]
    wanted = (met.w * met.w2).groupby(met.pair).sum()
    got = validation.discordant_pairs(spark.createDataFrame(points).repartition(4), "pair", size=40).collect()
    assert {r.pair: int(r.discordant) for r in got} == {p: wanted.get(p, 0) for p in points.pair.unique()}


def test_points_that_share_a_value_are_dealt_over_blocks(spark):
    points = spark.range(4000).selectExpr("0L AS g", "id AS x", "7L AS y", "1L AS w")
    for order in (["x", "y"], ["y", "x"]):
        sizes = [r["count"] for r in validation._blocks(points, 8, "g", order, "block", "x").groupBy("block").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000


def test_fewer_than_three_shared_locations_are_skipped(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0), (1, "b", 1.0), (2, "b", 5.0), (3, "b", None)],
                                 "k long, scenario string, psi double")
    assert validation.kendall_pairs(validation.scenario_ranks(long, "k"), ["a", "b"], "k").count() == 0


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    n = 60
    pdf = pd.DataFrame({"county_fips": [f"{i:05d}" for i in range(n)], "state": ["VA", "TX"] * (n // 2)})
    for c in ["industrial_rate_cents_kwh", "renewable_pct", "avg_temp_f", "cooling_degree_days", "social_resistance_score"]:
        pdf[c] = rng.normal(50, 10, n)
    pdf["total_generation_mwh"] = rng.pareto(0.7, n) * 1000
    pdf.loc[5:9, "renewable_pct"] = None
    pdf.loc[3, ["social_resistance_score"]] = None
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])
    return df.withColumn("drought_severity_index", F.lit(None).cast("double")), pdf.assign(drought_severity_index=np.nan)


def pandas_normal(s):
    known = s.dropna()
    if len(known) < 2:
        return s.fillna(50.0)
    if abs(known.skew()) > 2:
        return s.rank(pct=True) * 100
    return ((((s - known.mean()) / known.std(ddof=0)).clip(-3, 3)) + 3) / 6 * 100


def test_composite_score_against_pandas(features):
    df, pdf = features
    scores = composite.score_locations(df, FALLBACK_WEIGHTS).toPandas().set_index("county_fips").sort_index()
    p = pdf.set_index("county_fips")
    turned = lambda c: 100 - pandas_normal(p[c])
    power = pd.concat([turned("industrial_rate_cents_kwh"), pandas_normal(p.renewable_pct), pandas_normal(p.total_generation_mwh)], axis=1).mean(axis=1)
    env = pd.concat([turned("avg_temp_f"), turned("cooling_degree_days"), turned("drought_severity_index")], axis=1).mean(axis=1)
    social = turned("social_resistance_score")
    psi = 0.45 * power + 0.30 * env + 0.25 * social
    for name, want in (("power_score", power), ("environmental_score", env), ("social_score", social), ("psi", psi)):
        assert np.allclose(scores[name].astype(float), want, equal_nan=True), name
    cols = ["industrial_rate_cents_kwh", "renewable_pct", "total_generation_mwh", "avg_temp_f", "cooling_degree_days",
            "drought_severity_index", "social_resistance_score"]
    assert np.allclose(scores.confidence, (7 / 12 * p[cols].notna().mean(axis=1)).round(3))
    assert scores.loc["00003", "rank"] == len(p)  # an unknown score comes last
    assert scores.drop("00003").sort_values("psi", ascending=False)["rank"].tolist() == list(range(1, len(p)))
    assert set(scores.model_version) == {"1.0.0"} and set(scores.weights_used) == {'{"power": 0.45, "environmental": 0.3, "social": 0.25}'}


def test_missing_dimension_is_neutral(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "county_fips string, renewable_pct double")
    scores = composite.score_locations(df, FALLBACK_WEIGHTS).orderBy("rank").collect()
    assert [r.county_fips for r in scores] == ["b", "a"]
    assert {r.environmental_score for r in scores} == {50.0} and scores[0].confidence == round(1 / 12, 3)


def test_equal_scores_are_ordered_by_key(spark):
    df = spark.createDataFrame([(k, 1.0 if k in "ab" else 2.0) for k in "dbca"], "county_fips string, renewable_pct double")
    assert [r.county_fips for r in composite.score_locations(df, FALLBACK_WEIGHTS).orderBy("rank").collect()] == ["c", "d", "a", "b"]


def test_score_is_linear_in_the_weights(features):
    df, _ = features
    def psi(w):
        return composite.score_locations(df, w, ranked=False).select("county_fips", "psi").toPandas().set_index("county_fips").psi
    a, b = {"power": 1.0}, {"power": 0.2, "social": 0.5}
    both = {"power": 1.2, "social": 0.5}
    # With no weight on a dimension its unknown score still makes the sum unknown.
    assert np.allclose((psi(a) + psi(b)).astype(float), psi(both).astype(float), equal_nan=True)


def test_partitioning_does_not_change_scores(features):
    df, _ = features
    one = composite.score_locations(df.coalesce(1), FALLBACK_WEIGHTS).toPandas()
    many = composite.score_locations(df.repartition(11), FALLBACK_WEIGHTS).toPandas()
    pd.testing.assert_frame_equal(one.sort_values("rank", ignore_index=True), many.sort_values("rank", ignore_index=True))


def test_sensitivity_covers_ten_pairs_and_ten_best(features):
    df, _ = features
    pairs, table = validation.sensitivity(df)
    assert pairs.count() == 10 and table.count() == 10
    assert table.columns == ["county_fips", "Power-heavy", "Balanced", "Social-heavy", "Env-heavy", "Derived"]
    assert table.head().Derived == 1.0


def test_display_rows(features):
    df, _ = features
    shown = composite.head_and_tail(composite.score_locations(df, FALLBACK_WEIGHTS))
    assert shown.filter("part = 'top'").count() == 10 and shown.filter("part = 'bottom'").count() == 5
