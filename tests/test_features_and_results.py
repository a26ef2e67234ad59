import json

import pytest
from pyspark.sql import functions as F

from sitegauge.plans import features, results
from sitegauge.sources import dimensions as dims, schemas
from sitegauge.session import small_table


def answers(spark, schema, key, **payloads):
    name, kind = schema.split(" ", 1)
    rows = [(k, json.dumps(v)) for k, v in payloads.items()]
    df = spark.createDataFrame(rows, f"{key} string, j string")
    return df.select(key, F.from_json("j", f"{name} {kind}").alias("payload"))


def test_prices(spark):
    got = features.prices(answers(spark, schemas.PRICE, "state", VA={"response": {"data": [{"price": "6.5"}]}},
                                  TX={"response": {"data": []}}, OR={"response": {"data": [{"price": 0}]}}, IA={},
                                  GA={"response": {"data": [{"price": ""}]}}))
    assert {r.state: r.industrial_rate_cents_kwh for r in got.collect()} == {
        "VA": 6.5, "TX": None, "OR": None, "IA": None, "GA": None}


def test_a_zero_sent_as_text_is_a_price(spark):
    got = features.prices(answers(spark, schemas.PRICE_AS_SENT, "state", **{
        k: {"response": {"data": [{"price": p}]}} for k, p in {"VA": "0", "TX": 0, "OR": 6.5, "IA": "n/a", "GA": "", "WA": None, "CA": "7"}.items()}))
    assert {r.state: r.industrial_rate_cents_kwh for r in got.collect()} == {
        "VA": 0.0, "TX": None, "OR": 6.5, "IA": None, "GA": None, "WA": None, "CA": 7.0}


def generation(*rows):
    return {"response": {"data": [{"period": p, "fueltypeid": f, "generation": g} for p, f, g in rows]}}


def test_latest_mix(spark):
    got = {r.state: r for r in features.latest_mix(features.generation_rows(answers(
        spark, schemas.GENERATION, "state",
        VA=generation(("2023", "ALL", "90"), ("2023", "SUN", 10), ("2023", "WND", None), ("2023", "ALL", 80), ("2022", "SUN", 500)),
        TX=generation(("2023", "ALL", "0"), ("2023", "SUN", 10)),
        OR=generation(("2023", "SUN", 10)),
        WA=generation(("2023", "ALL", 3), ("2023", "GEO", 1), ("2023", "COL", 1))))).collect()}
    assert (got["VA"].renewable_pct, got["VA"].total_generation_mwh) == (12.5, 80.0)
    assert (got["TX"].renewable_pct, got["TX"].total_generation_mwh) == (None, None)
    assert got["OR"].renewable_pct is None
    assert got["WA"].renewable_pct == 33.33


@pytest.mark.parametrize("solar, wind, want", [
    (4.75, None, 50.0), (4.75, 0.3, 50.0), (6.5, 0.15, 50.0), (9.0, 0.9, 100.0), (3.0, None, None), (None, 0.4, None)])
def test_potential(spark, solar, wind, want):
    df = spark.createDataFrame([(solar, wind)], "s double, w double")
    assert df.select(features.potential("s", "w").alias("p")).head().p == want


def test_climate(spark):
    rows = features.climate_rows(answers(spark, schemas.CLIMATE, "county_fips", **{"51107": {"results": [
        {"datatype": "ANN-TAVG-NORMAL", "value": 551}, {"datatype": "ANN-CLDD-NORMAL", "value": 1100},
        {"datatype": "ANN-TAVG-NORMAL", "value": 560}]}, "51059": {}}))
    got = {r.county_fips: r for r in features.climate(dims.target_counties(spark), rows).collect()}
    assert len(got) == 26 and got["51107"].avg_temp_f == 56.0 and got["51107"].cooling_degree_days == 1100.0
    assert got["51059"].avg_temp_f is None and got["51107"].temp_variance is None


def test_climate_from_states(spark):
    got = {r.county_fips: r for r in features.climate_from_states(dims.target_counties(spark), dims.state_climate(spark)).collect()}
    assert got["04013"].avg_temp_f == 60.3 and got["53033"].cooling_degree_days == 200.0 and len(got) == 26


def series(*readings):
    return {"values": [{"value": [{"value": v} for v in readings]}]}


def test_water(spark):
    ground = features.series_last_rows(answers(spark, schemas.WATER, "county_fips", **{
        "51107": {"value": {"timeSeries": [series("3", "4.5"), series("9")]}},
        "51059": {"value": {"timeSeries": [series(), series("9")]}}, "51153": {"value": {"timeSeries": []}}}))
    surface = features.series_last_rows(answers(spark, schemas.WATER, "county_fips", **{
        "51107": {"value": {"timeSeries": [series("1", "10"), series("Ice"), series(), series("20.005")] + [series("0")] * 6 + [series("999")]}},
        "51059": {"value": {"timeSeries": [series("0")]}}}))
    counties = dims.target_counties(spark)
    got = {r.county_fips: r for r in features.water(counties, ground, surface).collect()}
    assert got["51107"].groundwater_level_ft == 4.5
    assert got["51107"].surface_water_flow_cfs == pytest.approx(round((10 + 20.005) / 8, 2))
    assert got["51059"].groundwater_level_ft is None and got["51059"].surface_water_flow_cfs is None
    assert got["51153"].groundwater_level_ft is None and len(got) == 26


def test_master_table_keeps_the_spine(spark):
    power = features.electricity(
        small_table(spark, [("VA", 6.5)], "state string, industrial_rate_cents_kwh double"),
        small_table(spark, [("VA", 12.5, 80.0)], "state string, renewable_pct double, total_generation_mwh double"),
        dims.target_states(spark))
    climate = features.climate_from_states(dims.target_counties(spark), dims.state_climate(spark))
    table = features.master_features(dims.target_counties(spark), power, None, climate, None)
    rows = {r.county_fips: r for r in table.collect()}
    assert len(rows) == 26 and rows["51059"].industrial_rate_cents_kwh == 6.5 and rows["48113"].state == "TX"
    assert rows["48113"].industrial_rate_cents_kwh is None and "solar_ghi_kwh_m2_day" not in table.columns


@pytest.fixture(scope="module")
def scores(spark):
    return small_table(spark, [
        ("51107", "VA", 71.0, 60.0, 1), ("48113", "TX", 55.0, 80.0, 2), ("04013", "AZ", 40.0, 10.0, 3), ("51059", "VA", None, 5.0, 4)],
        "county_fips string, state string, psi double, power_score double, rank int")


def test_score_lists(scores):
    def codes(**options):
        return [r.county_fips for r in results.list_scores(scores, **options).data.collect()]
    assert codes() == ["51107", "48113", "04013", "51059"]
    assert codes(min_psi=50, order="ASC") == ["48113", "51107"]
    assert codes(state="va") == ["51107", "51059"]
    assert codes(sort="power_score") == ["48113", "51107", "04013", "51059"]
    assert codes(sort="county_fips; drop", limit=1) == ["51107"]
    assert results.list_scores(scores, limit=1).total() == 4
    for bad in (dict(limit=0), dict(limit=501), dict(min_psi=-1), dict(min_psi=101)):
        with pytest.raises(ValueError):
            results.list_scores(scores, **bad)


def test_state_filter_by_code_prefix(scores):
    coded = scores.drop("state").withColumn("state_fips", F.substring("county_fips", 1, 2))
    assert results.list_scores(coded, state="az").data.head().county_fips == "04013"
    assert [r.state for r in results.scored_states(coded).collect()] == ["AZ", "TX", "VA"]
    assert [r.state for r in results.scored_states(scores).collect()] == ["AZ", "TX", "VA"]


def test_detail(spark, scores):
    feats = small_table(spark, [("04013", 60.3)], "county_fips string, avg_temp_f double")
    res = small_table(spark, [("04013", 3)], "matched_county_fips string, post_count int")
    row = results.score_detail(scores, "4013", feats, res).head()
    assert row.raw_features.avg_temp_f == 60.3 and row.resistance_detail.post_count == 3
    assert results.score_detail(scores, "51107", feats).head().raw_features is None
    assert results.score_detail(scores, "99999", feats, res).count() == 0


def test_filters_reach_the_scan(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    scores.write.parquet(path)
    plan = results.list_scores(spark.read.parquet(path), min_psi=50, state="VA").data._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(psi,50" in plan and "EqualTo(state,VA)" in plan and "TakeOrderedAndProject" in plan


def test_compare(scores):
    assert results.compare(scores, ["4013", "51107", "99999"]).count() == 2
    for bad in (["1"], list("123456")):
        with pytest.raises(ValueError):
            results.compare(scores, bad)


def test_validation_summary(spark):
    weights = {"weights": {"power": 0.5}, "macro_f1": 0.7, "strategy": "s", "n_successful": 25, "n_blocked": 14}
    pairs = small_table(spark, [("a", "b", 0.9)], "scenario_1 string, scenario_2 string, kendall_tau double")
    row = results.validation_summary(spark, weights, {"auc": 0.8, "p_value": 0.01}, 73.0, pairs, "1.0.0").head()
    assert row.n_validation_sites == 39 and row.class_balance.blocked == 14 and row.weights == {"power": 0.5}
    assert row.sensitivity[0].kendall_tau == 0.9 and row.auc == 0.8
    empty = results.validation_summary(spark).head()
    assert empty.n_validation_sites is None and empty.class_balance is None


def test_availability(scores):
    assert results.availability(scores=scores, features=None) == {"scores": 4, "features": 0}


def test_sun_and_wind(spark):
    sun = answers(spark, schemas.SOLAR, "county_fips", **{"51107": {"outputs": {"solrad_annual": 4.75}}, "04013": {"outputs": {}}})
    wind = answers(spark, schemas.WIND, "county_fips", **{"51107": {"outputs": {"capacity_factor": 0.45}}})
    got = {r.county_fips: r for r in features.sun_and_wind(dims.centroids(spark), sun, wind).collect()}
    assert len(got) == 20 and got["51107"].renewable_potential_score == 75.0
    assert got["04013"].solar_ghi_kwh_m2_day is None and got["04013"].renewable_potential_score is None


def test_fixed_tables(spark):
    sizes = {
        dims.states: 50, dims.target_counties: 26, dims.centroids: 20, dims.county_names: 41, dims.forum_states: 28,
        dims.domain_lexicon: 45, dims.stop_words: 26, dims.populations: 26, dims.state_climate: 15,
        dims.blocked_sites: 15, dims.built_sites: 25, dims.target_states: 15, dims.topic_keywords: 8}
    for table, n in sizes.items():
        assert table(spark).count() == n, table.__name__
    assert dims.place_aliases(spark).select("place").distinct().count() == 65
