"""Feature building: answers nested as JSON, reduced to one row per location."""

import uuid

from pyspark.sql import functions as F

from sitegauge.catalog import query, r, rounded, table
from sitegauge.functions.scalars import number, pad_code, point
from sitegauge.plans import features
from sitegauge.session import shared_dir
from sitegauge.sources import files, schemas


def _answers(spark, folder, shape, schema):
    """One landed answer per event: its JSON text parsed by the given schema."""
    events = table(spark, folder, "events")
    name, kind = schema.split(" ", 1)
    text = events.select(F.col("event_id").alias("key"), F.format_string(*shape).alias("json"))
    return text.select("key", F.from_json("json", f"{name} {kind}").alias("payload"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events")
def parsed_properties(spark, folder):
    props = F.from_json("props", "k string")
    return table(spark, folder, "events").select("event_id", number(props["k"]).alias("k"))


@query("""
SELECT event_id AS key, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS industrial_rate_cents_kwh FROM events
""")
def prices_from_answers(spark, folder):
    price = F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    answers = _answers(spark, folder, ('{"response": {"data": [{"price": "%s"}, {"price": "1"}]}}', price),
                       schemas.PRICE_AS_SENT)
    return features.prices(answers, "key")


@query("""
SELECT event_id AS key, round_even(value / (value * 4) * 100 * 100, 0) / 100 AS renewable_pct,
       value * 4 AS total_generation_mwh FROM events WHERE value > 0
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE value <= 0
""")
def mix_from_answers(spark, folder):
    v = F.col("value")
    shape = ('{"response": {"data": ['
             '{"period": "2024", "generation": "1", "fueltypeid": "ALL"},'
             '{"period": "2024", "generation": "%s", "fueltypeid": "SUN"},'
             '{"period": "2024", "generation": null, "fueltypeid": "WND"},'
             '{"period": "2024", "generation": "%s", "fueltypeid": "ALL"},'
             '{"period": "2023", "generation": "7", "fueltypeid": "GEO"}]}}',
             v.cast("string"), (v * 4).cast("string"))
    return features.latest_mix(features.generation_rows(_answers(spark, folder, shape, schemas.GENERATION), "key"), "key")


@query("""
SELECT event_id AS county_fips, value / 10 AS avg_temp_f, (event_id % 7 + value)::DOUBLE AS cooling_degree_days,
       NULL::DOUBLE AS temp_variance, NULL::DOUBLE AS extreme_weather_events_yr FROM events
""")
def climate_from_answers(spark, folder):
    v = F.col("value")
    shape = ('{"results": [{"datatype": "ANN-TAVG-NORMAL", "value": 3}, {"datatype": "ANN-CLDD-NORMAL", "value": %s},'
             '{"datatype": "ANN-TAVG-NORMAL", "value": %s}, {"datatype": "OTHER", "value": 1}]}',
             (F.col("event_id") % 7 + v).cast("string"), v.cast("string"))
    answers = _answers(spark, folder, shape, schemas.CLIMATE)
    rows = features.climate_rows(answers, "key").withColumnRenamed("key", "county_fips")
    return features.climate(answers.select(F.col("key").alias("county_fips")), rows)


@query("""
SELECT event_id AS county_fips, value AS groundwater_level_ft,
       nullif(round_even((value + 3) / 2 * 100, 0) / 100, 0) AS surface_water_flow_cfs,
       NULL::DOUBLE AS drought_severity_index FROM events
""")
def water_from_answers(spark, folder):
    v = F.col("value").cast("string")
    shape = ('{"value": {"timeSeries": [{"values": [{"value": [{"value": "1"}, {"value": "%s"}]}]},'
             '{"values": [{"value": [{"value": "9"}, {"value": "Ice"}]}]}, {"values": [{"value": []}]},'
             '{"values": [{"value": [{"value": "3"}]}]}]}}', v)
    answers = _answers(spark, folder, shape, schemas.WATER)
    rows = features.series_last_rows(answers, "key").withColumnRenamed("key", "county_fips")
    return features.water(answers.select(F.col("key").alias("county_fips")), rows, rows)


@query("""
WITH x AS (SELECT event_id, value / 20 AS sun, CASE WHEN event_type <> 'view' THEN value / 100 END AS wind FROM events),
y AS (SELECT *, least(greatest((sun - 3) / 3.5, 0), 1) * 100 AS a,
             CASE WHEN wind IS NOT NULL THEN least(greatest((wind - 0.15) / 0.3, 0), 1) * 100 END AS b FROM x)
SELECT event_id AS county_fips, 39.5::DOUBLE AS lat, round(sun, 6) AS solar_ghi_kwh_m2_day,
       round(wind, 6) AS wind_capacity_factor,
       nullif(round_even(CASE WHEN wind IS NULL THEN a ELSE (a + b) / 2 END * 100, 0) / 100, 0) AS score FROM y
""")
def sun_and_wind_from_answers(spark, folder):
    v = F.col("value")
    sun = _answers(spark, folder, ('{"outputs": {"solrad_annual": %s}}', (v / 20).cast("string")), schemas.SOLAR)
    wind = _answers(spark, folder, ("%s", F.when(
        F.col("event_type") == "view", F.lit("{}")).otherwise(F.format_string(
            '{"outputs": {"capacity_factor": %s}}', (v / 100).cast("string")))), schemas.WIND)
    sun, wind = (a.withColumnRenamed("key", "county_fips") for a in (sun, wind))
    places = sun.select("county_fips", F.lit(39.5).alias("lat"))
    out = features.sun_and_wind(places, sun, wind)
    return rounded(out.select("county_fips", "lat", "solar_ghi_kwh_m2_day", "wind_capacity_factor",
                              F.col("renewable_potential_score").alias("score")))


_SUN = "s_acctbal / 2000 + 3"
_WIND = "CASE WHEN s_nationkey < 20 THEN s_acctbal / 20000 END"


@query(f"""
WITH x AS (SELECT s_suppkey, {_SUN} AS sun, {_WIND} AS wind FROM supplier),
y AS (SELECT *, least(greatest((sun - 3) / 3.5, 0), 1) * 100 AS a,
             least(greatest((wind - 0.15) / 0.3, 0), 1) * 100 AS b FROM x)
SELECT s_suppkey, nullif(round_even(CASE WHEN wind IS NULL THEN a ELSE (a + b) / 2 END * 100, 0) / 100, 0)
       AS renewable_potential_score FROM y
""")
def renewable_potential(spark, folder):
    suppliers = table(spark, folder, "supplier")
    sun = F.col("s_acctbal") / 2000 + 3
    wind = F.when(F.col("s_nationkey") < 20, F.col("s_acctbal") / 20000)
    return suppliers.select("s_suppkey", features.potential(sun, wind).alias("renewable_potential_score"))


_CODE_SQL = "lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 7, '0')"


def _counties(spark, folder):
    return table(spark, folder, "supplier").select(
        F.concat(pad_code("s_nationkey", 2), pad_code("s_suppkey", 7)).alias("county_fips"),
        "s_suppkey", "s_nationkey", "s_acctbal")


def _state_climate(spark, folder):
    return table(spark, folder, "customer").groupBy(
        pad_code("c_nationkey", 2).alias("state_fips")).agg(
        r(F.avg("c_acctbal"), 4).alias("avg_temp_f"),
        F.count(F.lit(1)).cast("double").alias("cooling_degree_days"))


_CLIMATE_SQL = """
clim AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS state_fips, round(avg(c_acctbal), 4) AS avg_temp_f,
                count(*)::DOUBLE AS cooling_degree_days FROM customer GROUP BY 1)
"""


@query(f"""WITH {_CLIMATE_SQL}, c AS (SELECT {_CODE_SQL} AS county_fips FROM supplier)
SELECT county_fips, avg_temp_f, cooling_degree_days, NULL::DOUBLE AS temp_variance,
       NULL::DOUBLE AS extreme_weather_events_yr FROM c LEFT JOIN clim ON left(county_fips, 2) = state_fips""")
def climate_by_state(spark, folder):
    return features.climate_from_states(_counties(spark, folder), _state_climate(spark, folder))


@query(f"""WITH {_CLIMATE_SQL}, c AS (SELECT {_CODE_SQL} AS county_fips, * FROM supplier),
items AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS flow, round(max(l_discount) * 100, 6) AS ground
          FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
power AS (SELECT c_nationkey, round(avg(c_acctbal), 6) AS rate, round(count_if(c_acctbal < 0) * 100.0 / count(*), 6) AS share,
                 round(sum(abs(c_acctbal)), 4) AS made FROM customer GROUP BY 1),
x AS (SELECT s_suppkey AS k, {_SUN} AS sun, {_WIND} AS wind FROM supplier),
y AS (SELECT *, least(greatest((sun - 3) / 3.5, 0), 1) * 100 AS a, least(greatest((wind - 0.15) / 0.3, 0), 1) * 100 AS b FROM x)
SELECT county_fips, left(county_fips, 2) AS state_fips, n_name AS state, rate AS industrial_rate_cents_kwh,
       share AS renewable_pct, made AS total_generation_mwh, sun AS solar_ghi_kwh_m2_day, wind AS wind_capacity_factor,
       nullif(round_even(CASE WHEN wind IS NULL THEN a ELSE (a + b) / 2 END * 100, 0) / 100, 0) AS renewable_potential_score,
       avg_temp_f, cooling_degree_days, NULL::DOUBLE AS temp_variance, NULL::DOUBLE AS extreme_weather_events_yr,
       ground AS groundwater_level_ft, nullif(round_even(flow * 100, 0) / 100, 0) AS surface_water_flow_cfs,
       NULL::DOUBLE AS drought_severity_index
FROM c JOIN nation ON s_nationkey = n_nationkey LEFT JOIN clim ON left(county_fips, 2) = state_fips
LEFT JOIN power ON c_nationkey = s_nationkey LEFT JOIN y ON k = s_suppkey LEFT JOIN items ON l_suppkey = s_suppkey""")
def feature_table(spark, folder):
    """All four sources, each as its own answers would give it, written in equal buckets of the county."""
    def kept(df, name):
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        files.write_bucketed(df, path, "county_fips", 8)
        return files.read_bucketed(spark, path, "county_fips", 8)

    counties = _counties(spark, folder)
    known = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        r(F.avg("c_acctbal")).alias("rate"), r(F.count_if(F.col("c_acctbal") < 0) * 100.0 / F.count(F.lit(1))).alias("share"),
        r(F.sum(F.abs("c_acctbal")), 4).alias("made"))
    states = table(spark, folder, "nation").select(pad_code("n_nationkey", 2).alias("state_fips"), "n_nationkey", F.col("n_name").alias("state"))
    by_state = states.join(known, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    power = features.electricity(
        by_state.select("state", F.col("rate").alias("industrial_rate_cents_kwh")),
        by_state.select("state", F.col("share").alias("renewable_pct"), F.col("made").alias("total_generation_mwh")),
        states.select("state_fips", "state"))
    answer = lambda value, name: counties.join(table(spark, folder, "supplier").select("s_suppkey", value.alias("v")), "s_suppkey").select(
        "county_fips", F.struct(F.struct(F.col("v").alias(name)).alias("outputs")).alias("payload"))
    renewable = features.sun_and_wind(
        counties.select("county_fips"), answer(F.col("s_acctbal") / 2000 + 3, "solrad_annual"),
        answer(F.when(F.col("s_nationkey") < 20, F.col("s_acctbal") / 20000), "capacity_factor"))
    climate = features.climate_from_states(counties, _state_climate(spark, folder))
    items = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        r(F.avg("l_quantity")).alias("flow"), r(F.max("l_discount") * 100).alias("ground"))
    read = counties.join(items, "s_suppkey").select("county_fips", F.lit(0).alias("series"), "flow", "ground")
    water = features.water(counties, read.select("county_fips", "series", F.col("ground").cast("string").alias("reading")),
                           read.select("county_fips", "series", F.col("flow").cast("string").alias("reading")))
    return features.master_features(
        kept(counties.select("county_fips"), "counties"), power, kept(renewable, "renewable"), kept(climate, "climate"), kept(water, "water"))


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal <> 0 AND s_nationkey <> 0
       THEN '{"type":"Point","coordinates":[' || s_nationkey || ',' || s_suppkey || ']}' END AS coordinates
FROM supplier WHERE s_suppkey <> 0 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_suppkey = 0
""")
def supplier_points(spark, folder):
    p = point(F.nullif("s_nationkey", F.lit(0)), F.col("s_suppkey"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") != 0, F.to_json(p)).alias("coordinates"))


@query("""
SELECT n_name AS dimension, round(a, 9) AS assumed, round(d, 9) AS derived, round(d - a, 9) AS delta
FROM (SELECT n_name, avg(s_acctbal) / 10000 AS a, max(s_acctbal) / 10000 AS d
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
""")
def weight_deltas(spark, folder):
    from sitegauge.operators.composite import weight_shift

    means = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        (F.avg("s_acctbal") / 10000).alias("a"), (F.max("s_acctbal") / 10000).alias("d")).collect()  # one row per nation
    return rounded(weight_shift(spark, {m["n_name"]: m["d"] for m in means}, {m["n_name"]: m["a"] for m in means}), 9)
