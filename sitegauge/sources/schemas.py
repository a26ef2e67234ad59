"""Explicit schemas of the files read; nothing is inferred."""

from pyspark.sql import types as T

POSTS_RAW = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

CROSSWALK = "place_name string, county_fips string"

SENSITIVITY = "scenario_1 string, scenario_2 string, kendall_tau double, p_value double, stability string"

TOPIC_SUMMARY = "topic_id int, label string, top_words string"

WEIGHTS = (
    "weights map<string,double>, fallback_weights map<string,double>, strategy string, "
    "macro_f1 double, macro_f1_spread double, n_successful long, n_blocked long, raw_coefficients map<string,double>")

MODEL_VERSIONS = (
    "model_version string, data_hash string, seeded_at timestamp, n_locations long, "
    "weights map<string,double>, is_active boolean")

# Landed service answers, one record per requested key.
PRICE = "response struct<data: array<struct<price: string>>>"
# Keeps a price's JSON type: the text "0" is a price, the number 0 is none.
PRICE_AS_SENT = "response struct<data: array<struct<price: variant>>>"
GENERATION = (
    "response struct<data: array<struct<period: string, generation: string, fueltypeid: string>>>")
SOLAR = "outputs struct<solrad_annual: double>"
WIND = "outputs struct<capacity_factor: double>"
CLIMATE = "results array<struct<datatype: string, value: double>>"
WATER = (
    "value struct<timeSeries: array<struct<values: "
    "array<struct<value: array<struct<value: string>>>>>>>")
