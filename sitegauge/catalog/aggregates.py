"""Counting, describing and reshaping queries."""

from pyspark.sql import functions as F

from sitegauge.catalog import documents, query, r, rounded, table
from sitegauge.functions.scalars import (
    class_ratio, clip, first_max_index, pad_code, row_known_share, row_mean, row_sum, share_pct, tier,
)
from sitegauge.operators import profile
from sitegauge.operators.corpus import corpus_stats
from sitegauge.operators.joins import ordered_lists
from sitegauge.operators.ranking import quantiles
from sitegauge.plans import features
from sitegauge.session import spread
from sitegauge.sources.fixed_values import PRIORITY_FEATURES
from sitegauge.sources.publish import content_hash


@query("""
SELECT event_type, round(avg(signal), 6) AS raw_resistance_mean, max(signal) AS raw_resistance_max,
       count(signal) AS post_count, round(stddev_samp(signal), 6) AS std_resistance,
       round(avg(mood), 6) AS avg_sentiment,
       round(avg(CASE WHEN mood < -0.05 THEN 1.0 ELSE 0.0 END) * 100, 6) AS negative_pct
FROM (SELECT event_type, value AS signal, value / 100 - 0.3 AS mood FROM events)
GROUP BY event_type
""")
def signal_by_event_type(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", F.col("value").alias("signal"), (F.col("value") / 100 - 0.3).alias("mood"))
    return rounded(profile.group_signal(events, "event_type", "signal", "mood"))


@query("""
SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM events GROUP BY event_type
""")
def event_type_shares(spark, folder):
    return rounded(profile.value_shares(table(spark, folder, "events"), "event_type"))


@query("""
SELECT c_mktsegment, c_nationkey, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM customer GROUP BY c_mktsegment, c_nationkey
""")
def segment_nation_shares(spark, folder):
    return rounded(profile.value_shares(
        table(spark, folder, "customer"), "c_mktsegment", "c_nationkey"))


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
       round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct,
       round(skewness({c}), 6) AS skew
FROM (SELECT l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)
""" for c in _PROFILED))
def lineitem_profile(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount",
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return rounded(profile.column_profile(items))


@query(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75
FROM lineitem
""" for c in _PROFILED))
def lineitem_quartiles(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", *_PROFILED)
    return rounded(profile.describe(spread(items, "l_orderkey"), _PROFILED).select(
        "column", "p25", "p50", "p75"))


@query("""
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price,
       round(quantile_cont(o_totalprice, 0.9), 4) AS p90_price
FROM orders GROUP BY o_orderpriority
""")
def order_price_quantiles_by_priority(spark, folder):
    found = quantiles(table(spark, folder, "orders"), ["o_totalprice"], [0.5, 0.9], ["o_orderpriority"])
    return found.select("o_orderpriority", r("q0", 4).alias("median_price"),
                        r("q1", 4).alias("p90_price"))


@query("""
SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count FROM orders
UNION ALL SELECT 'late_price', count(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) FROM orders
""")
def columns_with_values(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_totalprice", F.lit(None).cast("double").alias("never"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("late_price"),
        F.when(F.col("o_orderstatus") == "?", F.col("o_totalprice")).alias("odd_price"))
    return profile.column_profile(profile.drop_all_null(orders)).select("column", "count")


def _priced(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("gross"))


_PRICED_SQL = """
priced AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
                  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem)
"""
_PRICED = ["l_quantity", "l_extendedprice", "net", "gross"]


@query(f"WITH {_PRICED_SQL}" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(
        f"round(corr({a}, {b}), 6) AS {b}" if a != b else f"1.0::DOUBLE AS {b}" for b in _PRICED)
    + " FROM priced" for a in _PRICED))
def price_correlations(spark, folder):
    return rounded(profile.correlation_matrix(_priced(spark, folder)))


@query(f"""
WITH {_PRICED_SQL}, pairs AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM priced"
    for i, a in enumerate(_PRICED) for b in _PRICED[i + 1:]) + """)
SELECT feature_1, feature_2, round(r, 4) AS r,
       CASE WHEN abs(r) > 0.9 THEN 'DROP ''' || feature_1 || ''' (near-duplicate of ''' || feature_2
                 || ''', r=' || printf('%+.3f', round(r, 4)) || ')'
            ELSE 'COMBINE ''' || feature_1 || ''' and ''' || feature_2
                 || ''' into composite feature, or monitor' END AS recommendation
FROM pairs WHERE abs(r) > 0.7
""")
def collinear_price_columns(spark, folder):
    pairs = profile.collinear_pairs(profile.correlation_pairs(_priced(spark, folder)))
    return profile.recommend(pairs.drop("action"), PRIORITY_FEATURES)


@query("""
WITH x AS (SELECT nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b,
                  CASE WHEN l_quantity > 25 THEN l_quantity END AS c, l_returnflag FROM lineitem),
y AS (SELECT l_returnflag, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s,
             (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS k FROM x)
SELECT l_returnflag, round(sum(s), 4) AS sums, round(avg(s / nullif(k, 0)), 6) AS means,
       round(avg(k / 3.0), 6) AS known, count_if(k = 0) AS empty_rows
FROM y GROUP BY l_returnflag
""")
def rowwise_known_means(spark, folder):
    x = table(spark, folder, "lineitem").select(
        "l_returnflag", F.nullif("l_discount", F.lit(0.0)).alias("a"),
        F.nullif("l_tax", F.lit(0.0)).alias("b"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("c"))
    cols = ["a", "b", "c"]
    rows = x.select("l_returnflag", row_sum(cols).alias("s"), row_mean(cols).alias("m"),
                    row_known_share(cols).alias("k"))
    return rows.groupBy("l_returnflag").agg(
        r(F.sum("s"), 4).alias("sums"), r(F.avg("m")).alias("means"), r(F.avg("k")).alias("known"),
        F.count_if(F.col("k") == 0).alias("empty_rows"))


@query("""
SELECT CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 0
            WHEN l_tax >= l_quantity / 500 THEN 1 ELSE 2 END::INT AS strongest,
       count(*) AS n
FROM lineitem GROUP BY 1
""")
def strongest_rate(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("per", F.col("l_quantity") / 500)
    return items.groupBy(first_max_index(["l_discount", "l_tax", "per"]).alias("strongest")).agg(
        F.count(F.lit(1)).alias("n"))


_TOKENS_SQL = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')"


@query(f"""
SELECT item, count(*) AS n
FROM (SELECT unnest({_TOKENS_SQL}) AS item FROM documents)
WHERE regexp_full_match(item, '[a-z][a-z]+') GROUP BY item
""")
def word_frequency(spark, folder):
    from sitegauge.functions.text import topic_tokens

    docs = documents(spark, folder).select(topic_tokens("text").alias("tokens"))
    return profile.list_frequency(docs, "tokens")


@query("""
SELECT source, count(*) AS n, min(n_chars) AS min_length, max(n_chars) AS max_length,
       list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median_length
FROM documents GROUP BY source
""")
def length_spread_by_source(spark, folder):
    return profile.length_spread(table(spark, folder, "documents"), "n_chars", ["source"])


@query("""
WITH s AS (SELECT 'source' AS part, source AS name, count(*) AS n,
                  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
           FROM documents GROUP BY source),
q AS (SELECT 'query' AS part, lang AS name, count(*) AS n,
             round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang),
l AS (SELECT list_sort(list(length(text))) AS v FROM documents)
SELECT * FROM s UNION ALL SELECT * FROM q
UNION ALL SELECT 'length', 'min', v[1], NULL FROM l
UNION ALL SELECT 'length', 'max', v[len(v)], NULL FROM l
UNION ALL SELECT 'length', 'median', v[len(v) // 2 + 1], NULL FROM l
""")
def corpus_statistics(spark, folder):
    posts = table(spark, folder, "documents").select(
        "source", F.col("lang").alias("query"), F.col("text").alias("content"))
    stats = corpus_stats(posts)
    by = [stats[f"by_{c}"].select(F.lit(c).alias("part"), F.col(c).alias("name"), "n",
                                  r("pct").alias("pct")) for c in ("source", "query")]
    ends = stats["length"].select(F.inline(F.array(*[
        F.struct(F.lit("length").alias("part"), F.lit(name).alias("name"),
                 F.col(f"{name}_length").cast("long").alias("n"),
                 F.lit(None).cast("double").alias("pct")) for name in ("min", "max", "median")])))
    return by[0].unionByName(by[1]).unionByName(ends)


def _histogram_sql(table_name, column, bins):
    return f"""
WITH e AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table_name}),
b AS (SELECT unnest(range({bins}))::INT AS bin),
c AS (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins} - 1)::INT AS bin, count(*) AS n
      FROM {table_name}, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS low,
       round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS high, coalesce(c.n, 0) AS n
FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin
"""


@query(_histogram_sql("customer", "c_acctbal", 20))
def balance_histogram(spark, folder):
    return rounded(profile.histogram(table(spark, folder, "customer"), "c_acctbal", 20))


@query(_histogram_sql("documents", "n_chars", 50))
def length_histogram(spark, folder):
    return rounded(profile.histogram(table(spark, folder, "documents"), "n_chars", 50))


@query("""
SELECT count(*) AS entries, count(n) AS hits, count_if(n IS NULL) AS misses
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
ON c_custkey = o_custkey
""")
def customers_with_and_without_orders(spark, folder):
    from sitegauge.operators.places import hits_and_misses

    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("string").alias("fips"))
    cache = table(spark, folder, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return hits_and_misses(cache)


@query("""
SELECT string_agg(o_orderpriority, ',' ORDER BY pos) AS priorities, o_custkey
FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2)
GROUP BY o_custkey
""")
def priorities_in_order_of_use(spark, folder):
    lists = ordered_lists(table(spark, folder, "orders"), "o_custkey", "o_orderpriority",
                          "o_orderkey", "list")
    return lists.select("o_custkey", F.array_join("list", ",").alias("priorities"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1")
def brands(spark, folder):
    return profile.sorted_distinct(table(spark, folder, "part"), "p_brand")


@query("""
SELECT count(*) AS n, round(avg(s), 6) AS avg_score, count_if(s >= 70) AS n_high,
       count_if(s < 50) AS n_low
FROM (SELECT (c_acctbal + 1000) / 110 AS s FROM customer)
""")
def balance_summary_cards(spark, folder):
    scores = table(spark, folder, "customer").select(((F.col("c_acctbal") + 1000) / 110).alias("s"))
    return rounded(profile.score_summary(scores, "s"))


@query("""
SELECT c_mktsegment, tier, count(*) AS n FROM (
  SELECT c_mktsegment, CASE WHEN s >= 70 THEN 'high' WHEN s >= 50 THEN 'moderate' ELSE 'low' END AS tier
  FROM (SELECT c_mktsegment, (c_acctbal + 1000) / 110 AS s FROM customer))
GROUP BY ALL
""")
def balance_tiers(spark, folder):
    return table(spark, folder, "customer").select(
        "c_mktsegment", tier((F.col("c_acctbal") + 1000) / 110).alias("tier")).groupBy(
        "c_mktsegment", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT l_returnflag, count_if(l_linestatus = 'O') AS o, count_if(l_linestatus = 'F') AS f,
                  count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(o / greatest(f, 1), 6) AS ratio, round(o * 100.0 / n, 6) AS open_pct,
       least(greatest(q, 25.4), 25.5) = q AS inside, lpad(n::VARCHAR, 8, '0') AS code FROM g
""")
def line_status_balance(spark, folder):
    g = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("o"),
        F.count_if(F.col("l_linestatus") == "F").alias("f"),
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"))
    return g.select(
        "l_returnflag", r(class_ratio("o", "f")).alias("ratio"),
        r(share_pct("o", "n")).alias("open_pct"),
        (clip("q", 25.4, 25.5) == F.col("q")).alias("inside"), pad_code("n", 8).alias("code"))


_FUEL_SQL = """CASE event_type WHEN 'view' THEN 'ALL' WHEN 'click' THEN 'SUN'
               WHEN 'purchase' THEN 'WND' WHEN 'signup' THEN 'GEO' ELSE 'COL' END"""


def _fuel_rows(spark, folder):
    fuel = (F.when(F.col("event_type") == "view", "ALL").when(F.col("event_type") == "click", "SUN")
            .when(F.col("event_type") == "purchase", "WND")
            .when(F.col("event_type") == "signup", "GEO").otherwise("COL"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("state"), F.date_format("ts", "yyyy-MM").alias("period"),
        fuel.alias("fuel"), F.col("value").alias("generation"), F.col("event_id").alias("pos"))


@query(f"""
WITH e AS (SELECT user_id AS state, strftime(ts, '%Y-%m') AS period, {_FUEL_SQL} AS fuel,
                  value AS generation, event_id AS pos FROM events),
l AS (SELECT * FROM e QUALIFY rank() OVER (PARTITION BY state ORDER BY period DESC) = 1),
g AS (SELECT state, arg_max(generation, pos) FILTER (fuel = 'ALL') AS total,
             sum(CASE WHEN fuel IN ('SUN', 'WND', 'HYC', 'GEO', 'WWW') THEN generation ELSE 0 END) AS green
      FROM l GROUP BY state)
SELECT state, CASE WHEN total > 0 THEN round(green / total * 100, 2) END AS renewable_pct,
       CASE WHEN total > 0 THEN total END AS total_generation_mwh
FROM g
""")
def latest_period_mix(spark, folder):
    return features.latest_mix(_fuel_rows(spark, folder))


@query("""
SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') / 10 AS avg_temp_f,
       arg_max(value, event_id) FILTER (event_type = 'click') AS cooling_degree_days
FROM events GROUP BY user_id
""")
def last_reading_per_kind(spark, folder):
    wide = features.last_by_kind(table(spark, folder, "events"), "user_id", "event_type", "value",
                                 "event_id", {"tenths": "view", "cooling_degree_days": "click"})
    return wide.select("user_id", (F.col("tenths") / 10).alias("avg_temp_f"), "cooling_degree_days")


@query("""
WITH last AS (SELECT user_id, day(ts) - 1 AS series, arg_max((props->>'$.k')::INT, event_id) AS reading
              FROM events GROUP BY 1, 2)
SELECT user_id AS county_fips, nullif(round_even(avg(reading) FILTER (series < 10) * 100, 0) / 100, 0)
       AS surface_water_flow_cfs
FROM last GROUP BY user_id
""")
def mean_of_last_readings(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("county_fips"), (F.dayofmonth("ts") - 1).alias("series"),
        "event_id", F.get_json_object("props", "$.k").alias("reading"))
    return features.mean_flow(features.last_readings(rows, "county_fips", "series", "event_id", "reading"))


_DIGESTED = {
    "customer": ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"],
    "orders": ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"],
    "lineitem": ["l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"],
    "documents": ["doc_id", "lang", "n_chars", "source", "text"],
}


def _digest_sql(name: str, columns: list[str]) -> str:
    row = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'null')" for c in sorted(columns))
    return f"""SELECT '{name}' AS dataset, substring(sha256('{",".join(sorted(columns))}|' || count(*) || '|'
      || coalesce(sum(('0x' || substring(h, 1, 15))::BIGINT), 0) || '|'
      || coalesce(sum(('0x' || substring(h, 17, 15))::BIGINT), 0)), 1, 12) AS data_hash, count(*) AS n_rows
      FROM (SELECT md5({row}) AS h FROM {name})"""


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _DIGESTED.items()))
def table_digests(spark, folder):
    """Order-insensitive digests."""
    parts = [content_hash(table(spark, folder, t).select(*columns)).withColumn("dataset", F.lit(t))
             for t, columns in _DIGESTED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
