"""Ranking, top-k and normalization queries."""

from pyspark.sql import Window, functions as F

from sitegauge.catalog import query, rounded, table
from sitegauge.operators import joins, normalize as norm, ranking
from sitegauge.session import stage

_RANK_DESC = """(count(*) OVER (PARTITION BY {v}) - 1) / 2.0 + rank() OVER (ORDER BY {v} DESC)"""
_RANK_ASC = """(count(*) OVER (PARTITION BY {v}) - 1) / 2.0 + rank() OVER (ORDER BY {v})"""


@query(f"""
SELECT c_custkey, round(({_RANK_ASC.format(v='c_acctbal')}) / count(*) OVER () * 100, 6) AS pct_rank
FROM customer
""")
def balance_percentile(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return rounded(ranking.with_average_rank(df, "c_acctbal", "pct_rank", percent=True)).select(
        "c_custkey", "pct_rank")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v IS NOT NULL THEN
       (count(*) OVER (PARTITION BY v) - 1) / 2.0 + rank() OVER (ORDER BY v DESC NULLS LAST) END AS rank
FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_quantity END AS v FROM lineitem)
""")
def quantity_rank_with_ties(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("v"))
    return ranking.with_average_rank(df, "v", "rank", descending=True).drop("v")


@query("""
SELECT o_orderkey, o_orderpriority, round((count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0
       + rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) AS price_rank
FROM orders
""")
def price_rank_within_priority(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.with_average_rank(df, "o_totalprice", "price_rank", ["o_orderpriority"]).drop("o_totalprice")


_MOVERS = """
WITH t AS (SELECT c_custkey, c_acctbal, sum(o_totalprice) AS total
           FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
k AS (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS raw_rank,
      rank() OVER (ORDER BY total DESC) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS corrected_rank FROM t),
m AS (SELECT *, raw_rank - corrected_rank AS rank_change FROM k)
"""


def _balance_and_total(spark, folder):
    # Added up in the order of the order numbers: doubles added in another order differ in their last digits, which would
    # part customers of equal totals.
    by_number = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.sum("o_totalprice").over(by_number.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.lead(F.lit(1)).over(by_number).alias("_next")).filter("_next is null").drop("_next")
    joined = table(spark, folder, "customer").select("c_custkey", "c_acctbal").join(
        orders, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    return stage(joined, "totals")


@query(_MOVERS + "SELECT c_custkey, raw_rank, corrected_rank, rank_change FROM m")
def rank_changes(spark, folder):
    return ranking.rank_movers(_balance_and_total(spark, folder), "c_acctbal", "total").drop(
        "c_acctbal", "total")


@query(_MOVERS + """
SELECT c_custkey, raw_rank, corrected_rank, rank_change FROM m
QUALIFY rank() OVER (ORDER BY rank_change DESC) <= 5
""")
def biggest_climbers(spark, folder):
    return ranking.rank_movers(_balance_and_total(spark, folder), "c_acctbal", "total", 5).drop(
        "c_acctbal", "total")


@query("""
SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS rank
FROM customer
""")
def sequence_by_nation(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return ranking.with_sequence(df, [F.desc_nulls_last("c_nationkey"), F.asc("c_custkey")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def dearest_orders(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return ranking.top_k(df, "o_totalprice", 25, "o_orderkey")


@query("""
SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10
""")
def largest_parts_with_ties(spark, folder):
    return ranking.top_k_with_ties(table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", 10)


@query("""
SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders
WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey
""")
def first_urgent_order(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("price"))
    return joins.first_known(df, "o_custkey", "price", "o_orderkey")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN value > 10 THEN upper(event_type) ELSE event_type END AS name FROM events)
SELECT user_id, event_id, name FROM e
QUALIFY row_number() OVER (PARTITION BY user_id, lower(name) ORDER BY event_id) = 1
""")
def first_use_ignoring_case(spark, folder):
    df = table(spark, folder, "events").select(
        "user_id", "event_id",
        F.when(F.col("value") > 10, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"))
    return joins.distinct_in_order(df, "user_id", "name", "event_id")


@query("""
SELECT doc_id, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def first_copy_of_each_text(spark, folder):
    docs = table(spark, folder, "documents").withColumn("digest", F.sha2("text", 256))
    narrow = docs.select("doc_id", "source", "n_chars", "digest")
    return joins.first_per_key(narrow, "digest", ["doc_id"]).drop("digest")


@query("""
WITH p AS (SELECT url, split_part(url, '/', 4) AS lang, page_id FROM pages WHERE contains(url, 'example.com'))
SELECT lang, page_id FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY page_id) = 1
""")
def first_page_per_section(spark, folder):
    pages = table(spark, folder, "pages").filter(F.col("url").contains("example.com"))
    pages = pages.select(F.split("url", "/")[3].alias("lang"), "page_id")
    return joins.first_per_key(pages, "lang", ["page_id"])


def _z(c, source):
    return f"""(least(greatest(({c} - (SELECT avg({c}) FROM {source}))
        / (SELECT stddev_pop({c}) FROM {source}), -3), 3) + 3) / 6 * 100"""


@query(f"""
SELECT o_orderkey, round({_z('o_totalprice', 'orders')}, 6) AS o_totalprice,
       round(100 - {_z('o_custkey', 'orders')}, 6) AS o_custkey
FROM orders
""")
def normalized_by_z_score(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(norm.normalize(df, ["o_totalprice", "o_custkey"], inverted=["o_custkey"]))


_PCT = """((count(*) OVER (PARTITION BY {v}) - 1) / 2.0 + rank() OVER (ORDER BY {v})) / count({v}) OVER () * 100"""


@query(f"""
SELECT doc_id, round(CASE WHEN abs((SELECT skewness(n_chars) FROM documents)) > 2
       THEN {_PCT.format(v='n_chars')} ELSE {_z('n_chars', 'documents')} END, 6) AS n_chars
FROM documents
""")
def normalized_by_percentile(spark, folder):
    return rounded(norm.normalize(table(spark, folder, "documents").select("doc_id", "n_chars"), ["n_chars"]))


@query(f"""
SELECT c_name, round({_z('c_custkey', 'customer')}, 6) AS c_custkey,
       round({_z('c_nationkey', 'customer')}, 6) AS c_nationkey,
       round({_z('c_acctbal', 'customer')}, 6) AS c_acctbal, c_mktsegment
FROM customer
""")
def normalized_customer_table(spark, folder):
    return rounded(norm.normalize_table(table(spark, folder, "customer")))


@query(f"""
SELECT event_id, round(100 - CASE WHEN abs((SELECT skewness(value) FROM events)) > 2
       THEN {_PCT.format(v='value')} ELSE {_z('value', 'events')} END, 6) AS value
FROM events
""")
def inverted_event_value(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return rounded(norm.normalize_dimension(df, "value", inverted=True))


@query("""
SELECT 'n_chars' AS "column", round(skewness(n_chars), 6) AS skew,
       CASE WHEN abs(skewness(n_chars)) > 2 THEN 'percentile' ELSE 'z-score' END AS method FROM documents
UNION ALL SELECT 'doc_id', round(skewness(doc_id), 6), 'z-score' FROM documents
""")
def normalization_methods(spark, folder):
    return rounded(norm.normalization_report(table(spark, folder, "documents"), ["n_chars", "doc_id"]))
