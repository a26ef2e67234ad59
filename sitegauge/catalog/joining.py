"""Join and set queries."""

from pyspark.sql import functions as F

from sitegauge.catalog import query, r, table
from sitegauge.operators import joins
from sitegauge.session import stage


@query("""
SELECT n_nationkey, n_name, r_name, s.suppliers, round(s.balance, 4) AS balance, c.customers
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, avg(s_acctbal) AS balance FROM supplier
           WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_mktsegment = 'BUILDING'
           GROUP BY 1) c ON n_nationkey = c_nationkey
""")
def nation_spine(spark, folder):
    """Coarse rows copied to finer ones, then two tables left-joined to the spine."""
    regions = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    spine = joins.left_chain(table(spark, folder, "nation"), "n_regionkey", regions).drop("n_regionkey")
    suppliers = table(spark, folder, "supplier").filter("s_acctbal > 5000").groupBy(
        F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("suppliers"), r(F.avg("s_acctbal"), 4).alias("balance"))
    customers = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(
        F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return joins.left_chain(spine, "n_nationkey", suppliers, None, customers)


@query("""
SELECT c_custkey, o_custkey, round(total, 2) AS total FROM customer
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F'
           GROUP BY 1) ON c_custkey = o_custkey
""")
def customers_with_finished_totals(spark, folder):
    totals = table(spark, folder, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        r(F.sum("o_totalprice"), 2).alias("total"))
    return joins.left_renamed(table(spark, folder, "customer").select("c_custkey"), totals,
                              "c_custkey", "o_custkey")


@query("""
SELECT e.user_id, e.event_id, e.value AS value_x, u.value AS value_y
FROM events e JOIN (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1) u
ON e.user_id = u.user_id
""")
def events_with_worst_error(spark, folder):
    events = table(spark, folder, "events")
    worst = events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("value").alias("value"))
    return joins.inner_suffixed(events.select("user_id", "event_id", "value"), worst, "user_id")


@query("""
SELECT c_custkey, c_name, n_name AS nation, o.n AS orders, o.last_order FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY 1) o
ON c_custkey = o_custkey
""")
def customers_with_records(spark, folder):
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_order"))
    nations = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("owner"), "n_name")
    out = joins.with_records(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey",
                             place=(nations, "owner"), orders=(orders, "o_custkey"))
    return out.select("c_custkey", "c_name", F.col("place.n_name").alias("nation"),
                      F.col("orders.n").alias("orders"), F.col("orders.last_order").alias("last_order"))


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN
       (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def customers_without_urgent_orders(spark, folder):
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))
    return joins.absent(table(spark, folder, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query("""
WITH over AS (SELECT o_custkey AS key, round(max(o_totalprice), 2) AS amount FROM orders
              WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS key, c_acctbal AS amount FROM customer WHERE c_custkey NOT IN (SELECT key FROM over)
UNION ALL SELECT key, amount FROM over
""")
def balances_overridden_by_orders(spark, folder):
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    over = table(spark, folder, "orders").filter("o_orderstatus = 'P'").groupBy(
        F.col("o_custkey").alias("key")).agg(r(F.max("o_totalprice"), 2).alias("amount"))
    return joins.override(base, over, "key")


@query("""
SELECT s_name AS name, s_nationkey AS nation, 1 AS label, 'supplier' AS kind FROM supplier
UNION ALL SELECT c_name, c_nationkey, 0, 'customer' FROM customer
""")
def parties(spark, folder):
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return joins.labelled_union((suppliers, {"label": 1, "kind": "supplier"}),
                                (customers, {"label": 0, "kind": "customer"}))


@query("""
WITH a AS (SELECT l_suppkey AS k, rank() OVER (ORDER BY sum(l_quantity)) AS x FROM lineitem
           WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_suppkey AS k, rank() OVER (ORDER BY sum(l_quantity)) AS y FROM lineitem
      WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY 1)
SELECT k, x, y FROM a JOIN b USING (k)
""")
def rankings_on_shared_suppliers(spark, folder):
    from sitegauge.operators.ranking import value_counts_ranked

    items = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "k")

    def ranked(rows, out):
        sums = stage(rows.groupBy("k").agg(F.sum("l_quantity").alias("q")), "sums")
        places = value_counts_ranked(sums, "q").select("q", (F.col("n_before") + 1).alias(out))
        return sums.join(places, "q").select("k", out)

    return ranked(items.filter("l_returnflag = 'A'"), "x").join(
        ranked(items.filter("l_returnflag = 'R' and l_discount > 0.08"), "y"), "k")
