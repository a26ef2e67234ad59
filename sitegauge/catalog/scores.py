"""Composite scores over suppliers, and the read queries on top of them."""

from itertools import combinations

from pyspark.sql import functions as F

from sitegauge.catalog import TAIL_SQL, query, r, rounded, table
from sitegauge.functions.scalars import stability
from sitegauge.operators import composite, validation
from sitegauge.plans import results
from sitegauge.session import stage
from sitegauge.sources.fixed_values import FALLBACK_WEIGHTS, WEIGHT_SCENARIOS

# Suppliers stand for locations; "unrated" is a feature no table has.
SUPPLIER_DIMENSIONS = {
    "power": ["revenue", "s_acctbal"],
    "environmental": ["mean_quantity", "returned"],
    "social": ["mean_discount", "unrated"],
}
SUPPLIER_INVERTED = ["returned", "mean_discount"]

_FEATURES_SQL = """
f AS (SELECT s_suppkey, n_name AS state, s_acctbal, revenue, mean_quantity, returned, mean_discount
      FROM supplier JOIN nation ON s_nationkey = n_nationkey
      LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue,
                        avg(l_quantity) AS mean_quantity, sum((l_returnflag = 'R')::INT) AS returned,
                        avg(l_discount) AS mean_discount FROM lineitem GROUP BY 1)
      ON s_suppkey = l_suppkey)
"""


def _z(c, flip=False):
    z = f"""(least(greatest(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), -3), 3) + 3) / 6 * 100"""
    p = f"""((count(*) OVER (PARTITION BY {c}) - 1) / 2.0 + rank() OVER (ORDER BY {c})) / count({c}) OVER () * 100"""
    e = f"CASE WHEN abs((SELECT skewness({c}) FROM f)) > 2 THEN {p} ELSE {z} END"
    return f"100 - ({e})" if flip else e


_SCORES_SQL = f"""{_FEATURES_SQL},
n AS (SELECT s_suppkey, state, {_z('revenue')} AS a, {_z('s_acctbal')} AS b, {_z('mean_quantity')} AS c,
             {_z('returned', True)} AS d, {_z('mean_discount', True)} AS e,
             round(5 / 6 * ((revenue IS NOT NULL)::INT + (s_acctbal IS NOT NULL)::INT
                   + (mean_quantity IS NOT NULL)::INT + (returned IS NOT NULL)::INT
                   + (mean_discount IS NOT NULL)::INT) / 5, 3) AS confidence FROM f),
dims AS (SELECT s_suppkey, state, (a + b) / 2 AS power_score, (c + d) / 2 AS environmental_score,
                e AS social_score, confidence FROM n),
s AS (SELECT *, 0.45 * power_score + 0.3 * environmental_score + 0.25 * social_score AS psi FROM dims),
scored AS (SELECT *, row_number() OVER (ORDER BY psi DESC NULLS LAST, s_suppkey) AS rank FROM s)
"""


def supplier_features(spark, folder):
    """One row per supplier: a single pass over lineitem, staged for the passes that follow."""
    items = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.avg("l_quantity").alias("mean_quantity"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.avg("l_discount").alias("mean_discount"))
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    joined = suppliers.join(nations, "s_nationkey").join(
        items, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return stage(joined.drop("s_nationkey", "l_suppkey"), "suppliers")


def scored_suppliers(spark, folder, ranked=True):
    return composite.score_locations(
        supplier_features(spark, folder), FALLBACK_WEIGHTS, SUPPLIER_DIMENSIONS, SUPPLIER_INVERTED,
        "s_suppkey", ["state"], ranked=ranked)


_SHOWN = """s_suppkey, state, round(power_score, 6) AS power_score,
round(environmental_score, 6) AS environmental_score, round(social_score, 6) AS social_score,
round(psi, 6) AS psi, confidence, rank"""
_COLUMNS = ["s_suppkey", "state", "power_score", "environmental_score", "social_score", "psi",
            "confidence", "rank"]


@query(f"""WITH {_SCORES_SQL} SELECT {_SHOWN}, '1.0.0' AS model_version,
'{{"power": 0.45, "environmental": 0.3, "social": 0.25}}' AS weights_used FROM scored""")
def supplier_scores(spark, folder):
    return rounded(scored_suppliers(spark, folder))


@query(f"""WITH {_SCORES_SQL}, t AS (SELECT * FROM scored ORDER BY rank LIMIT 10),
b AS (SELECT * FROM scored ORDER BY rank DESC LIMIT 5)
SELECT s_suppkey, rank, round_even(psi, 1) AS psi, 'top' AS part FROM t
UNION ALL SELECT s_suppkey, rank, round_even(psi, 1), 'bottom' FROM b""")
def best_and_worst_suppliers(spark, folder):
    return composite.head_and_tail(
        scored_suppliers(spark, folder).select("s_suppkey", "rank", "psi"))


@query(f"""WITH {_SCORES_SQL} SELECT {_SHOWN} FROM scored WHERE psi >= 50
ORDER BY power_score DESC, s_suppkey LIMIT 20""")
def score_list(spark, folder):
    page = results.list_scores(scored_suppliers(spark, folder), min_psi=50, sort="power_score",
                               limit=20, key="s_suppkey")
    return rounded(page.data.select(*_COLUMNS))


@query(f"""WITH {_SCORES_SQL} SELECT least(count(*), 20) AS count, count(*) AS total FROM scored WHERE psi >= 50""")
def score_list_counts(spark, folder):
    page = results.list_scores(scored_suppliers(spark, folder), min_psi=50, limit=20, key="s_suppkey")
    counted = page.data.agg(F.count(F.lit(1)).alias("count"))
    total = page.matching.agg(F.count(F.lit(1)).alias("total"))
    return counted.withColumn("total", total.scalar())


@query(f"""WITH {_SCORES_SQL} SELECT {_SHOWN} FROM scored
WHERE state = (SELECT min(state) FROM scored) ORDER BY psi, s_suppkey LIMIT 500""")
def score_list_of_one_state(spark, folder):
    scores = scored_suppliers(spark, folder)
    first = results.scored_states(scores).head()[0]
    page = results.list_scores(scores, state=first, sort="unknown", order="asc", limit=500, key="s_suppkey")
    return rounded(page.data.select(*_COLUMNS))


@query(f"""WITH {_SCORES_SQL} SELECT s_suppkey, state, round(psi, 6) AS psi, rank,
round(revenue, 2) AS revenue, returned, round(mean_discount, 6) AS mean_discount
FROM scored JOIN f USING (s_suppkey, state) WHERE s_suppkey = 7""")
def score_detail(spark, folder):
    features = supplier_features(spark, folder)
    scores = composite.score_locations(features, FALLBACK_WEIGHTS, SUPPLIER_DIMENSIONS,
                                       SUPPLIER_INVERTED, "s_suppkey", ["state"])
    found = results.score_detail(scores, 7, features.drop("state"), key="s_suppkey")
    return found.select("s_suppkey", "state", r("psi").alias("psi"), "rank",
                        r("raw_features.revenue", 2).alias("revenue"),
                        F.col("raw_features.returned").alias("returned"),
                        r("raw_features.mean_discount").alias("mean_discount"))


@query(f"WITH {_SCORES_SQL} SELECT {_SHOWN} FROM scored")
def dimension_breakdown(spark, folder):
    found = results.dimension_breakdown(scored_suppliers(spark, folder), "s_suppkey")
    return rounded(found)


@query(f"WITH {_SCORES_SQL} SELECT {_SHOWN} FROM scored WHERE s_suppkey IN (1, 2, 5, 100000000)")
def compared_suppliers(spark, folder):
    return rounded(results.compare(scored_suppliers(spark, folder), [1, 2, 5, 100000000],
                                   "s_suppkey").select(*_COLUMNS))


@query(f"WITH {_SCORES_SQL} SELECT DISTINCT state FROM scored")
def states_with_scores(spark, folder):
    return results.scored_states(scored_suppliers(spark, folder, ranked=False))


@query("""
SELECT 'suppliers' AS dataset, count(*) AS n FROM supplier UNION ALL
SELECT 'items', count(*) FROM lineitem UNION ALL SELECT 'posts', count(*) FROM documents
UNION ALL SELECT 'topics', 0
""")
def dataset_availability(spark, folder):
    from sitegauge.sources.files import availability

    return availability(spark, {
        "suppliers": f"{folder}/supplier.parquet", "items": f"{folder}/lineitem.parquet",
        "posts": f"{folder}/documents.parquet", "topics": f"{folder}/no_topics.parquet"})


_NAMES = [*WEIGHT_SCENARIOS, "Derived"]
_SCENARIO_SQL = _SCORES_SQL + ", long AS (" + " UNION ALL ".join(
    f"""SELECT s_suppkey, '{n}' AS scenario, {w['power']} * power_score + {w['environmental']}
        * environmental_score + {w['social']} * social_score AS psi FROM dims"""
    for n, w in {**WEIGHT_SCENARIOS, "Derived": FALLBACK_WEIGHTS}.items()) + """),
ranks AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY psi DESC)
          + (count(*) OVER (PARTITION BY scenario, psi) - 1) / 2.0 AS rank FROM long WHERE psi IS NOT NULL)
"""


def _scenario_ranks(spark, folder):
    long = validation.scenario_scores(supplier_features(spark, folder), FALLBACK_WEIGHTS,
                                      SUPPLIER_DIMENSIONS, SUPPLIER_INVERTED, "s_suppkey")
    return validation.scenario_ranks(long, "s_suppkey")


@query(f"WITH {_SCENARIO_SQL} SELECT s_suppkey, scenario, round(psi, 6) AS psi, rank FROM ranks")
def scenario_ranks(spark, folder):
    return rounded(_scenario_ranks(spark, folder).drop("lower"))


@query(f"""WITH {_SCENARIO_SQL} SELECT s_suppkey, """ + ", ".join(
    f"max(rank) FILTER (scenario = '{n}') AS \"{n}\"" for n in _NAMES)
    + " FROM ranks GROUP BY 1 ORDER BY \"Derived\", 1 LIMIT 10")
def scenario_rank_table(spark, folder):
    wide = validation.rank_table(_scenario_ranks(spark, folder), _NAMES, "s_suppkey")
    return wide.orderBy("Derived", "s_suppkey").limit(10)


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS scenario_1, '{b}' AS scenario_2" for a, b in combinations(_NAMES, 2))


@query(f"""
WITH {_SCENARIO_SQL}, p AS ({_PAIRS_SQL}),
xy AS (SELECT scenario_1, scenario_2, x.s_suppkey AS k, x.rank AS x, y.rank AS y FROM p
       JOIN ranks x ON x.scenario = scenario_1 JOIN ranks y ON y.scenario = scenario_2 AND x.s_suppkey = y.s_suppkey),
pairs AS (SELECT a.scenario_1, a.scenario_2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS balance,
             sum((a.x <> b.x)::INT) AS dx, sum((a.y <> b.y)::INT) AS dy
      FROM xy a JOIN xy b ON a.scenario_1 = b.scenario_1 AND a.scenario_2 = b.scenario_2 AND a.k < b.k
      GROUP BY ALL),
t AS (SELECT *, round(balance / sqrt(dx) / sqrt(dy), 3) AS tau FROM pairs),
size AS (SELECT scenario_1, scenario_2, count(*)::DOUBLE AS n FROM xy GROUP BY ALL),
tx AS (SELECT scenario_1, scenario_2, sum(c * (c - 1) / 2) AS x1, sum(c * (c - 1) * (c - 2)) AS x2, sum(c * (c - 1) * (2 * c + 5)) AS x3
       FROM (SELECT scenario_1, scenario_2, x, count(*)::DOUBLE AS c FROM xy GROUP BY ALL) GROUP BY ALL),
ty AS (SELECT scenario_1, scenario_2, sum(c * (c - 1) / 2) AS y1, sum(c * (c - 1) * (c - 2)) AS y2, sum(c * (c - 1) * (2 * c + 5)) AS y3
       FROM (SELECT scenario_1, scenario_2, y, count(*)::DOUBLE AS c FROM xy GROUP BY ALL) GROUP BY ALL),
z AS (SELECT *, abs(balance) / sqrt((n * (n - 1) * (2 * n + 5) - x3 - y3) / 18 + 2 * x1 * y1 / (n * (n - 1))
        + x2 * y2 / (9 * n * (n - 1) * (n - 2))) AS z
      FROM t JOIN size USING (scenario_1, scenario_2) JOIN tx USING (scenario_1, scenario_2) JOIN ty USING (scenario_1, scenario_2)),
{TAIL_SQL}
SELECT scenario_1, scenario_2, tau AS kendall_tau,
       CASE WHEN tau > 0.8 THEN 'STABLE' WHEN tau > 0.5 THEN 'moderate' ELSE 'FRAGILE' END AS stability,
       round(least(1, 2 * q), 4) AS p_value
FROM tail
""")
def scenario_agreement(spark, folder):
    """Kendall's tau per scenario pair and its p in the normal form."""
    ranks = stage(_scenario_ranks(spark, folder), "ranks")
    return validation.kendall_pairs(ranks, _NAMES, "s_suppkey", "normal").select(
        "scenario_1", "scenario_2", "kendall_tau", stability("kendall_tau").alias("stability"), "p_value")


@query(f"""WITH {_SCORES_SQL}, one AS (SELECT min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 0),
d AS (SELECT s_nationkey % 20 AS nation, s_suppkey FROM supplier),
side AS (SELECT d.s_suppkey, count(*) AS posts, round(avg(n_chars), 6) AS mean_length FROM d
         JOIN documents ON source = 'src' || nation GROUP BY 1)
SELECT scored.s_suppkey, round(psi, 6) AS psi, rank, returned, posts, mean_length
FROM scored JOIN one ON s_suppkey = k JOIN f USING (s_suppkey) LEFT JOIN side ON side.s_suppkey = scored.s_suppkey""")
def score_detail_with_resistance(spark, folder):
    """One location with its features and what its texts say, each as a record."""
    features = supplier_features(spark, folder)
    scores = composite.score_locations(features, FALLBACK_WEIGHTS, SUPPLIER_DIMENSIONS, SUPPLIER_INVERTED, "s_suppkey", ["state"])
    texts = table(spark, folder, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("posts"), r(F.avg("n_chars")).alias("mean_length"))
    suppliers = table(spark, folder, "supplier")
    side = suppliers.select(F.col("s_suppkey").alias("matched_county_fips"), F.concat(F.lit("src"), F.col("s_nationkey") % 20).alias(
        "source")).join(texts, "source").drop("source")
    one = suppliers.where("s_acctbal > 0").agg(F.min("s_suppkey")).head()[0]
    found = results.score_detail(scores, one, features.drop("state"), side, key="s_suppkey")
    return found.select("s_suppkey", r("psi").alias("psi"), "rank", F.col("raw_features.returned").alias("returned"),
                        F.col("resistance_detail.posts").alias("posts"), F.col("resistance_detail.mean_length").alias("mean_length"))
