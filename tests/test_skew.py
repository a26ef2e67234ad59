import pytest
from pyspark.sql import functions as F

from sitegauge.operators import joins, skew
from sitegauge.session import small_table, stage


@pytest.fixture()
def shuffled(spark):
    """Joins shuffle, and every shuffle partition stays a task of its own."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=40_000):
    """Half of the rows have one key, a tenth have none, a tenth another one; the others spread."""
    key = (F.when(F.col("id") % 10 < 5, F.lit("hot")).when(F.col("id") % 10 == 5, F.lit(None)).when(F.col("id") % 10 == 6, F.lit("warm"))
           .otherwise(F.concat(F.lit("k"), F.col("id") % 3000)))
    return spark.range(0, n, 1, 7).select("id", key.alias("k"))


def answers(spark):
    return spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).unionByName(
        small_table(spark, [("hot", -1), ("warm", -2), ("unmet", -3)], "k string, v long"))


def per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_no_task_has_twice_the_usual_rows(shuffled, how):
    rows, other = stage(hot_rows(shuffled)), stage(answers(shuffled))
    plain, even = rows.join(other, "k", how), skew.salted_join(rows, other, ["k"], how)
    assert even.columns == plain.columns
    assert even.exceptAll(plain).count() == plain.exceptAll(even).count() == 0
    before, after = per_task(plain), per_task(even)
    assert before[-1] > 5 * before[len(before) // 2]
    assert after[-1] <= 2 * after[len(after) // 2]


def test_exactly_the_hot_keys_are_salted(spark):
    rows = hot_rows(spark)
    found = skew.hot_keys(rows, ["k"], width=16)
    marks = {r.k: r.m for r in rows.select("k", F.xxhash64("k").alias("m")).distinct().collect()}
    assert set(found) == {marks["hot"], marks[None], marks["warm"]}
    assert found[marks["hot"]] == skew.GRAINS * 8
    assert skew.hot_keys(spark.range(1000).withColumnRenamed("id", "k"), ["k"], width=16) == {}
    assert skew.hot_keys(rows.limit(0), ["k"]) == {}


def test_several_keys_and_clashing_names(spark):
    rows = hot_rows(spark, 2000).select("id", "k", (F.col("id") % 2).alias("j"))
    other = answers(spark).withColumn("j", F.lit(0).cast("long"))
    got = skew.salted_join(rows, other, ["k", "j"], "left")
    assert got.exceptAll(rows.join(other, ["k", "j"], "left")).count() == 0 and got.count() == 2000


def test_many_to_one_with_a_hot_key(spark):
    left = hot_rows(spark, 2000).withColumn("v", F.lit(0))
    got = joins.inner_suffixed(left, answers(spark), "k")
    assert got.columns == ["k", "id", "v_x", "v_y"] and got.where("k = 'hot'").count() == 1000
    assert got.where("k IS NULL").count() == 0
