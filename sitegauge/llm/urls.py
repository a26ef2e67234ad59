"""URL rules by a sort-merge range join on reversed hosts.

A host's labels in reverse order, each closed by a full stop, make a key in which every subdomain's key begins with its
parent's.  A rule therefore covers an interval of keys, and the intervals of rules nest or are apart.  Rules and urls
are sorted together by key; a sweep keeps the stack of rules whose interval is open.  As a url's open rules are the
nearest rule before it and that rule's own ancestors, cut to those whose key begins the url's, the stack travels as
one column: every rule carries its chain of ancestors, and the sweep hands on the last chain seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sitegauge.session import small_table, stage

# The given rules, as verdict and host with path.
GIVEN_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts that the method blocks by itself where no given rule fits.
UNWANTED_HOSTS = ("casino-win.example.com", "free-bets.example.com", "ads-track.example.com", "spam-farm.example.com")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``a.example.com`` as ``com.example.a.``; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(``rule``, ``verdict``) from pairs of verdict and host with path."""
    return small_table(spark, [(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def rule_chains(rules: DataFrame) -> DataFrame:
    """(``key``, ``chain``): for each rule host its own rules and those of all hosts above it, as structs."""
    parts = rules.select("rule", "verdict", reversed_key(F.lower(F.substring_index("rule", "/", 1))).alias("key"),
                         F.expr("substring(rule, instr(rule, '/'))").alias("rule_path")).where("instr(rule, '/') > 0 AND key <> ''")
    hosts = parts.groupBy("key").agg(F.collect_set(F.struct("rule", "verdict", "rule_path", "key")).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(
        F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("up"))
    return above.join(hosts.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("chain"))


def open_rules(pages: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, ``host``, ``path``, ``stack``): the rules whose host fits, for every page.

    ``pages`` has the id, ``host`` and ``path``.  The sorted run is cut by key and id, so that a host with many pages
    spreads over partitions; what is open where a partition begins follows from the last rule of those before it.
    """
    spark = pages.sparkSession
    chains = rule_chains(rules)
    events = pages.select(id_col, "host", "path", reversed_key(F.col("host")).alias("key")).withColumn("is_page", F.lit(1))
    both = events.unionByName(chains.withColumn("is_page", F.lit(0)), allowMissingColumns=True)
    # Pages of one key may lie in any order; a hash of the whole row lets the cut fall inside a key.
    both = both.withColumn("spread", F.when(F.col("is_page") == 1, F.xxhash64(id_col, "host", "path")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(both.repartitionByRange(parts, "key", "is_page", "spread").withColumn("part", F.spark_partition_id()), "url-sweep")
    sweep = Window.partitionBy("part").orderBy("key", "is_page", "spread")
    swept = cut.withColumn("last_chain", F.last("chain", ignorenulls=True).over(
        sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # One row per partition: the last chain inside it, then the last one before it.
    ends = cut.where("is_page = 0").groupBy("part").agg(F.max_by("chain", "key").alias("end_chain"))
    every = cut.select("part").distinct().join(ends, "part", "left")
    earlier = every.select("part", F.last("end_chain", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    full = swept.where("is_page = 1").join(F.broadcast(earlier), "part", "left")
    stack = F.filter(F.coalesce("last_chain", "before"), lambda r: F.startswith(F.col("key"), r["key"]))
    return full.select(id_col, "host", "path", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
          unwanted: Sequence[str] = UNWANTED_HOSTS) -> DataFrame:
    """(id, ``host``, ``path``, ``rule``, ``verdict``) for every page.

    A rule (``rule``: host with path, ``verdict``) fits its host and all subdomains if the url's path starts with its
    path; the longest wins, of equal ones the longer host.  Without a fitting rule ``rule`` is null, and the method
    blocks unwanted hosts and allows the rest.  A null url or one without ``://`` has an empty host and path, which no
    rule fits.  Repeated rows and null ids stay; an empty table, or no rules, gives no rules found.  Other columns are
    left out.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, GIVEN_RULES) if rules is None else rules.select("rule", "verdict")
    method = rule_table(spark, [("block", f"{host}/") for host in unwanted])
    both = rules.select("rule", "verdict").withColumn("given", F.lit(True)).unionByName(
        method.withColumn("given", F.lit(False)))
    marked = both.select(F.col("rule"), F.concat_ws(":", F.when(F.col("given"), "given").otherwise("method"), "verdict").alias("verdict"))
    split = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = open_rules(split, marked, id_col)
    given = F.filter("stack", lambda r: F.startswith(r["verdict"], F.lit("given:")) & F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(F.transform(given, lambda r: F.struct(
        F.length(r["rule"]).alias("n"), F.length(r["key"]).alias("k"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    own = F.exists(F.coalesce("stack", F.array().cast("array<struct<rule:string,verdict:string,rule_path:string,key:string>>")),
                   lambda r: r["verdict"] == "method:block")
    return found.withColumn("best", best).select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.substring_index("best.verdict", ":", -1), F.when(own, "block").otherwise("allow")).alias("verdict"))
