"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a shuffled (hashed) order and read as one stream of words, around and around, cut
into blocks of equally many words.  Slot j of the schedule sits at the j-th point of the golden-ratio sequence; the
cumulative target weights map it to a source, and the slot's rank among that source's slots names the block it takes.
The sequence fills every stretch of the unit interval evenly, so any run of slots mixes the sources to their weights.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitegauge.llm.words import new_name
from sitegauge.session import stage

#: Fractional part of the golden ratio, as a decimal, so that far points of the sequence are as exact as near ones.
GOLDEN = Decimal("0.618033988749894848")
BLOCK_WORDS = 128
MAX_REPEATS = 3
#: Slots numbered together, and documents ordered together: neither grows with the input.
RUN = 4096


def word_count(text: Column) -> Column:
    """Number of words parted by the six ASCII spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_weight(place: Column) -> Column:
    """Weights 1, 2, 3, repeating, for places counted from 0."""
    return (place % 3 + 1).cast("double")


def targets(sources: DataFrame, weight=default_weight) -> DataFrame:
    """Adds ``place`` (sources by code point, null last), ``target`` (words, double) and ``quota`` (whole words).

    ``sources`` has one row per source: ``source``, ``source_size``.  Shares of the whole size go by weight; a source
    gets at most ``MAX_REPEATS`` times its size and the excess is shared again by weight until none is above.  Ordered
    by size per weight the stopped sources come first, so one pass over running totals finds them all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1)
    placed = placed.withColumn("weight", weight(F.col("place"))).withColumn("cap", MAX_REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = placed.withColumn("rate", left / weights_left)
    # A source is stopped if its share, once all before it are stopped, is above its cap.
    rated = rated.withColumn("stopped", F.col("cap") < F.col("rate") * F.col("weight"))
    n_stopped = F.sum(F.col("stopped").cast("int")).over(whole)
    stopped_words = F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(whole)
    free_weight = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(whole)
    total = F.sum("source_size").over(whole)
    final = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        F.when(free_weight > 0, (total - stopped_words) * F.col("weight") / free_weight).otherwise(0.0))
    return rated.withColumn("target", final).withColumn(
        "quota", F.least(F.round("target").cast("long"), F.col("cap"))).withColumn("_n", n_stopped).drop(
        "rate", "stopped", "weight", "_n").withColumn("upto", F.sum("quota").over(Window.orderBy("place")))


def schedule(shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots (``slot``, ``place``, ``rank``) of the mix: one per block, each source's blocks in the order of ``rank``.

    As many golden-ratio points as there are blocks are mapped through the cumulative quotas; the points of a source
    beyond its quota are left out and the few that it lacks (their number grows with the logarithm of the slots) come
    last.
    """
    spark = shares.sparkSession
    parts = shares.select("place", "upto", F.col("quota"), F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    totals = parts.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("upto"), F.lit(0))).first()
    n, words = int(totals[0]), int(totals[1])
    if n == 0:
        return spark.createDataFrame([], "slot bigint, place int, rank bigint")
    edges = parts.where("blocks > 0").select(
        "place", "blocks", ((F.col("upto") - F.col("quota")) / F.lit(words)).alias("from"), (F.col("upto") / F.lit(words)).alias("to"))
    point = F.col("slot").cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(18,18)")
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn(
        "point", (point - F.floor(point)).cast("double"))
    # A point's cell holds the few sources whose stretch meets it, so the join is on equal cells.
    cells = 1024
    wide = edges.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("from") * cells).cast("int"), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1)).cast("int"))))
    hits = points.withColumn("cell", F.floor(F.col("point") * cells).cast("int")).join(wide, "cell").where(
        "point >= `from` AND point < `to`").select("slot", "place", "blocks")
    hits = hits.withColumn("run", F.floor(F.col("slot") / RUN))
    counted = hits.groupBy("place", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_run = Window.partitionBy("place", "run").orderBy("slot")
    ranked = hits.withColumn("in_run", F.row_number().over(in_run) - 1).join(starts, ["place", "run"]).withColumn(
        "rank", F.col("start") + F.col("in_run")).where("rank < blocks").select("slot", "place", "rank")
    have = counted.groupBy("place").agg(F.sum("n").alias("have"))
    lacking = edges.join(have, "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks").select(
        "place", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(lacking.select(F.lit(n).cast("bigint").alias("slot"), "place", "rank"))


def streams(sized: DataFrame) -> DataFrame:
    """Adds ``begin``: the words before a document in its source's shuffled stream.

    Documents of a source are ordered by the MD5 of their id; runs of neighbouring hashes are summed first, so that no
    task orders a whole source.
    """
    n = max(1, -(-sized.count() // RUN))
    keyed = sized.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn(
        "run", F.floor(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / 16.0 ** 13 * n))
    totals = keyed.groupBy("place", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy("place", "run").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, ["place", "run"]).withColumn("begin", F.col("start") + F.col("inside")).drop(
        "key", "run", "start", "inside")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight=default_weight, block_words: int = BLOCK_WORDS, mark: Column | None = None) -> DataFrame:
    """What the mix takes of every row: id, ``size``, ``source_size``, ``target`` (of its source) and ``taken``, and
    ``mark``, if one is given, by which a caller knows the row again.

    A null text has size 0; a null source is a source of its own, the last; null ids and repeated rows are rows like
    any other; an empty table gives an empty result.  Each source's taken words are its target, rounded; a row gives
    its words at most ``MAX_REPEATS`` times.  Other columns are left out.
    """
    more = [] if mark is None else [mark.alias("mark")]
    narrow = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"),
                               *more), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = stage(targets(sources, weight), "shares")
    placed = narrow.join(shares.select("source", "place"), narrow["source"].eqNullSafe(shares["source"])).select(
        "id", "size", "place", *["mark"] * len(more))
    laid = stage(streams(placed).join(shares.select("place", "source_size", "quota", "target"), "place"), "streams")
    slots = schedule(shares, block_words)
    # Where the document lies in each round of the stream, as far as the quota goes, and which blocks it meets there.
    rounds = laid.where("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("round")).withColumn(
        "low", F.col("begin") + F.col("round") * F.col("source_size")).withColumn(
        "high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("low < high")
    met = rounds.select("id", "size", "place", "begin", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))).alias("rank"))
    parts = met.join(slots.select("place", "rank"), ["place", "rank"]).withColumn(
        "words", F.least("high", (F.col("rank") + 1) * block_words) - F.greatest("low", F.col("rank") * block_words))
    # Within a source a document is known by where it begins, as no two with words begin at one place.
    taken = parts.groupBy("place", "begin").agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(taken, ["place", "begin"], "left")
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *["mark"] * len(more)]
    return some.select(columns).unionByName(none.select(columns)).withColumnRenamed("id", id_col)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weight=default_weight) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes its words, rounded to whole rows; all columns stay, whatever
    their names.

    Rows that the mix leaves out, among them rows without words, go.  Only rows of one id, source and text, which are
    copies of each other, share what is taken of them.
    """
    mark = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text"))
    of, times = new_name(docs, "mark"), new_name(docs, "times")
    taken = mix(docs, id_col, text_col, source_col, weight, mark=mark).groupBy(F.col("mark").alias(of)).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(times)).where(F.col(times) > 0)
    rows = docs.join(taken.hint("shuffle_hash"), mark == F.col(of))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(new_name(docs, "time"))).select(*docs.columns)
