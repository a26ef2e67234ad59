"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and an exact cut by bisection.

All runs of one to three words are hashed into buckets.  A bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus; a document's weight is the sum of its features' gains, looked up in one array.  With noise drawn
from the document's id on top, the highest scores are a sample without replacement in which a document's odds are those of
its weight.

The cut is found without sorting: the persisted scores are counted against evenly spaced thresholds, the interval that
holds the wanted place is kept, and so on until it is one value; each job does five halvings at once.  Rows tied at the cut
are cut in the same way by id, and those of one id by row number.  Only the drawn rows are then range-partitioned and
numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.words import bound_batches, each_text, type_of, words_in
from sitegauge.operators.ranking import with_sequence
from sitegauge.session import stage

BUCKETS = 10_000
PERCENT = 5
MIN_WORDS = 20
SEED = 42
#: Thresholds counted per job.
PROBES = 31
#: Stands for a null id, so that it is the last of a tie.
LAST = (1 << 63) - 1


def buckets_of(text: bytes, buckets: int = BUCKETS):
    """Number of words, and the bucket of every run of 1 to 3 words.

    A checksum can be carried on, so that of a run starts from the one of the run that is a word shorter.
    """
    import numpy as np
    from zlib import crc32

    words = words_in(text)
    spaced = [b" " + w for w in words]
    sums = list(map(crc32, words))
    found = [np.array(sums, np.uint32)]
    for n in (1, 2):
        sums = list(map(crc32, spaced[n:], sums))
        found.append(np.array(sums, np.uint32))
    return len(words), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all texts: one row per bucket and task, added up."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in each_text(batch.column(0)):
                total += np.bincount(buckets_of(text, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counts = [0] * buckets
    found = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n bigint")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        counts[r.bucket] = r.n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket: floor of 1000 times the log ratio of its smoothed shares, in doubles."""
    more = float(len(corpus))
    s_all, t_all = sum(corpus) + more, sum(target) + more
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)]


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int, seed: int,
           keep: bool) -> DataFrame:
    """Staged (``row``, ``id``, ``n_words``, ``n_features``, ``weight``, ``score``) and, if asked for, ``kept``: all columns."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        by_bucket = np.array(gain, np.int64)
        for batch in batches:
            rows = []
            for text in each_text(batch.column(0)):
                n, found = buckets_of(text, buckets)
                rows.append((n, len(found), int(by_bucket[found].sum())))
            numbers = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *numbers], names=[
                *batch.schema.names[1:], "n_words", "n_features", "weight"])

    columns = [F.col(id_col).alias("id"), *([F.struct(*[F.col(c) for c in docs.columns]).alias("kept")] if keep else [])]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *columns)
    schema = ", ".join(f"{c} {type_of(rows, c)}" for c in rows.columns[1:])
    weighed = rows.mapInArrow(run, schema + ", n_words bigint, n_features bigint, weight bigint")
    return stage(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn(
        "row", F.monotonically_increasing_id()), "scores")


def value_at(rows: DataFrame, value: Column, place: int) -> tuple[int, int, int]:
    """The value at ``place`` (from 1) of the rising values, how many are smaller, and how many are equal.

    Every job counts the rows up to ``PROBES`` evenly spaced thresholds and keeps the interval that holds the place.
    """
    narrow = rows.select(value.alias("v"))
    low, high, below, upto = *narrow.agg(F.min("v"), F.max("v")).first(), 0, None
    while low < high:
        points = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)} | {low})
        counts = narrow.where(F.col("v").between(low, high)).agg(*[F.count_if(F.col("v") <= p) for p in points]).first()
        counts = [below + c for c in counts]
        at = next((i for i, c in enumerate(counts) if c >= place), None)
        if at is None:
            low, below = points[-1] + 1, counts[-1]
        else:
            high, upto = points[at], counts[at]
            if at:
                low, below = points[at - 1] + 1, counts[at - 1]
    return low, below, (narrow.where(F.col("v") <= low).count() if upto is None else upto) - below


def best(rows: DataFrame, k: int) -> Column:
    """Condition that holds for exactly the ``k`` best rows of ``rows``: highest score, then smallest id, then row."""
    if k <= 0:
        return F.lit(False)
    chosen, tied = F.lit(False), F.lit(True)
    for value in (-F.col("score"), F.coalesce(F.col("id").cast("long"), F.lit(LAST)), F.col("row")):
        at, below, equal = value_at(rows.where(tied), value, k)
        k -= below
        if k == equal:
            return chosen | (tied & (value <= at))
        chosen, tied = chosen | (tied & (value < at)), tied & (value == at)
    return chosen | tied


def drawn(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, percent: int, min_words: int,
          buckets: int, seed: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """The drawn rows with their ``rank``, and all others."""
    rows = scored(docs, target, id_col, text_col, target_col, buckets, seed, keep)
    enough = F.col("n_words") >= min_words
    able = rows.where(enough)
    chosen = enough & best(able, able.count() * percent // 100)
    return (with_sequence(rows.where(chosen), [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]),
            rows.where(~chosen))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row's id, ``n_features``, ``weight``, ``score`` and ``rank`` (null where it isn't drawn).

    ``percent`` of the rows with ``min_words`` words or more are drawn, highest scores first.  Ids are whole numbers; equal
    scores go to the smaller id, a null one (drawn with the noise of an empty id) last, and rows repeated with one id take
    places next to each other.  A null or empty text has no features and weighs nothing; an empty target makes all gains
    those of the smoothing.  An empty table gives an empty result.  Other columns are left out.
    """
    first, rest = drawn(docs, target, id_col, text_col, target_col, percent, min_words, buckets, seed, False)
    columns = ["id", "n_features", "weight", "score"]
    return first.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank"))).toDF(
        id_col, *columns[1:], "rank")


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
           percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, as ``document``, under their ``rank``; see ``resample``."""
    first, _ = drawn(docs, target, id_col, text_col, target_col, percent, min_words, buckets, seed, True)
    return first.select("rank", F.col("kept").alias("document"))
