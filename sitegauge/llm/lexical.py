"""Ranked lexical search through hashed max-sketches.

A term's impact in a document is its weight times its saturated frequency.  Terms are hashed to the coordinates of a small
sketch, and of the impacts that meet in one coordinate a document keeps the largest.  A query looks its terms up in the
sketch; what it finds adds up to at least the document's score.  Lookups of many queries in many sketches are one product
of matrices.

Two jobs read the sketches.  The first scores, exactly, the documents with the highest bounds of each task; the k-th best
score of a query among them is its threshold.  The second goes through the documents in descending order of their bounds
and scores them exactly until a bound is below the threshold, which rises with what is found.  No document that could be
among the k best is left out.

Queries go through in blocks.  Terms that no query of a block asks for add to no score, so sketches don't hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from sitegauge.llm.words import bound_batches, each_text, type_of, words_in
from sitegauge.operators.ranking import with_sequence
from sitegauge.session import stage

TOP = 10
#: Coordinates of a sketch.
WIDTH = 512
#: Queries that travel with the tasks of one pass.
BLOCK = 1024
#: Bounds formed at a time.
CELLS = 1 << 20
#: Groups in which a query's rows are ranked before they meet.
SPLITS = 64


def profiles(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``n``, ``terms``, ``tfs``): all terms of a document counted, and the asked ones by number with their counts."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np

        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in each_text(batch.column(0)):
                words = words_in(text)
                have = Counter(filter(number.__contains__, words))
                sizes.append(len(words))
                found.append(np.fromiter(map(number.__getitem__, have), np.int32, len(have)))
                counts.append(np.fromiter(have.values(), np.int32, len(have)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    return rows.mapInArrow(run, f"id {type_of(rows, 'id')}, n bigint, terms array<int>, tfs array<int>")


def coordinates(terms: list[bytes], width: int) -> list[int]:
    from zlib import crc32

    return [crc32(t) % width for t in terms]


def impacts_of(batch, weight, n_docs: int, n_terms: int):
    """Flat term numbers and impacts of a batch of profiles, and where each document's begin."""
    import numpy as np

    offsets = batch.column("terms").offsets.to_numpy()
    terms = batch.column("terms").values.to_numpy()[offsets[0] : offsets[-1]]
    tfs = batch.column("tfs").values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    sizes = np.diff(offsets)
    m = 100 - 90 + 90 * batch.column("n").to_numpy() * n_docs // n_terms
    # All are positive, so rounding down is what // does.
    return terms, weight[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes))), offsets - offsets[0]


def sketches(found: DataFrame, terms: list[bytes], weight: list[int], n_docs: int, n_terms: int, unit: int, width: int) -> DataFrame:
    """The profiles with ``sketch``: ``width`` unsigned 16-bit maxima of impacts in units of ``unit``, rounded up."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        of_term, at = np.array(weight, np.int64), np.array(coordinates(terms, width), np.int64)
        for batch in batches:
            asked, impact, offsets = impacts_of(batch, of_term, n_docs, n_terms)
            table = np.zeros((batch.num_rows, width), np.uint16)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            np.maximum.at(table, (rows, at[asked]), (-(-impact // unit)).astype(np.uint16))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.tobytes() for t in table], pa.binary())],
                                             names=[*batch.schema.names, "sketch"])

    schema = ", ".join(f"{c} {type_of(found, c)}" for c in found.columns)
    return found.mapInArrow(run, schema + ", sketch binary")


class Best:
    """The k best (score, id) of a query: high scores first, then small ids, a null id last."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, least, []

    @property
    def bar(self) -> int:
        """What a bound must reach."""
        return max(self.least, -self.rows[-1][0]) if len(self.rows) == self.k else self.least

    def add(self, score: int, id_) -> None:
        from bisect import insort

        if score >= self.bar:
            insort(self.rows, (-score, id_ is None, 0 if id_ is None else id_))
            del self.rows[self.k :]


def search_sketches(index: DataFrame, asked: list[list[int]], terms: list[bytes], weight: list[int], n_docs: int, n_terms: int,
                    unit: int, width: int, k: int, least: list[int] | None) -> DataFrame:
    """(``query``, ``id``, ``score``): each task's k best of every query.

    Without ``least`` only the documents with the k highest bounds per batch are scored; with it, all whose bound reaches
    their query's ``least`` and its rising threshold.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        of_term, at = np.array(weight, np.int64), np.array(coordinates(terms, width), np.int64)
        lookup = np.zeros((width, len(asked)), np.float64)
        for q, ts in enumerate(asked):
            np.add.at(lookup, (at[ts], q), 1.0)
        best = [Best(k, 1 if least is None else least[q]) for q in range(len(asked))]
        wanted = np.zeros(len(terms), bool)
        step = max(k, CELLS // max(1, len(asked)))
        id_type = None
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                id_type = batch.column("id").type
                found, impact, offsets = impacts_of(batch, of_term, n_docs, n_terms)
                ids = batch.column("id")
                table = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, width)
                # Whole numbers below 2^53, so the product is exact.
                bounds = (table.astype(np.float64) @ lookup) * unit
                for q, ts in enumerate(asked):
                    column, own = bounds[:, q], best[q]
                    if least is None and len(column) > k:
                        some = np.argpartition(column, len(column) - k)[-k:]
                        some = some[column[some] >= own.bar]
                    else:
                        some = np.flatnonzero(column >= own.bar)
                    if not len(some):
                        continue
                    some = some[np.argsort(-column[some], kind="stable")]
                    wanted[ts] = True
                    for first in range(0, len(some), 4 * k):
                        group = some[first : first + 4 * k]
                        if column[group[0]] < own.bar:
                            break
                        sizes = offsets[group + 1] - offsets[group]
                        places = np.repeat(offsets[group] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                        sums = np.zeros(len(group), np.int64)
                        np.add.at(sums, np.repeat(np.arange(len(group)), sizes),
                                  np.where(wanted[found[places]], impact[places], 0))
                        for row, score in zip(group[sums >= own.bar].tolist(), sums[sums >= own.bar].tolist()):
                            own.add(score, ids[row].as_py())
                    wanted[ts] = False
        rows = [(q, None if null else id_, -score) for q, b in enumerate(best) for score, null, id_ in b.rows]
        if rows:
            query, id_, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(id_, id_type), pa.array(score, pa.int64())],
                                             names=["query", "id", "score"])

    return index.mapInArrow(run, f"query int, id {type_of(index, 'id')}, score bigint")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their ``rank``; no task holds more than a share of a query's rows and k per group."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    split = rows.withColumn("split", F.pmod(F.xxhash64("id", "score"), F.lit(SPLITS)))
    some = split.withColumn("nth", F.row_number().over(Window.partitionBy("query", "split").orderBy(*order))).where(F.col("nth") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select(
        "query", "rank", "id", "score")


def search_block(docs: DataFrame, texts: list[str | None], id_col: str, text_col: str, k: int, width: int) -> DataFrame | None:
    """(``query``, ``rank``, ``id``, ``score``) for the queries of one block, numbered from 0; None if nothing is found."""
    bags = [set(words_in((t or "").encode("utf-8", "replace"))) for t in texts]
    terms = sorted(set().union(*bags))
    number = {t: i for i, t in enumerate(terms)}
    asked = [sorted(number[t] for t in bag) for bag in bags]
    found = stage(profiles(docs, terms, id_col, text_col), "profiles")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.term: r.df for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).collect()}  # at most the block's terms
    if not df:
        return None
    weight = [math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df.get(i, 0) + 1.0))) for i in range(len(terms))]
    unit = max(weight) * 1_000_000 // 65_535 + 1  # a saturated frequency is below a million
    index = stage(sketches(found.where(F.size("terms") > 0), terms, weight, n_docs, n_terms, unit, width), "sketches")
    search = lambda least: top(search_sketches(
        index, asked, terms, weight, n_docs, n_terms, unit, width, k, least), k)
    least = [1] * len(asked)
    for r in search(None).where(F.col("rank") == k).select("query", "score").collect():  # one row per query of the block
        least[r["query"]] = r.score
    return search(least)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id",
           query_text_col: str = "text", k: int = TOP, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each query: its id, ``rank``, the document's id, ``score``.

    Equal scores go to the smaller id, a null id last; each row of ``docs`` is a document and each row of ``queries`` a
    query, also where ids are repeated or null.  Null and empty texts have no terms: such a document is never found, such a
    query finds nothing.  An empty table on either side gives an empty result.  Other columns are left out.
    """
    bound_batches(docs.sparkSession)
    asked = with_sequence(queries.select(F.col(query_id_col).alias("item"), F.col(query_text_col).cast("string").alias("text")),
                          [F.asc("item"), F.asc("text")], "number")
    parts = []
    for first in range(1, asked.count() + 1, block):
        now = asked.where(F.col("number").between(first, first + block - 1))
        texts = [r.text for r in now.orderBy("number").select("text").collect()]  # one block of queries
        hits = search_block(docs, texts, id_col, text_col, k, width)
        if hits is not None:
            parts.append(stage(hits.withColumn("number", F.col("query") + first), "hits"))
    schema = f"`{query_id_col}` {type_of(queries, query_id_col)}, rank int, `{id_col}` {type_of(docs, id_col)}, score bigint"
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.join(asked.select("number", "item"), "number").select("item", "rank", "id", "score").toDF(
        query_id_col, "rank", id_col, "score")
