"""Nearest vectors by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then routed to its leaf.  A query walks the tree best bin first: a
priority queue holds the seen but unvisited nodes by the inner product with their centre, the best is taken, its
children are pushed, and leaves come out in the order in which they promise most.  How many leaves are visited is
calibrated: some rows are compared with every row, and visits are widened until the wanted share of their true
neighbours lies in the visited leaves.  The walk goes on past that while the visited leaves hold fewer candidates than
are asked for.  Visited leaves are joined to queries in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from sitegauge.session import stage

#: Rows from which the tree is fitted, rows on which the visits are calibrated, and the recall they must reach.
FIT_ROWS, CALIBRATION_ROWS, RECALL = 20_000, 128, 0.95
LEAF_ROWS, FAN, LEAST_FIT_ROWS = 256, 16, 4
#: Rows and queries that meet in one block.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048
#: Parts in which a query's lists are cut before they meet.
SPLITS = 16


@dataclass
class Tree:
    """Centres of each inner node's children; a child is an inner node (>= 0) or leaf number -1 - n."""

    centres: list = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    n_leaves: int = 0

    def route(self, x):
        """Leaf of every row of a matrix: the nearest centre at each level."""
        import numpy as np

        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            c = self.centres[node]
            near = np.argmax(x[rows] @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            for i, child in enumerate(self.children[node]):
                part = rows[near == i]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def best_first(self, q) -> Iterator[int]:
        """Leaves in the order of the best-bin-first walk."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for score, child in zip(self.centres[node] @ q, self.children[node]):
                heapq.heappush(queue, (-float(score), child))


def fit_tree(x, n_leaves: int, fan: int = FAN, rounds: int = 8) -> Tree:
    """Split the sample again and again by k-means into about ``n_leaves`` leaves."""
    import numpy as np

    rng = np.random.default_rng(0)
    tree = Tree()

    def kmeans(rows, k: int):
        centres = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            near = np.argmax(rows @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
            held = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        centres = np.unique(centres, axis=0)
        return centres, np.argmax(rows @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)

    def grow(rows, share: int) -> int:
        k = min(fan, share, len(rows) // LEAST_FIT_ROWS)
        if k >= 2:
            centres, near = kmeans(rows, k)
            if len(centres) >= 2:
                node = len(tree.centres)
                tree.centres.append(centres)
                tree.children.append([])
                for i in range(len(centres)):
                    part = rows[near == i]
                    tree.children[node].append(grow(part, round(share * len(part) / len(rows))))
                return node
        tree.n_leaves += 1
        return -tree.n_leaves

    grow(x, n_leaves)
    return tree


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``v`` as doubles) of the rows that take part: with an id, of the commonest length (the longer of equally
    common ones), finite and not zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine.alias("fine"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def matrix(column):
    """Rows of an Arrow list column as a matrix of doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def calibrated_visits(routed: DataFrame, tree: Tree, n_rows: int, k: int, recall: float = RECALL,
                      sample: int = CALIBRATION_ROWS) -> int:
    """How many leaves a query must visit, by comparing ``sample`` different vectors with every row, in blocks."""
    import numpy as np
    import pyarrow as pa

    # Different vectors of the smallest hashes: as many whatever the size, and copies of one vector count once.
    h = F.xxhash64(F.lit("calibrate"), "v")
    different = routed.agg(F.approx_count_distinct(h)).first()[0]
    share = min(1.0, 16 * sample / max(1, different))
    few = routed.where(F.pmod(h, F.lit(1_000_000_000)) < int(share * 1_000_000_000)).groupBy("v").agg(F.min("id").alias("id"))
    asked = [(r.id, list(r.v)) for r in few.orderBy(h, "v").select("id", "v").limit(sample).collect()]
    queries = np.array([v for _, v in asked])
    ids = np.array([i for i, _ in asked])

    def compare(batches: Iterator) -> Iterator:
        best_s = np.full((len(ids), k), -np.inf)
        best_leaf = np.zeros((len(ids), k), np.int64)
        for batch in batches:
            x, own = matrix(batch.column(1)), batch.column(0).to_numpy()
            for at in range(0, len(x), 4096):
                scores = queries @ x[at : at + 4096].T
                scores[ids[:, None] == own[None, at : at + 4096]] = -np.inf
                leaves = np.broadcast_to(batch.column(2).to_numpy()[at : at + 4096], scores.shape)
                s, leaf = np.hstack([best_s, scores]), np.hstack([best_leaf, leaves])
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_leaf = np.take_along_axis(s, top, 1), np.take_along_axis(leaf, top, 1)
        q, j = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_pydict({"q": q, "s": best_s[q, j], "leaf": best_leaf[q, j]})

    found = routed.select("id", "v", "leaf").mapInArrow(compare, "q bigint, s double, leaf bigint")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("n") <= k)
    places = [{leaf: i for i, leaf in enumerate(tree.best_first(q))} for q in queries]
    needed = sorted(places[r.q][r.leaf] + 1 for r in top.select("q", "leaf").collect())
    if not needed:
        return 1
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
            recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(``query_id``, ``rank``, id, ``score``): the ``k`` nearest rows found of every row whose id is divisible by ``every``.

    Rows with a null id, or a vector that is null, zero, of an odd length or holds null or non-finite parts take no part.
    Repeated rows are candidates each; a query id is asked once, with the smallest of its vectors, and rows of its id
    are not its candidates.  Ties go to the smaller id.  With fewer candidates all are returned; an empty table gives
    an empty result.  Other columns are left out.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rows = stage(usable(table, id_col, vector_col), "vectors")
    n = rows.count()
    # A hash picks about fit_rows rows at any size of the table; the slack keeps small tables whole.
    share = min(1.0, fit_rows / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = np.array([list(r.v) for r in picked.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()])
    tree = fit_tree(sample, max(1, round(n / LEAF_ROWS))) if len(sample) else Tree(n_leaves=1)

    def route(batches: Iterator) -> Iterator:
        for batch in batches:
            leaves = tree.route(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], names=["id", "v", "leaf"])

    routed = stage(rows.mapInArrow(route, "id bigint, v array<double>, leaf bigint"), "leaves")
    visits = calibrated_visits(routed, tree, n, k, recall)

    # A leaf with many rows, such as copies of one vector, is dealt over blocks.
    blocks = stage(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).withColumn(
        "blocks", F.ceil(F.col("held") / BLOCK_ROWS).cast("int")), "leaf-blocks")
    # One figure per leaf of the tree, which fit_rows bounds.
    held = np.zeros(max(1, tree.n_leaves), np.int64)
    for r in blocks.select("leaf", "held").collect():
        held[r.leaf] = r.held

    def walk(batches: Iterator) -> Iterator:
        for batch in batches:
            leaves = []
            for q, own in zip(matrix(batch.column(1)), batch.column(2).to_pylist()):
                mine = {o["leaf"]: o["n"] for o in own}
                opened, others = [], 0
                for leaf in tree.best_first(q):
                    if len(opened) >= visits and others >= k:
                        break
                    opened.append(leaf)
                    others += int(held[leaf]) - mine.get(leaf, 0)
                leaves.append(opened)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(leaves, pa.list_(pa.int64()))], names=["id", "v", "leaves"])

    # Rows of a query's own id, by leaf: they are no candidates.
    queries = routed.where(F.col("id") % every == 0).groupBy("id", "leaf").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"), F.collect_list(F.struct("leaf", "n")).alias("own"))
    walked = stage(stage(queries, "queries").mapInArrow(walk, "id bigint, v array<double>, leaves array<bigint>"), "walks")
    # A leaf's rows go out once per slice of the queries that visit it, and not at all where none does.
    visited = walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("slices"))
    cells = stage(blocks.join(visited, "leaf").select("leaf", "blocks", "slices"), "cells")
    base = routed.join(cells, "leaf").select(
        "id", "v", "leaf", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    asked = walked.select("id", "v", F.explode("leaves").alias("leaf")).join(cells, "leaf").select(
        "id", "v", "leaf", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "found": pd.Series([], dtype=object)})
        b = b.sort_values("id", kind="stable")
        own, x, y = b["id"].to_numpy(), np.stack(b["v"].to_numpy()), np.stack(q["v"].to_numpy())
        found = []
        for at in range(0, len(y), 256):
            # einsum adds every pair's products in the same order, so equal vectors have equal scores.
            scores = np.einsum("qd,bd->qb", y[at : at + 256], x)
            scores[q["id"].to_numpy()[at : at + 256, None] == own[None, :]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            for s, o in zip(scores, order):
                found.append([{"far": -s[j], "id": own[j]} for j in o if s[j] > -np.inf])
        return pd.DataFrame({"id": q["id"].to_numpy(), "found": found})

    cell = ["leaf", "block", "slice"]
    parts = asked.groupBy(cell).cogroup(base.groupBy(cell)).applyInPandas(
        best, "id bigint, found array<struct<far:double,id:bigint>>")
    # Cut to k within parts of a query's cells before all of them meet.
    best_of = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    split = parts.withColumn("split", F.pmod(F.xxhash64("found"), F.lit(SPLITS)))
    merged = split.groupBy("id", "split").agg(best_of).groupBy(F.col("id").alias("query_id")).agg(best_of)
    return merged.select("query_id", F.posexplode("found").alias("pos", "f")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("f.id").alias(id_col), (-F.col("f.far")).alias("score"))
