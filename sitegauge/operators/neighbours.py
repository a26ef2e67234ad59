"""Nearest rows of a table by keys that keep what is close together.

Space is cut into small cubes and the cubes are put in Z-order (the bits of their coordinates take turns), several times
with the grid moved.  Each time the rows are sorted along that order and cut into buckets of equally many rows; a row is
compared with the rows of its bucket that are at most ``window`` places away, and with as many of the buckets beside it.
As buckets are stretches of a sorted run, a dense place fills many of them and never one large one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.operators.ranking import with_sequence
from sitegauge.session import shuffle_width, stage

TURNS = 8
WINDOW = 48
BUCKET = 4096
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bits of a Z-order key.
BITS = 60


def z_order(places: Sequence[Column], bits: int) -> Column:
    """The bits of several whole numbers taking turns, highest first."""
    def add(key: Column, b: Column) -> Column:
        for place in places:
            bit = F.call_function("shiftright", place, b).bitwiseAND(F.lit(1).cast("long"))
            key = F.shiftleft(key, 1).bitwiseOR(bit)
        return key

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), add)


def nearest(points: DataFrame, columns: Sequence[str], k: int, key: str, group: str, turns: int = TURNS,
            window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """``key`` and ``near``: the keys of the ``k`` nearest rows of the same ``group``, nearest first, ties to the smaller key.

    ``key`` is a unique whole number.  Most of the nearest are found, not always all; a row of a group with at most
    ``window`` rows is compared with all of them.
    """
    columns = list(columns)
    bounds = points.agg(*[F.min(c).alias(f"low{j}") for j, c in enumerate(columns)],
                        *[F.max(c).alias(f"high{j}") for j, c in enumerate(columns)]).head()
    if bounds["low0"] is None:
        return points.select(key, F.array().cast("array<long>").alias("near")).limit(0)
    lows = [float(bounds[f"low{j}"]) for j in range(len(columns))]
    width = max(float(bounds[f"high{j}"]) - lows[j] for j in range(len(columns))) or 1.0
    bits = max(1, BITS // len(columns))

    # By how much of the width each turn moves the grid along each column.
    moves = [[(t * 0.754877666 ** (j + 1)) % 1.0 for t in range(turns)] for j in range(len(columns))]
    cells = [F.floor((F.col(c) - lows[j] + F.get(F.array(*[F.lit(m) for m in moves[j]]), F.col("_turn")) * width)
                     / (2 * width) * float((1 << bits) - 1)).cast("long").alias(f"_at{j}") for j, c in enumerate(columns)]
    laid = points.select(F.col(key).alias("_key"), F.col(group).alias("_group"), *columns,
                         F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("_turn")).select("*", *cells)
    laid = laid.withColumn("_z", z_order([F.col(f"_at{j}") for j in range(len(columns))], bits)).drop(
        *[f"_at{j}" for j in range(len(columns))])
    placed = with_sequence(laid, [F.asc(c) for c in ("_turn", "_group", "_z", "_key")], "_rank")
    rank = F.col("_rank") - 1
    spread = placed.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        *[F.floor((rank + move) / bucket).cast("long") for move in (-window, 0, window)]))))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        x, keys = rows[columns].to_numpy(float), rows["_key"].to_numpy()
        one = rows["_turn"].to_numpy() * 1_000_003 + rows["_group"].to_numpy()
        own = np.flatnonzero((rows["_rank"].to_numpy() - 1) // bucket == rows["_bucket"].iloc[0])
        n = len(rows)
        far = np.full((n, 2 * window), np.inf)
        for o in range(1, min(window, n - 1) + 1):
            d = ((x[o:] - x[:-o]) ** 2).sum(axis=1)
            d[one[o:] != one[:-o]] = np.inf
            far[:-o, window + o - 1] = d
            far[o:, window - o] = d
        moves = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
        far = far[own]
        others = keys[np.clip(own[:, None] + moves, 0, n - 1)]
        order = np.lexsort((others, far), axis=1)[:, :k]
        far, others = np.take_along_axis(far, order, 1), np.take_along_axis(others, order, 1)
        return pd.DataFrame({"_key": keys[own], "far": pd.Series(far.tolist(), dtype=object),
                             "near": pd.Series(others.tolist(), dtype=object)})

    found = spread.groupBy("_bucket").applyInPandas(search, "_key long, far array<double>, near array<long>")
    pairs = F.filter(F.arrays_zip("far", "near"), lambda p: p["far"] < float("inf"))
    # At most ``turns`` times ``k`` pairs of each row.
    best = found.groupBy("_key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k).alias("best"))
    return best.select(F.col("_key").alias(key), F.col("best.near").alias("near"))


def nearest_distances(points: DataFrame, columns: Sequence[str], k: int, block: int = 256) -> DataFrame:
    """Each different point and ``near``: its distances to the ``k`` nearest other rows, exactly, nearest first.

    Equal points are counted together.  The points are put in Z-order and cut into blocks; the own block bounds how far a
    point has to look, and it is compared with just those blocks whose box begins nearer.  A row is a pair of blocks, so a
    task never holds more than two blocks a row.
    """
    columns, c = list(columns), len(columns)
    # A row that goes to Python is two blocks long, so batches are bounded by bytes, unless the session has bounded them.
    if points.sparkSession.conf.get(BATCH_LIMIT, None) is None:
        points.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    different = stage(points.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "points")
    bounds = different.agg(*[F.min(name).alias(f"low{j}") for j, name in enumerate(columns)],
                           *[F.max(name).alias(f"high{j}") for j, name in enumerate(columns)]).head()
    bits = max(1, BITS // c)
    lows = [float(bounds[f"low{j}"] or 0.0) for j in range(c)]
    widths = [float(bounds[f"high{j}"] or 0.0) - lows[j] or 1.0 for j in range(c)]
    cells = [F.floor((F.col(name) - lows[j]) / widths[j] * float((1 << bits) - 1)).cast("long") for j, name in enumerate(columns)]
    placed = with_sequence(different.withColumn("_z", z_order(cells, bits)), [F.asc(x) for x in ("_z", *columns)], "_rank")
    rows = F.array_sort(F.collect_list(F.struct("_rank", F.array(*columns).alias("x"), "_n")))  # at most ``block``
    blocks = placed.groupBy(F.floor((F.col("_rank") - 1) / block).cast("long").alias("block")).agg(
        rows.alias("r"), F.array(*[F.min(x) for x in columns]).alias("low"), F.array(*[F.max(x) for x in columns]).alias("high"))

    def best(x, n, y, m, same: bool):
        """Squared distances of the k rows of ``y`` nearest to each of ``x``, infinite where there are fewer."""
        d = np.zeros((len(x), len(y)))
        for j in range(c):
            d += (x[:, j, None] - y[None, :, j]) ** 2
        counts = np.repeat(m[None, :], len(x), axis=0)
        if same:
            counts[np.arange(len(x)), np.arange(len(x))] -= 1
        order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        upto = np.cumsum(np.take_along_axis(counts, order, 1), axis=1)
        d = np.concatenate([np.take_along_axis(d, order, 1), np.full((len(x), 1), np.inf)], axis=1)
        return np.stack([d[np.arange(len(x)), (upto <= place).sum(axis=1)] for place in range(k)], axis=1)

    @F.pandas_udf("array<double>")
    def reach(xs: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(xs, ns):
            x = np.asarray(x, float).reshape(-1, c)
            out.append(best(x, n, x, np.asarray(n), True)[:, -1])
        return pd.Series(out)

    flat = blocks.select("block", "low", "high", F.flatten("r.x").alias("x"), F.col("r._n").alias("n"))
    flat = stage(flat.withColumn("far", reach("x", "n")), "blocks")
    boxes = flat.select("block", "low", "high", F.array_max("far").alias("most"))
    # Squared distance between two boxes; a hair is taken off for rounding.
    apart = F.aggregate(F.zip_with(
        F.zip_with("a.low", "b.high", lambda p, q: p - q), F.zip_with("b.low", "a.high", lambda p, q: p - q),
        lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda total, v: total + v * v) * (1 - 1e-9)
    met = boxes.alias("a").join(F.broadcast(boxes.alias("b")), apart <= F.col("a.most")).select(  # one row per block
        F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    other = flat.select(F.col("block").alias("other"), F.col("x").alias("y"), F.col("n").alias("m"))

    @F.pandas_udf("array<struct<at: int, near: array<double>>>")
    def compared(same: pd.Series, xs: pd.Series, ns: pd.Series, fars: pd.Series, ys: pd.Series, ms: pd.Series) -> pd.Series:
        out = []
        for one, x, n, far, y, m in zip(same, xs, ns, fars, ys, ms):
            x, y, m = np.asarray(x, float).reshape(-1, c), np.asarray(y, float).reshape(-1, c), np.asarray(m)
            away = np.maximum(np.maximum(y.min(axis=0) - x, x - y.max(axis=0)), 0.0)
            at = np.arange(len(x)) if one else np.flatnonzero((away ** 2).sum(axis=1) * (1 - 1e-9) <= np.asarray(far))
            found = best(x[at], n, y, m, bool(one)) if len(at) else []
            out.append([{"at": int(i), "near": f[np.isfinite(f)].tolist()} for i, f in zip(at, found)])
        return pd.Series(out)

    pairs = met.join(flat, "block").join(other, "other").repartition(shuffle_width(points.sparkSession), "block", "other")
    found = pairs.select("block", F.inline(compared(F.col("block") == F.col("other"), "x", "n", "far", "y", "m")))
    merged = found.groupBy("block", "at").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    where = placed.select(*columns, F.floor((F.col("_rank") - 1) / block).cast("long").alias("block"),
                          ((F.col("_rank") - 1) % block).cast("int").alias("at"))
    return where.join(merged, ["block", "at"]).select(*columns, F.transform("near", lambda d: F.sqrt(d)).alias("near"))
