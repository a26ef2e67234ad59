"""How well scores agree with known outcomes, and how stable the ranking is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import significance
from sitegauge.functions.scalars import stability, viable
from sitegauge.operators.composite import Dimensions, dimension_scores, weighted_score
from sitegauge.operators.joins import inner_suffixed
from sitegauge.operators.ranking import (
    average_rank, hot_safe_join, quantiles, value_ranges, with_preceding, with_range,
)
from sitegauge.session import small_table, stage
from sitegauge.sources.fixed_values import (
    DIMENSIONS, FALLBACK_WEIGHTS, INVERTED_FEATURES, WEIGHT_SCENARIOS,
)

#: Points that a task holds at a time when discordant pairs are counted.
BLOCK_POINTS = 1 << 17


def match_outcomes(labels: DataFrame, scores: DataFrame, key: str = "county_fips") -> DataFrame:
    """Every labelled row with its location's score; a location may carry several labels."""
    return inner_suffixed(labels, scores, key)


# ---------------------------------------------------------------- classification

def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts for all four label and prediction combinations, empty ones as zero."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    wide = df.agg(*[
        F.count_if((F.col(label) == a) & (F.col(predicted) == p)).alias(f"c{a}{p}")
        for a, p in cells])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a, p in cells])))


def classification_report(
    df: DataFrame, label: str, predicted: str, by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means and accuracy.

    Undefined ratios are zero.  One aggregate row (per group) feeds the whole report.
    """
    wide = df.groupBy(*by).agg(*[
        F.count_if((F.col(label) == a) & (F.col(predicted) == p)).cast("double").alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    c = {k: F.col(k) for k in ("c00", "c01", "c10", "c11")}
    total = c["c00"] + c["c01"] + c["c10"] + c["c11"]
    per_class = {}
    for k, hit, miss, false in (("0", "c00", "c01", "c10"), ("1", "c11", "c10", "c01")):
        precision = ratio(c[hit], c[hit] + c[false])
        recall = ratio(c[hit], c[hit] + c[miss])
        per_class[k] = (precision, recall, ratio(2 * precision * recall, precision + recall),
                        c[hit] + c[miss])
    accuracy = ratio(c["c00"] + c["c11"], total)
    rows = {
        "0": per_class["0"], "1": per_class["1"],
        "accuracy": (accuracy, accuracy, accuracy, total),
        "macro avg": tuple((per_class["0"][i] + per_class["1"][i]) / 2 for i in range(3)) + (total,),
        "weighted avg": tuple(
            ratio(per_class["0"][i] * per_class["0"][3] + per_class["1"][i] * per_class["1"][3],
                  total) for i in range(3)) + (total,),
    }
    return wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), r[0].alias("precision"), r[1].alias("recall"),
                 r[2].alias("f1"), r[3].cast("long").alias("support"))
        for name, r in rows.items()])))


# ------------------------------------------------------------------ rank statistics

def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, with how many of each score lower.

    Columns: score, pos, neg, pos_before, neg_before, pos_total, neg_total.
    """
    # Ranges and counts both read it; written once, whatever joins stand behind it.
    known = stage(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(score, label), "scored")
    ranges = value_ranges(known, [score])
    counts = known.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranges.splits["score"] = ranges.splits[score]
    return with_preceding(with_range(counts, "score", ranges), "score", ["pos", "neg"]).drop("_range")


def u_statistic(table: DataFrame) -> DataFrame:
    """U of the positives, AUC, group sizes and the tie sum, as one row."""
    t = (F.col("pos") + F.col("neg")).cast("double")
    wins = F.col("pos").cast("double") * F.col("neg_before") + 0.5 * F.col("pos") * F.col("neg")
    sums = table.agg(
        F.sum(wins).alias("u"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.sum(t * t * t - t).alias("tie_sum"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.withColumn("auc", F.try_divide("u", F.nullif(pairs, F.lit(0.0))))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return u_statistic(score_table(df, score, label)).select("n_pos", "n_neg", "u", "auc")


def mann_whitney(df: DataFrame, score: str, label: str, greater: int = 0, form: str | None = None) -> dict:
    """One-sided test that the group labelled ``greater`` scores higher.

    ``form`` of the p-value, "exact" or "normal", follows the published rule unless given; the result names it.
    ``p_value`` is None with fewer than two known scores in a group.
    """
    row = u_statistic(score_table(df, score, label)).head()
    n_pos, n_neg = row["n_pos"], row["n_neg"]
    out = {"n_greater": n_pos if greater else n_neg, "n_other": n_neg if greater else n_pos,
           "u": None, "p_value": None, "form": None}
    if n_pos >= 2 and n_neg >= 2:
        u = row["u"] if greater else n_pos * n_neg - row["u"]
        out["u"] = u
        out["form"] = form or significance.u_form(n_pos, n_neg, row["tie_sum"])
        out["p_value"] = round(significance.u_greater_p(
            u, out["n_greater"], out["n_other"], row["tie_sum"], out["form"]), 4)
    return out


def class_centres(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean and exact median of the score per label."""
    df = stage(df.select(label, score), "outcomes")
    means = df.groupBy(label).agg(F.count(score).alias("n"), F.avg(score).alias("mean"))
    medians = quantiles(df, [score], [0.5], [label]).select(label, F.col("q0").alias("median"))
    return means.join(medians, label, "left")


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """False and true positive rate at every distinct score, from the strictest down.

    The curve begins at (0, 0), where no score is high enough; that point's threshold is infinite.  Both classes must be present; with one class there are no points.
    """
    table = score_table(df, score, label)
    at_least_pos = F.col("pos_total") - F.col("pos_before")
    at_least_neg = F.col("neg_total") - F.col("neg_before")
    points = table.filter((F.col("pos_total") > 0) & (F.col("neg_total") > 0)).select(
        F.col("score").cast("double").alias("threshold"),
        (at_least_neg / F.col("neg_total")).alias("fpr"),
        (at_least_pos / F.col("pos_total")).alias("tpr"))
    start = points.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def validate_scores(
    scores: DataFrame, labels: DataFrame, key: str = "county_fips", threshold: float = 60.0,
    test_column: str = "social_score",
) -> dict:
    """AUC, one-sided p and macro F1 of the scores against known outcomes.

    All are None when fewer than five labelled rows find a score.
    """
    matched = match_outcomes(labels, scores, key)
    wanted = ["label", "psi"] + ([test_column] if test_column in matched.columns else [])
    matched = stage(matched.select(*wanted), "matched")
    out = {"n": matched.count(), "auc": None, "p_value": None, "macro_f1": None}
    if out["n"] < 5:
        return out
    predicted = matched.withColumn("predicted", viable("psi", threshold))
    report = classification_report(predicted, "label", "predicted")
    out["macro_f1"] = round(report.filter("class = 'macro avg'").head()["f1"], 3)
    if test_column in matched.columns:
        out["p_value"] = mann_whitney(matched, test_column, "label", greater=0)["p_value"]
    area = auc(matched, "psi", "label").head()["auc"]
    out["auc"] = None if area is None else round(area, 3)
    return out


# -------------------------------------------------------------------- sensitivity

def scenario_scores(
    df: DataFrame, derived: Mapping[str, float], dimensions: Dimensions,
    inverted: Iterable[str] = tuple(INVERTED_FEATURES), key: str = "county_fips",
    scenarios: Mapping[str, Mapping[str, float]] = WEIGHT_SCENARIOS,
) -> DataFrame:
    """One row per location and weight scenario; features are normalized once for all."""
    scores = dimension_scores(df, dimensions, inverted, [key])
    cases = {**scenarios, "Derived": derived}
    return scores.select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("scenario"), weighted_score(dimensions, w).alias("psi"))
        for name, w in cases.items()])))


def scenario_ranks(long: DataFrame, key: str = "county_fips") -> DataFrame:
    """Add the mean descending rank and the count of lower scores within each scenario."""
    known = long.filter(F.col("psi").isNotNull())
    ranges = value_ranges(known, ["psi"])
    counts = known.groupBy("scenario", "psi").agg(F.count(F.lit(1)).alias("n"))
    placed = with_preceding(with_range(counts, "psi", ranges), "psi", ["n"], ["scenario"])
    ranked = placed.select("scenario", "psi", average_rank(True).alias("rank"),
                           F.col("n_before").alias("lower"))
    return hot_safe_join(known, ranked, ["scenario", "psi"], "psi", ranges, "inner").select(
        key, "scenario", "psi", "rank", "lower")


def rank_table(ranks: DataFrame, names: Sequence[str], key: str = "county_fips") -> DataFrame:
    """One row per location, one rank column per scenario."""
    return ranks.groupBy(key).agg(*[
        F.max(F.when(F.col("scenario") == n, F.col("rank"))).alias(n) for n in names])


def _inversions(y, w) -> int:
    """Sum of w[i] * w[j] over all i < j with y[i] > y[j].

    Two values first differ at one bit; for each bit, values sharing the higher bits form a cell, and a pair counts there
    if the earlier one has the bit set and the later one has not.  That needs only running totals, no pairs.
    """
    import numpy as np

    y = np.unique(y, return_inverse=True)[1]
    total = 0
    for bit in range(int(y.max(initial=0)).bit_length()):
        order = np.argsort(y >> (bit + 1), kind="stable")
        cell, is_set = y[order] >> (bit + 1), y[order] >> bit & 1
        ones, zeros = w[order] * is_set, w[order] * (1 - is_set)
        before = np.cumsum(ones) - ones
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        outside = np.repeat(before[first], np.diff(np.append(first, len(y))))
        total += int((zeros * (before - outside)).sum())
    return total


def _blocks(points: DataFrame, n: int, by: str, order: Sequence[str], out: str, within: str) -> DataFrame:
    """Deal points over ``n`` tasks along ``order``; ``out`` numbers the tasks' blocks in that order.

    ``found``, on the first row of each group and block, counts the block's pairs that go up by (``within``, y) and down by y.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    names = points.columns

    def run(batches: Iterator) -> Iterator:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        cols = {c: np.concatenate([b.column(i).to_numpy() for b in batches]) for i, c in enumerate(names)}
        place = np.lexsort((cols["y"], cols[within], cols[by]))
        cols = {c: v[place] for c, v in cols.items()}
        groups, first = np.unique(cols[by], return_index=True)
        ends = np.append(first[1:], len(place))
        found = np.zeros(len(place), np.int64)
        found[first] = [_inversions(cols["y"][a:b], cols["w"][a:b]) for a, b in zip(first, ends)]
        block = np.full(len(place), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_pydict(cols | {out: block, "found": found})

    schema = ", ".join(f"`{c}` bigint" for c in [*names, out, "found"])
    dealt = points.repartitionByRange(n, by, *order) if n > 1 else points.coalesce(1)
    return stage(dealt.mapInArrow(run, schema), "blocks")


def discordant_pairs(points: DataFrame, by: str, size: int = BLOCK_POINTS) -> DataFrame:
    """Pairs ordered one way by x and the other way by y, counted exactly per group.

    x, y and the group ``by`` are integers, (by, x, y) is unique, and w counts equal points.  A pair is discordant if and
    only if it stands one way by (x, y) and the other way by (y, x), and neither order has ties.  Points are dealt into
    blocks along the one and into blocks along the other, of about ``size`` points however many are equal in x or y.
    Pairs that share a block of either order are counted inside it; for all others the blocks' numbers tell, so they are
    counted over the few points (block, block).
    """
    points = points.select(*[F.col(c).cast("long").alias(c) for c in (by, "x", "y", "w")])
    counted = []
    while True:
        n = -(-points.count() // size)
        first = _blocks(points, n, by, ["x", "y"], "block", "x")
        counted.append(first.select(by, "found"))
        if n <= 1:
            break
        second = _blocks(first.drop("found"), n, by, ["y", "x"], "stripe", "block")
        counted.append(second.select(by, "found"))
        cells = second.groupBy(by, F.col("block").alias("x"), F.col("stripe").alias("y")).agg(F.sum("w").alias("w"))
        points = stage(cells.select(by, "x", "y", "w"), "cells")
    return reduce(DataFrame.unionByName, counted).groupBy(by).agg(
        F.sum(F.col("found").cast("decimal(38,0)")).cast("decimal(38,0)").alias("discordant"))


def _tie_sums(points: DataFrame, by: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    groups = points.groupBy(*by, *cols).agg(F.sum("w").cast("decimal(19,0)").alias("t"))
    t = F.col("t")
    d = t.cast("double")
    return groups.groupBy(*by).agg(
        F.sum((t * (t - 1) / 2).cast("decimal(38,0)")).alias(f"{name}_ties"),
        F.sum(d * (d - 1) * (d - 2)).alias(f"{name}_m0"),
        F.sum(d * (d - 1) * (2 * d + 5)).alias(f"{name}_m1"))


def kendall_pairs(
    ranks: DataFrame, names: Sequence[str], key: str = "county_fips", form: str | None = None,
) -> DataFrame:
    """Kendall's tau-b and its p for every pair of scenarios, over shared locations.

    Pairs with fewer than three shared locations are left out; ``form`` of the p as in ``tau_p``.
    """
    spark = ranks.sparkSession
    wide = ranks.groupBy(key).agg(*[
        F.max(F.when(F.col("scenario") == n, F.col("lower"))).alias(f"s{i}")
        for i, n in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    points = wide.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("pair"), F.col(f"s{i}").alias("x"), F.col(f"s{j}").alias("y"))
        for p, (i, j) in enumerate(pairs)]))).filter("x is not null and y is not null")
    points = stage(points.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")
    sizes = points.groupBy("pair").agg(F.sum("w").alias("n")).collect()
    totals = {r["pair"]: {"n": r["n"]} for r in sizes}  # one row per scenario pair
    merged = (
        discordant_pairs(points, "pair")
        .join(_tie_sums(points, ["pair"], ["x"], "x"), "pair")
        .join(_tie_sums(points, ["pair"], ["y"], "y"), "pair")
        .join(_tie_sums(points, ["pair"], ["x", "y"], "xy"), "pair"))
    for r in merged.collect():  # one row per scenario pair
        totals[r["pair"]].update(r.asDict())
    rows = []
    for p, (i, j) in enumerate(pairs):
        t = totals.get(p)
        if t is None or t["n"] < 3:
            continue
        counts = (t["n"], int(t["discordant"]), int(t["x_ties"]), int(t["y_ties"]), int(t["xy_ties"]))
        tau = significance.tau_b(*counts)
        p_value = significance.tau_p(*counts, (t["x_m0"], t["x_m1"]), (t["y_m0"], t["y_m1"]), form)
        rows.append((names[i], names[j], None if tau is None else round(tau, 3),
                     None if p_value is None else round(p_value, 4)))
    out = small_table(
        spark, rows, "scenario_1 string, scenario_2 string, kendall_tau double, p_value double")
    return out.withColumn("stability", stability("kendall_tau"))


def sensitivity(
    df: DataFrame, derived: Mapping[str, float] = FALLBACK_WEIGHTS,
    dimensions: Dimensions = DIMENSIONS, inverted: Iterable[str] = tuple(INVERTED_FEATURES),
    key: str = "county_fips",
) -> tuple[DataFrame, DataFrame]:
    """Rank agreement of all scenario pairs, and the ten best by derived weights in each."""
    names = [*WEIGHT_SCENARIOS, "Derived"]
    long = scenario_scores(df, derived, dimensions, inverted, key)
    ranks = stage(scenario_ranks(long, key), "ranks")
    table = rank_table(ranks, names, key).orderBy(F.asc_nulls_last("Derived"), key).limit(10)
    return kendall_pairs(ranks, names, key), table
