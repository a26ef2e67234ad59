"""Learn dimension weights from known outcomes.

Outcomes are lopsided, so classes are weighted, folds keep the class ratio, and
macro F1 decides whether synthetic rows of the smaller class help.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitegauge.functions.scalars import existing, row_mean
from sitegauge.operators.composite import Dimensions
from sitegauge.operators.logistic import Fit, fit_models
from sitegauge.operators.neighbours import nearest
from sitegauge.operators.profile import fill_medians
from sitegauge.operators.ranking import with_sequence
from sitegauge.operators.validation import classification_report
from sitegauge.session import small_table, stage
from sitegauge.sources.fixed_values import DIMENSIONS, FALLBACK_WEIGHTS

# Limits, seed and strategy names of the fit.
MIN_ROWS = 10
MIN_MINORITY = 6
NEIGHBOURS = 5
FOLDS = 5
SEED = 42
PLAIN = "balanced class weights"
MIXED = "SMOTE + balanced"


def dimension_matrix(df: DataFrame, dimensions: Dimensions, label: str, key: str = "county_fips") -> DataFrame:
    """Row id, label and one mean per dimension; absent is 50, unknown the median.

    The id is the row's own ``key``, so folds and made points don't depend on how the table is split.
    """
    cols = [(row_mean(existing(df, fs)) if existing(df, fs) else F.lit(50.0)).alias(d)
            for d, fs in dimensions.items()]
    rows = stage(df.select(F.col(key).alias("_id"),
                           F.col(label).cast("int").alias("label"), *cols), "outcomes")
    return fill_medians(rows, list(dimensions))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, shares in percent and the ratio of the larger to the smaller."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_successful"),
        F.count_if(F.col(label) == 0).alias("n_blocked")).select(
        "*", F.try_divide(F.col("n_successful") * 100.0, F.col("n")).alias("successful_pct"),
        F.try_divide(F.col("n_blocked") * 100.0, F.col("n")).alias("blocked_pct"),
        (F.greatest("n_successful", "n_blocked")
         / F.greatest(F.least("n_successful", "n_blocked"), F.lit(1))).alias("ratio"))


def with_folds(df: DataFrame, k: int, label: str = "label", key: str = "_id", seed: int = SEED) -> DataFrame:
    """Deal the rows of each class over k folds in hashed order.

    Rows are numbered within 4096 hash ranges per class and shifted by the
    ranges' offsets, so no class is sorted as a whole.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 3))
    earlier = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        label, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    numbered = hashed.withColumn("_i", inside).join(
        F.broadcast(offsets), [label, "_b"])  # 4096 rows per class
    return numbered.withColumn("fold", ((F.col("_offset") + F.col("_i") - 1) % k).cast("int")).select(
        *df.columns, "fold")


def in_models(df: DataFrame, models: Column) -> DataFrame:
    """Name the models that a row trains."""
    return df.withColumn("_models", models)


def fit_balanced(df: DataFrame, columns: Sequence[str]) -> Fit:
    """Logistic regression with L2 penalty 1 and classes weighted to equal sums."""
    return fit_models(in_models(df, F.array(F.lit(0))), columns, 1)[0]


def predict(fit: Fit, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("predicted", (fit.line(columns) > 0).cast("int"))


def synthetic_rows(
    rows: DataFrame, columns: Sequence[str], n_models: int, k: int = NEIGHBOURS, seed: int = SEED,
) -> DataFrame:
    """Points between neighbours of each model's smaller class, as many as even its classes.

    ``rows``: ``_id``, ``label``, ``columns`` and ``_models``.  Each point starts at a row drawn by a hash and goes a drawn
    part of the way to one of that row's ``k`` nearest of the same class and model.  Result: ``_model``, ``label``,
    ``columns``, and the ids of both ends, ``_from`` and ``_to``.
    """
    each = rows.withColumn("_model", F.explode("_models")).drop("_models")
    counts = [[0, 0] for _ in range(n_models)]
    for r in each.groupBy("_model", "label").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows per model
        counts[r["_model"]][r["label"]] = r["n"]
    small = [int(n1 < n0) for n0, n1 in counts]
    n_small = [counts[m][small[m]] for m in range(n_models)]
    missing = [abs(n0 - n1) if min(n0, n1) >= 2 else 0 for n0, n1 in counts]

    def of_model(values: Sequence[int]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_model"))

    wanted = each.filter((F.col("label") == of_model(small)) & (of_model(missing) > 0))
    # Numbered from 1 in all models together; a model's rows follow each other.
    numbered = with_sequence(wanted, [F.asc("_model"), F.asc("_id")], "_n")
    before, starts, ends = 0, [], []
    for m in range(n_models):
        starts.append(before)
        before += n_small[m] if missing[m] else 0
        ends.append(sum(missing[: m + 1]))
    near = stage(nearest(numbered, columns, k, "_n", "_model"), "neighbours")

    def draw(name: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(name), F.col("_model"), F.col("_nth"))

    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    points = rows.sparkSession.range(ends[-1] if ends else 0).withColumn(
        "_model", F.size(F.filter(bounds, lambda e: e <= F.col("id")))).select(
        "_model", (F.col("id") - of_model([e - missing[m] for m, e in enumerate(ends)])).alias("_nth"))
    picks = points.select(
        "_model", (F.pmod(draw("base"), of_model(n_small)) + of_model(starts) + 1).alias("_n"), draw("near").alias("_near"),
        (F.shiftrightunsigned(draw("gap"), 11) / float(1 << 53)).alias("_gap"))
    chosen = picks.join(near, "_n").select(
        "_model", "_n", "_gap", F.get("near", F.pmod("_near", F.size("near")).cast("int")).alias("_other"))
    start = numbered.select("_n", "label", F.col("_id").alias("_from"), *columns)
    other = numbered.select(F.col("_n").alias("_other"), F.col("_id").alias("_to"), *[F.col(c).alias(f"_to_{c}") for c in columns])
    made = chosen.join(start, "_n").join(other, "_other").select(
        "_model", "label", *[(F.col(c) + F.col("_gap") * (F.col(f"_to_{c}") - F.col(c))).alias(c) for c in columns], "_from", "_to")
    # Fitting passes over the rows many times; the search behind them runs once.
    return stage(made, "synthetic")


def oversample(df: DataFrame, columns: Sequence[str], k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """All rows, and points between neighbours of the smaller class until the classes are even."""
    made = synthetic_rows(in_models(df.select("_id", "label", *columns), F.array(F.lit(0))), columns, 1, k, seed)
    return df.select("label", *columns).unionByName(made.select("label", *columns))


def macro_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    report = classification_report(predictions, "label", "predicted", by)
    return report.filter(F.col("class") == "macro avg").select(*by, "f1")


def fold_fits(folded: DataFrame, columns: Sequence[str], k: int, synthetic: bool, seed: int = SEED) -> dict[str, list[Fit]]:
    """Per strategy the fits without fold 0 .. ``k`` - 1 and, last, the one of all rows; all are formed side by side."""
    ids = F.array(*[F.lit(m) for m in range(k + 1)])
    rows = in_models(folded, F.filter(ids, lambda m: m != F.col("fold"))).select("_id", "label", *columns, "_models")
    train = rows.select("label", *columns, "_models")
    if synthetic:
        made = synthetic_rows(rows, columns, k + 1, seed=seed)
        train = train.withColumn("_models", F.concat("_models", F.transform("_models", lambda m: m + (k + 1)))).unionByName(
            made.select("label", *columns, F.array(F.col("_model") + (k + 1)).alias("_models")))
        train = stage(train, "train")
    fits = fit_models(train, columns, (k + 1) * (2 if synthetic else 1))
    return {PLAIN: fits[: k + 1]} | ({MIXED: fits[k + 1 :]} if synthetic else {})


def fold_scores(folded: DataFrame, columns: Sequence[str], fits: Mapping[str, Sequence[Fit]]) -> DataFrame:
    """``strategy``, ``fold``, ``f1``: macro F1 of each fold under the fit without it; synthetic rows are only in training."""
    def told(strategy: str) -> Column:
        line = fits[strategy][0].line(columns)
        for m, fit in enumerate(fits[strategy][1:-1], 1):
            line = F.when(F.col("fold") == m, fit.line(columns)).otherwise(line)
        return F.struct(F.lit(strategy).alias("strategy"), (line > 0).cast("int").alias("predicted"))

    each = folded.select("fold", "label", F.explode(F.array(*[told(s) for s in fits])).alias("t")).select("fold", "label", "t.*")
    return macro_f1(each, ["strategy", "fold"])


def shares_of(coefficients: Mapping[str, float]) -> dict[str, float]:
    """Absolute coefficients as shares of one, to three places."""
    total = sum(abs(v) for v in coefficients.values())
    if not total:
        return dict(FALLBACK_WEIGHTS)
    weights = {d: round(abs(v) / total, 3) for d, v in coefficients.items()}
    whole = sum(weights.values())
    if abs(whole - 1.0) > 0.01:
        weights = {d: round(w / whole, 3) for d, w in weights.items()}
    return weights


def derive_weights(
    df: DataFrame, label: str = "label", dimensions: Dimensions = DIMENSIONS,
    fallback: Mapping[str, float] = FALLBACK_WEIGHTS, key: str = "county_fips", synthesis: bool = True,
) -> dict:
    """The weights document: weights, strategy, macro F1 and its spread, class counts and coefficients.

    Too few rows, or fewer than two of a class, give the fallback weights.  Without ``synthesis`` no synthetic rows of the
    smaller class are tried.
    """
    columns = list(dimensions)
    rows = dimension_matrix(df, dimensions, label, key)
    balance = class_balance(rows).head()
    n_built, n_stopped = balance["n_successful"], balance["n_blocked"]
    document = {
        "weights": dict(fallback), "fallback_weights": dict(fallback), "strategy": "fallback",
        "macro_f1": None, "macro_f1_spread": None, "n_successful": n_built, "n_blocked": n_stopped, "raw_coefficients": {}}
    k = min(FOLDS, n_built, n_stopped)
    if balance["n"] < MIN_ROWS or k < 2:
        return document
    folded = stage(with_folds(rows, k), "folds")
    fits = fold_fits(folded, columns, k, synthesis and n_stopped >= MIN_MINORITY)
    scores: dict[str, list[float]] = {s: [] for s in fits}
    for r in fold_scores(folded, columns, fits).collect():  # one row per strategy and fold
        scores[r["strategy"]].append(r["f1"])
    means = {s: sum(v) / len(v) for s, v in scores.items()}
    best = MIXED if MIXED in means and means[MIXED] > means[PLAIN] else PLAIN
    spread = math.sqrt(sum((v - means[best]) ** 2 for v in scores[best]) / len(scores[best]))
    coefficients = dict(zip(columns, fits[best][-1].coefficients))
    document.update(
        weights=shares_of(coefficients), macro_f1=round(means[best], 3), macro_f1_spread=round(spread, 3),
        strategy=best, raw_coefficients={d: round(v, 4) for d, v in coefficients.items()})
    return document


def coefficient_report(spark, document: Mapping) -> DataFrame:
    """Each dimension's weight, coefficient, and which way it pushes."""
    rows = [(d, float(w), document["raw_coefficients"].get(d)) for d, w in document["weights"].items()]
    table = small_table(spark, rows, "dimension string, weight double, coefficient double")
    return table.withColumn("direction", F.when(F.col("coefficient") > 0, "helps").when(
        F.col("coefficient").isNotNull(), "hurts"))
