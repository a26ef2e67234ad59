"""Logistic regression by Newton steps, several models side by side.

A step needs the gradient and the Hessian of the penalised likelihood, which are sums over the rows; the model is a group
key of that one aggregate.  Only these sums, a few numbers per model, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MAX_PASSES = 60
SMALL_STEP = 1e-9


@dataclass(frozen=True)
class Fit:
    intercept: float
    coefficients: tuple[float, ...]

    def line(self, columns: Sequence[str]) -> Column:
        """Log odds of a row."""
        out = F.lit(self.intercept)
        for name, c in zip(columns, self.coefficients):
            out = out + F.col(name) * F.lit(c)
        return out


def _sums(rows: DataFrame, columns: Sequence[str], betas: np.ndarray, weights: np.ndarray) -> dict[int, tuple]:
    """Per model: loss, gradient and Hessian of the weighted likelihood at its coefficients."""
    def of_model(values) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("_model"))

    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    parts = rows.withColumn("_z", sum((of_model(betas[:, j]) * x[j] for j in range(1, len(x))), of_model(betas[:, 0])))
    parts = parts.withColumn("_w", F.when(F.col("label") == 1, of_model(weights[:, 1])).otherwise(of_model(weights[:, 0])))
    parts = parts.withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
    z, w, p, y = F.col("_z"), F.col("_w"), F.col("_p"), F.col("label")
    loss = w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    found = parts.groupBy("_model").agg(
        F.sum(loss).alias("loss"), *[F.sum(w * (p - y) * x[j]).alias(f"g{j}") for j in range(len(x))],
        *[F.sum(w * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).collect()  # one row per model
    out = {}
    for r in found:
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r["_model"]] = r["loss"], np.array([r[f"g{j}"] for j in range(len(x))]), h
    return out


def fit_models(rows: DataFrame, columns: Sequence[str], n_models: int, penalty: float = 1.0) -> list[Fit]:
    """Models 0 .. ``n_models`` - 1 over ``rows`` (``label`` 0 or 1, ``columns``, ``_models``: the models a row trains).

    Classes are weighted to equal sums in each model, and the squared coefficients, not the intercept, are penalised.  A step
    that does not lower the loss is halved.  A model without rows keeps zeros.
    """
    each = rows.select("label", *[F.col(c).cast("double").alias(c) for c in columns], F.explode("_models").alias("_model"))
    weights = np.zeros((n_models, 2))
    for r in each.groupBy("_model").agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).collect():
        weights[r[0]] = [(r[1] + r[2]) / (2 * max(n, 1)) for n in (r[1], r[2])]
    ridge = np.diag([0.0] + [penalty] * len(columns))
    at = np.zeros((n_models, len(columns) + 1))
    tried, step, scale, best = at.copy(), np.zeros_like(at), np.ones(n_models), np.full(n_models, np.inf)
    moving = set(range(n_models))
    for _ in range(MAX_PASSES):
        told = _sums(each.where(F.col("_model").isin(sorted(moving))), columns, tried, weights)
        for m in list(moving):
            if m not in told:
                moving.remove(m)
                continue
            loss, gradient, hessian = told[m]
            loss += penalty / 2 * float(tried[m, 1:] @ tried[m, 1:])
            if loss <= best[m] + 1e-12 * abs(loss):
                at[m], best[m], scale[m] = tried[m], loss, 1.0
                step[m] = np.linalg.solve(hessian + ridge, gradient + ridge @ at[m])
            else:
                scale[m] /= 2
            tried[m] = at[m] - scale[m] * step[m]
            if np.abs(scale[m] * step[m]).max() <= SMALL_STEP * (1 + np.abs(at[m]).max()):
                moving.remove(m)
        if not moving:
            break
    return [Fit(float(b[0]), tuple(map(float, b[1:]))) for b in at]
