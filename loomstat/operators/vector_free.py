"""L-BFGS and OWL-QN whose vectors are tables by feature: only the dot products of the last steps come to the driver.

The direction is a combination of the last steps s, the last gradient differences y and the (sub-)gradient. The two loops of the recursion
only need the dot products of these 2 m + 1 vectors, so they run on that small table and end with 2 m + 1 coefficients.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.operators import metrics
from loomstat.operators.linear import linear_scores
from loomstat.scratch import cut


def recursion(dots: np.ndarray, m: int) -> np.ndarray:
    """Coefficients of s_1 .. s_m, y_1 .. y_m and the gradient in the direction, from the table of their dot products."""
    d = np.zeros(2 * m + 1)
    d[-1] = -1.0
    alphas = np.zeros(m)
    for i in range(m - 1, -1, -1):
        alphas[i] = (dots[i] @ d) / dots[i, m + i]
        d[m + i] -= alphas[i]
    if m:
        d *= dots[m - 1, 2 * m - 1] / dots[2 * m - 1, 2 * m - 1]
    for i in range(m):
        d[i] += alphas[i] - (dots[m + i] @ d) / dots[i, m + i]
    return d


def products(vectors: DataFrame, b: str, n: int) -> np.ndarray:
    """The dot products of the n vectors that lie side by side in the array column b."""
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = vectors.agg(*[F.coalesce(F.sum(F.col(b)[i] * F.col(b)[j]), F.lit(0.0)) for i, j in pairs]).first()
    out = np.zeros((n, n))
    for (i, j), x in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = x
    return out


def combined(b: str, coefficients: np.ndarray) -> Column:
    terms = [F.lit(float(c)) * F.col(b)[i] for i, c in enumerate(coefficients)]
    return sum(terms[1:], terms[0])


def direction(vectors: DataFrame, m: int, sub: str = "sub") -> DataFrame:
    """vectors (s and y, arrays of the last m steps and differences, and sub) with d, the direction of the two loops."""
    held = vectors.withColumn("b", F.concat("s", "y", F.array(sub)))
    return held.withColumn("d", combined("b", recursion(products(held, "b", 2 * m + 1), m))).drop("b")


def _sub(w: Column, g: Column, l1: float) -> Column:
    """The gradient, or of f + l1 |w| the sub-gradient of least size."""
    if not l1:
        return g
    at_zero = F.when(g > l1, g - l1).when(g < -l1, g + l1).otherwise(0.0)
    return F.when(w > 0, g + l1).when(w < 0, g - l1).otherwise(at_zero)


def minimise(evaluate: Callable[[DataFrame], tuple[float, DataFrame]], names: DataFrame, *, l1: float = 0.0, iterations: int = 50, memory: int = 5, tolerance: float = 1e-5, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """name, w where evaluate(weights (name, w)) -> (value, gradient (name, g)) is least; with l1 > 0, where value + l1 * |w| is.

    Backtracking (Armijo 1e-4) with 30 halvings at most; ends when the value changes by no more than tolerance.
    """
    w, g, d, sub = (F.col(c) for c in ("w", "g", "d", "sub"))

    def whole(weights: DataFrame) -> tuple[float, DataFrame]:
        value, gradient = evaluate(weights)
        size = l1 * (weights.agg(F.coalesce(F.sum(F.abs("w")), F.lit(0.0))).first()[0]) if l1 else 0.0
        return value + size, gradient

    now = cut(names.select("name", F.lit(0.0).alias("w")))
    value, gradient = whole(now)
    none = F.array().cast("array<double>")
    now = cut(now.join(gradient, "name").select("name", "w", "g", _sub(w, g, l1).alias("sub"), none.alias("s"), none.alias("y")))
    held = 0
    for number in range(1, iterations + 1):
        towards = direction(now, held)
        if l1:
            towards = towards.withColumn("d", F.when(d * sub >= 0, 0.0).otherwise(d))
        towards = cut(towards)
        slope, square = towards.agg(F.sum(d * sub), F.sum(d * d)).first()
        if slope is None or slope >= 0:
            break
        length = square**0.5
        step = 1.0 if held or length >= 0.125 else 1 / length
        orthant = F.when(w != 0, F.signum("w")).otherwise(-F.signum("sub"))
        for _ in range(30):
            new = w + step * d
            new = F.when(new * orthant < 0, 0.0).otherwise(new) if l1 else new
            tried = cut(towards.select("name", new.alias("w")))
            new_value, gradient = whole(tried)
            gain = towards.join(tried.withColumnRenamed("w", "to"), "name").agg(F.sum((F.col("to") - w) * sub)).first()[0]
            if new_value <= value + 1e-4 * gain:
                break
            step /= 2
        else:
            break
        moved = towards.join(tried.withColumnRenamed("w", "to"), "name").join(gradient.withColumnRenamed("g", "to_g"), "name")
        moved = cut(moved.select("name", F.col("to").alias("w"), F.col("to_g").alias("g"), _sub(F.col("to"), F.col("to_g"), l1).alias("sub"), "s", "y", (F.col("to") - w).alias("ds"), (F.col("to_g") - g).alias("dy")))
        along, square = moved.agg(F.sum(F.col("ds") * F.col("dy")), F.sum(F.col("dy") * F.col("dy"))).first()
        if along > 1e-30:
            kept = min(held, memory - 1)
            last = lambda c, x: F.concat(F.slice(c, F.lit(held - kept + 1), F.lit(kept)) if kept else none, F.array(x))
            moved = moved.withColumns({"s": last("s", "ds"), "y": last("y", "dy")})
            held = kept + 1
        now = cut(moved.drop("ds", "dy"))
        done = abs(value - new_value) <= tolerance or square < 1e-30
        value = new_value
        if report:
            report(number, now.select("name", "w"))
        if done:
            break
    return now.select("name", "w")


def fit(rows: DataFrame, features: DataFrame, names: DataFrame, *, lam: float, norm: int, iterations: int = 50, memory: int = 5, tolerance: float = 1e-5, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """name, w at the minimum of the logistic objective: L-BFGS (norm 2) or OWL-QN (norm 1).

    The driver's memory doesn't depend on the number of features; rows meet their weights, and features their rows' residuals, by joins.
    """
    rows, features = cut(rows.select("row_id", "label")), cut(features.select("row_id", "name", "value"))
    z = F.col("z")

    def evaluate(weights: DataFrame) -> tuple[float, DataFrame]:
        scored = cut(linear_scores(rows, features, weights))
        loss = scored.agg(metrics.logistic_loss(z, F.col("label"))).first()[0] or 0.0
        residual = scored.select("row_id", (scalar.sigmoid(z) - F.col("label")).alias("r"))
        sums = features.join(residual, "row_id").groupBy("name").agg(F.sum(F.col("r") * F.col("value")).alias("sum"))
        slope = F.coalesce("sum", F.lit(0.0)) + (2 * lam * F.col("w") if norm == 2 else F.lit(0.0))
        gradient = cut(weights.join(sums, "name", "left").select("name", slope.alias("g")))
        size = lam * (weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0) if norm == 2 else 0.0
        return 1 + loss + size, gradient

    return minimise(evaluate, names, l1=lam if norm == 1 else 0.0, iterations=iterations, memory=memory, tolerance=tolerance, report=report)
