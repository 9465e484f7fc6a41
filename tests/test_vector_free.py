import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import linear, vector_free


def problem(spark, seed=1):
    rng = np.random.default_rng(seed)
    true = rng.normal(size=12)
    rows, feats = [], []
    for i in range(200):
        at = rng.choice(12, 4, replace=False)
        x = rng.normal(size=4)
        rows.append((i, float(rng.random() < 1 / (1 + np.exp(-(true[at] @ x))))))
        feats += [(i, p, f"f{j}", float(v)) for p, (j, v) in enumerate(zip(at, x))]
    names = spark.createDataFrame([(f"f{j}", j) for j in range(12)], "name string, id long")
    return spark.createDataFrame(rows, "row_id long, label double").coalesce(2), spark.createDataFrame(feats, "row_id long, pos int, name string, value double").coalesce(2), names.coalesce(1)


@pytest.mark.parametrize("m", [0, 1, 3])
def test_recursion_equals_the_loops_on_vectors(m):
    rng = np.random.default_rng(m)
    s = rng.normal(size=(m, 20))
    y = s + 0.3 * rng.normal(size=(m, 20))
    g = rng.normal(size=20)
    d, alphas = -g, []
    for i in reversed(range(m)):
        alphas.append((s[i] @ d) / (y[i] @ s[i]))
        d = d - alphas[-1] * y[i]
    if m:
        d = d * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for i, a in zip(range(m), reversed(alphas)):
        d = d + (a - (y[i] @ d) / (y[i] @ s[i])) * s[i]
    b = np.concatenate([s, y, g[None]])
    assert np.allclose(vector_free.recursion(b @ b.T, m) @ b, d)


@pytest.mark.parametrize("norm,lam", [(2, 0.5), (1, 3.0)])
def test_fit_finds_the_minimum_of_fit_batch(spark, norm, lam):
    rows, feats, names = problem(spark)
    seen = []
    options = {"lam": lam, "norm": norm, "iterations": 5, "tolerance": 1e-4}
    mine = {r["name"]: r.w for r in vector_free.fit(rows, feats, names, memory=2, report=lambda n, w: seen.append(n), **options).collect()}
    value = lambda w: linear.objective(rows, feats, spark.createDataFrame([(k, float(v)) for k, v in w.items()], "name string, w double"), lam, norm).first().objective
    theirs = {r["name"]: r.w for r in linear.fit_batch(rows, feats, names, lam=lam, norm=norm, iterations=40, tolerance=1e-9).collect()}
    assert len(mine) == 12 and seen == list(range(1, len(seen) + 1))
    assert value(mine) < value(dict.fromkeys(mine, 0.0)) and value(mine) <= value(theirs) * 1.01


def test_dots_are_all_that_comes_to_the_driver(spark):
    """5,000 features: the direction has a row for each, the driver gets 15 sums."""
    table = spark.range(5000).select(F.col("id").cast("string").alias("name"), F.array(F.rand(1), F.rand(2)).alias("s"), F.array(F.rand(3), F.rand(4)).alias("y"), (F.rand(5) - 0.5).alias("sub"))
    got = vector_free.direction(table, 2)
    assert got.count() == 5000 and got.agg(F.sum(F.col("d") * F.col("sub"))).first()[0] is not None
    assert vector_free.products(table.withColumn("b", F.concat("s", "y", F.array("sub"))), "b", 5).shape == (5, 5)
