"""Linear models over blocks of rows: a task holds a block, and a partition gives what its rows in order give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import linear


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(0, 300).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("label")).localCheckpoint()
    f = spark.range(0, 330).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("pos"))  # 30 rows' features too many
    f = f.where("row_id % 5 <> 4").select("row_id", F.col("pos").cast("int").alias("pos"), F.concat(F.lit("f"), F.col("pos")).alias("name"), F.sin(F.col("row_id") * 7 + F.col("pos")).alias("value"))
    names = spark.createDataFrame([("f0", 0), ("f1", 1), ("f2", 2), ("f3", 3)], "name string, id long")
    return rows, f.localCheckpoint(), names


def model(df):
    return {r["name"]: np.array(r[1]) for r in df.collect()}


@pytest.mark.parametrize("records", [3, 100, 50_000])
def test_one_partition_of_the_latent_layer_equals_one_task(tables, monkeypatch, records):
    monkeypatch.setattr(linear, "BLOCK_RECORDS", records)
    config = linear.LogisticConfig(rate=0.05, epochs=3, hidden=3, norm=2, lam=0.01, tolerance=-1e9)
    rng, d = np.random.default_rng(config.seed), 4
    inner, outer = (rng.random((d, 3)) - 0.5) / np.sqrt(3), (rng.random(3) - 0.5) / np.sqrt(3)
    held = [(r["label"], np.array(r["ids"], int), np.array(r["vals"])) for r in linear.packed(*tables).orderBy("row_id").collect()]
    for _ in range(config.epochs):
        for y, i, v in held:
            s = 1 / (1 + np.exp(-(v @ inner[i])))
            r = 1 / (1 + np.exp(-(s @ outer))) - y
            inner[i] -= config.rate * (np.outer(v, r * outer * s * (1 - s)) + config.lam * inner[i])
            outer -= config.rate * (r * s + config.lam * outer)
    want, got = {None: outer} | {f"f{i}": inner[i] for i in range(d)}, model(linear.fit_latent(*tables, config, partitions=1))
    assert want.keys() == got.keys()
    assert all(np.allclose(want[k], got[k], atol=1e-9) for k in want)


def test_several_partitions_of_the_latent_layer_learn(tables):
    got = model(linear.fit_latent(*tables, linear.LogisticConfig(rate=0.05, epochs=3, hidden=3, norm=2), partitions=3))
    assert got.keys() == {None, "f0", "f1", "f2", "f3"}
    assert all(np.isfinite(v).all() for v in got.values())


@pytest.mark.parametrize("norm", [1, 2])
def test_one_partition_of_descent_equals_one_task(tables, norm):
    config = linear.LogisticConfig(rate=0.05, epochs=3, norm=norm, lam=0.01, tolerance=-1.0)
    want, got = model(linear.fit_sgd(*tables, config, "exact")), model(linear.fit_sgd(*tables, config, partitions=1))
    assert all(np.allclose(want[k], got[k], atol=1e-9) for k in want)
