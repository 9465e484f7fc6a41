"""Logistic regression with a hidden sigmoid layer, its inner vectors kept in a table: no task or driver holds a number for each feature.

A step takes some rows. Their features meet the inner vectors by name, a row's activations are summed by row, and the gradients by
name; each vector moves once, by its own step size (Adagrad: acc holds the mean square of its gradients so far). The output weights
(one number a hidden unit) are the driver's, which gets their gradient and the loss of a step, and nothing that grows with rows or features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.operators import metrics
from loomstat.operators.linear import LogisticConfig
from loomstat.operators.path_softmax import moved, summed
from loomstat.scratch import cut, folder

#: Steps of an epoch, and the rows that each has at least if there are several.
STEPS, STEP_ROWS = 4, 1000


@dataclass
class Layer:
    """inner: table (name, vec, acc); outer: a weight for each unit, acc as in inner."""

    inner: DataFrame
    outer: np.ndarray
    acc: float = 0.0


def start(names: DataFrame, config: LogisticConfig) -> Layer:
    """All weights at random in (-0.5, 0.5) / sqrt(units): the inner ones by a hash of the name."""
    k = max(1, config.hidden)
    near = [(F.pmod(F.xxhash64("name", F.lit(j), F.lit(config.seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) / float(np.sqrt(k)) for j in range(k)]
    return Layer(names.select("name", F.array(*near).alias("vec"), F.lit(0.0).alias("acc")), (np.random.default_rng(config.seed).random(k) - 0.5) / np.sqrt(k))


def forward(rows: DataFrame, features: DataFrame, layer: Layer) -> DataFrame:
    """rows with s, the units' activations, and z. Unknown features count for nothing; a row without any has 1/2 in every unit."""
    k = len(layer.outer)
    known = features.join(layer.inner.select("name", "vec"), "name")
    sums = summed(known, ["row_id"], F.col("value"), "vec", k).withColumnRenamed("grad", "s")
    s = F.transform(F.coalesce("s", F.array_repeat(F.lit(0.0), k)), lambda x: scalar.sigmoid(x))
    out = rows.join(sums, "row_id", "left").withColumn("s", s)
    return out.withColumn("z", scalar.dot(F.col("s"), F.array(*[F.lit(float(x)) for x in layer.outer])))


def step(rows: DataFrame, features: DataFrame, layer: Layer, *, rate: float, lam: float = 0.0) -> tuple[float, int, Layer]:
    """The loss before the step, the number of rows, and the layer after it. lam shrinks a weight once for each of its rows' uses."""
    k, outer = len(layer.outer), np.asarray(layer.outer, float)
    placed = forward(rows, features, layer).withColumn("r", F.col("label") - scalar.sigmoid(F.col("z")))
    back = F.zip_with("s", F.array(*[F.lit(float(x)) for x in outer]), lambda s, w: F.col("r") * w * s * (1 - s))
    placed = cut(placed.select("row_id", "label", "z", "r", "s", back.alias("back")))
    pulls = features.join(placed.select("row_id", "back"), "row_id")
    sums = pulls.groupBy("name").agg(*[F.sum(F.col("value") * F.col("back")[j]).alias(f"g{j}") for j in range(k)], F.count("*").alias("uses"))
    near = layer.inner.select("name", "vec").join(sums, "name")
    grads = near.select("name", F.array(*[F.col(f"g{j}") - lam * F.col("uses") * F.col("vec")[j] for j in range(k)]).alias("grad"))
    total = placed.agg(metrics.logistic_loss(F.col("z"), F.col("label")).alias("loss"), F.count("*").alias("n"), *[F.sum(F.col("r") * F.col("s")[j]).alias(f"g{j}") for j in range(k)]).first()
    if not total["n"]:
        return 0.0, 0, layer
    g = np.array([total[f"g{j}"] for j in range(k)]) - lam * total["n"] * outer
    acc = layer.acc + float(g @ g) / k
    return total["loss"], total["n"], Layer(cut(moved(layer.inner, grads, "name", rate)), outer + rate * g / np.sqrt(acc + 1e-12), acc)


def train(rows: DataFrame, features: DataFrame, names: DataFrame, config: LogisticConfig, *, steps: int | None = None, layer: Layer | None = None, report: Callable[[int, Layer], None] | None = None) -> tuple[Layer, list[float]]:
    """The layer, and the loss of each epoch, added up over its steps, each before its move.

    rows: (row_id, label), features: (row_id, name, value), names: (name). Rows are dealt into the steps of an epoch by a hash, and
    lie in the scratch folder by step, so that a step reads its own alone; without steps there are STEPS, fewer where one would have less than STEP_ROWS rows. layer continues from another; report(epoch from 1, layer)
    is called after each epoch. Training ends where an epoch's loss is no more than the tolerance below that of the one before.
    Features without names and repeated names of a row are as in forward(): left out, and added up. Without rows the start is given back.
    """
    if steps is not None and steps < 1:
        raise ValueError("steps is 1 at least")
    c, spark = config, rows.sparkSession
    steps = steps or max(1, min(STEPS, rows.count() // STEP_ROWS))
    layer = layer or start(names, c)
    layer.inner = cut(layer.inner)
    part = F.pmod(F.xxhash64("row_id", F.lit(c.seed)), F.lit(steps)).alias("part")
    kept = {}
    for name, table in (("rows", rows.select("row_id", "label", part)), ("features", features.select("row_id", "name", "value", part))):
        path = folder(spark, f"latent-{name}")
        table.write.partitionBy("part").parquet(path)
        kept[name] = spark.read.schema(table.schema).parquet(path)
    losses: list[float] = []
    for epoch in range(c.epochs):
        total, rate = 0.0, c.rate / (1 + c.decay * epoch)
        for at in range(steps):
            mine = F.col("part") == at
            loss, _, layer = step(kept["rows"].where(mine).drop("part"), kept["features"].where(mine).drop("part"), layer, rate=rate, lam=c.lam)
            total += loss
        losses.append(total)
        if report:
            report(epoch + 1, layer)
        if epoch and losses[-2] - total <= c.tolerance:
            break
    return layer, losses
