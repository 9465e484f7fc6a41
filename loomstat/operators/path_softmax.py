"""Word vectors with hierarchical softmax as joins: word vectors and inner vectors are tables, and no task or driver holds them all.

A step takes some documents. Each token's context mean meets the inner vectors of its path; the gradients are summed by inner
node and by context word, and each vector moves once, by its own step size (Adagrad: acc holds the mean square of its gradients so far).
Tokens carry id, codes give each id its path: (id, steps), steps an array of (node, sign), sign 1 for code 0 and -1 for code 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.operators import embed
from loomstat.scratch import cut


@dataclass
class PathConfig:
    rate: float = 0.1
    size: int = 20
    window: int = 5
    epochs: int = 5
    steps: int = 4
    seed: int = 0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def paths(codes: DataFrame) -> DataFrame:
    """(id, steps) from the table (id, path, code) of a Huffman tree."""
    return codes.select("id", F.zip_with("path", "code", lambda node, code: F.struct(node.cast("long").alias("node"), (1 - 2 * code).cast("double").alias("sign"))).alias("steps"))


def start(ids: DataFrame, config: PathConfig) -> DataFrame:
    """(id, vec, acc) at random near 0, by a hash of id."""
    near = [(F.pmod(F.xxhash64("id", F.lit(j), F.lit(config.seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) / config.size for j in range(config.size)]
    return ids.select("id", F.array(*near).alias("vec"), F.lit(0.0).alias("acc"))


def start_inner(codes: DataFrame, size: int) -> DataFrame:
    """(node, vec, acc), all zero, for every node on a path."""
    return codes.select(F.explode("steps.node").alias("node")).distinct().select("node", F.array_repeat(F.lit(0.0), size).alias("vec"), F.lit(0.0).alias("acc"))


def context(tokens: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """doc_id, pos, id, h, near: each token with the mean of its context's vectors and the context's ids.

    Tokens are (doc_id, pos, id) with pos from 0 without gaps; a token alone in its document has no context and no row.
    """
    at = tokens.select("doc_id", F.col("pos").alias("other"), F.col("id").alias("near"))
    pairs = embed.context_pairs(tokens, window).join(at, ["doc_id", "other"])
    held = pairs.join(vectors.select(F.col("id").alias("near"), "vec"), "near").groupBy("doc_id", "pos").agg(F.collect_list(F.struct("near", "vec")).alias("c"))  # window - 1 each at most
    add = lambda acc, x: F.zip_with(acc, x["vec"], lambda a, b: F.coalesce(a, F.lit(0.0)) + b)
    mean = F.transform(F.aggregate("c", F.array().cast("array<double>"), add), lambda x: x / F.size("c"))
    return held.join(tokens.select("doc_id", "pos", "id"), ["doc_id", "pos"]).select("doc_id", "pos", "id", mean.alias("h"), F.col("c.near").alias("near"))


def visits(placed: DataFrame, codes: DataFrame, inner: DataFrame) -> DataFrame:
    """doc_id, pos, node, g, loss: what each node of a token's path says of it, g being the gradient on sign-free h . w."""
    steps = placed.join(codes, "id").select("doc_id", "pos", "h", F.explode("steps").alias("s")).select("doc_id", "pos", "h", "s.node", "s.sign")
    z = F.col("sign") * dot(F.col("h"), F.col("vec"))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return steps.join(inner.select("node", "vec"), "node").select("doc_id", "pos", "node", ((1 - p) * F.col("sign")).alias("g"), (-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def summed(rows: DataFrame, by: list[str], weight: Column, vec: str, size: int) -> DataFrame:
    """by and grad: the sums of weight * vec, added up before they are moved."""
    sums = rows.groupBy(*by).agg(*[F.sum(weight * F.col(vec)[j]).alias(f"g{j}") for j in range(size)])
    return sums.select(*by, F.array(*[f"g{j}" for j in range(size)]).alias("grad"))


def moved(vectors: DataFrame, grads: DataFrame, key: str, rate: float) -> DataFrame:
    """vectors (key, vec, acc) after a step along grads (key, grad); those without one stay."""
    both = vectors.join(grads, key, "left")
    acc = F.col("acc") + F.coalesce(dot(F.col("grad"), F.col("grad")) / F.size("grad"), F.lit(0.0))
    both = both.withColumn("acc", acc)
    to = F.zip_with("vec", "grad", lambda v, g: v + rate * g / F.sqrt(F.col("acc") + 1e-12))
    return both.select(key, F.coalesce(to, F.col("vec")).alias("vec"), "acc")


def step(tokens: DataFrame, codes: DataFrame, vectors: DataFrame, inner: DataFrame, *, window: int, rate: float, size: int, fixed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row (loss, n) before the step, and word vectors and inner vectors after it; fixed keeps the inner ones."""
    placed = cut(context(tokens, vectors, window))
    seen = cut(visits(placed, codes, inner))
    back = summed(seen.join(inner.select("node", "vec"), "node"), ["doc_id", "pos"], F.col("g"), "vec", size)
    near = placed.select("doc_id", "pos", F.explode("near").alias("id")).join(back, ["doc_id", "pos"])
    words = moved(vectors, summed(near, ["id"], F.lit(1.0), "grad", size), "id", rate)
    if not fixed:
        inner = cut(moved(inner, summed(seen.join(placed.select("doc_id", "pos", "h"), ["doc_id", "pos"]), ["node"], F.col("g"), "h", size), "node", rate))
    loss = seen.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"), F.count_distinct("doc_id", "pos").alias("n"))
    return loss, cut(words), inner


def train(tokens: DataFrame, codes: DataFrame, config: PathConfig, *, vectors: DataFrame | None = None, inner: DataFrame | None = None, fixed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word vectors (id, vec, acc), inner vectors (node, vec, acc) and the losses (epoch, loss, n) before each epoch's steps.

    tokens: (doc_id, pos, id); documents are dealt into config.steps steps an epoch by a hash. vectors and inner continue from a model.
    Nothing comes to the driver. Empty tables give the start.
    """
    c = config
    tokens = cut(tokens.select("doc_id", "pos", "id"))
    vectors = vectors if vectors is not None else cut(start(codes, c))
    inner = inner if inner is not None else cut(start_inner(codes, c.size))
    losses = None
    for epoch in range(c.epochs):
        for part in range(c.steps):
            some = tokens.where(F.pmod(F.xxhash64("doc_id", F.lit(c.seed)), F.lit(c.steps)) == part)
            loss, vectors, inner = step(some, codes, vectors, inner, window=c.window, rate=c.rate, size=c.size, fixed=fixed)
            loss = loss.select(F.lit(epoch).alias("epoch"), "loss", "n")
            losses = loss if losses is None else losses.unionByName(loss)
    schema = "epoch int, loss double, n long"
    losses = tokens.sparkSession.createDataFrame([], schema) if losses is None else losses
    return vectors, inner, losses.groupBy("epoch").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
