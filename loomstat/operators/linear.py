"""Logistic regression without intercept on sparse rows: SGD, a latent layer, L-BFGS and OWL-QN."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.operators import metrics
from loomstat.operators.packed_lda import squeeze, unsqueeze


@dataclass
class LogisticConfig:
    """rate has no default that trains anything, so it must be given; the others are the usual ones."""

    rate: float
    decay: float = 0.0
    lam: float = 0.0
    tolerance: float = 1e-5
    norm: int = 1
    epochs: int = 10
    hidden: int = 0
    seed: int = 0


#: Weights that go to all tasks. Joined by name in a shuffle, few names would leave all rows to as few tasks.
SENT_WEIGHTS = 100_000


def linear_scores(rows: DataFrame, features: DataFrame, weights: DataFrame, row: str = "row_id") -> DataFrame:
    """rows with z, the sum of weight * value over a row's known features (0 without any)."""
    weights = weights.select("name", "w")
    if weights.limit(SENT_WEIGHTS + 1).count() <= SENT_WEIGHTS:
        weights = F.broadcast(weights)
    z = features.join(weights, "name").groupBy(row).agg(F.sum(F.col("w") * F.col("value")).alias("z"))
    return rows.join(z, row, "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def objective(rows: DataFrame, features: DataFrame, weights: DataFrame, lam: float, norm: int) -> DataFrame:
    """One row (objective): 1 + logistic loss + lam * |w|^2 (norm 2) or lam * |w| (norm 1)."""
    loss = linear_scores(rows, features, weights).agg(metrics.logistic_loss(F.col("z"), F.col("label")).alias("loss"))
    size = weights.agg(F.sum(F.col("w") * F.col("w") if norm == 2 else F.abs("w")).alias("size"))
    return loss.join(size).select((1.0 + F.col("loss") + lam * F.coalesce("size", F.lit(0.0))).alias("objective"))


def gradient(rows: DataFrame, features: DataFrame, weights: DataFrame, lam: float, norm: int) -> DataFrame:
    """name, w, g, sub: the gradient (with 2 * lam * w for norm 2) and for norm 1 the subgradient, 0 inside lam at w = 0."""
    z = linear_scores(rows, features, weights).select("row_id", (scalar.sigmoid(F.col("z")) - F.col("label")).alias("r"))
    g = features.join(z, "row_id").groupBy("name").agg(F.sum(F.col("r") * F.col("value")).alias("g"))
    out = weights.join(g, "name", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    if norm == 2:
        return out.withColumn("g", F.col("g") + 2 * lam * F.col("w")).withColumn("sub", F.col("g"))
    return out.withColumn("sub", scalar.l1_subgradient(F.col("w"), F.col("g"), lam, zero_inside=True))


def packed(rows: DataFrame, features: DataFrame, names: DataFrame) -> DataFrame:
    """row_id, label, ids, vals: a row's known features by dense id. names holds (name, id)."""
    known = features.join(names, "name").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "value"))).alias("f"))
    f = rows.join(known, "row_id", "left")
    empty = F.array().cast("array<struct<pos:int,id:long,value:double>>")
    f = f.withColumn("f", F.coalesce("f", empty))
    return f.select("row_id", "label", F.col("f.id").alias("ids"), F.col("f.value").alias("vals"))


#: Rows and features that a block is made of, about.
BLOCK_RECORDS = 50_000
_BLOCK = pa.schema([(name, pa.binary()) for name in ("y", "sizes", "ids", "vals")])


def _block(t: pa.Table) -> pa.RecordBatch:
    """One row from rows (id null) with their features behind them; features that follow no row of their own are left out."""
    own, head = t["row_id"].to_numpy(), t["id"].is_null().to_numpy()
    row = np.cumsum(head) - 1
    mine = ~head & (row >= 0) & (own == own[head][row])
    ids, vals, y = t["id"].fill_null(0).to_numpy()[mine], t["value"].to_numpy()[mine], t["label"].to_numpy()[head]
    return _written(y, np.bincount(row[mine], minlength=len(y)), ids, vals)


#: What y, sizes, ids and vals of a block are made of.
_KINDS = (np.float64, np.int32, np.int32, np.float64)


def _written(*held: np.ndarray) -> pa.RecordBatch:
    """A block of y, sizes, ids, vals, compressed: a number's first bytes one behind the other, then the second ones, and so on."""
    planes = [np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for x, kind in zip(held, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([squeeze(x)], pa.binary()) for x in planes], schema=_BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < BLOCK_RECORDS:
            continue
        t = pa.Table.from_batches(held)
        heads = np.flatnonzero(t["id"].is_null().to_numpy())
        if len(heads):
            if heads[-1]:
                yield _block(t.slice(0, int(heads[-1])))
            held = t.slice(int(heads[-1])).to_batches()  # more of the last row's features may follow
        else:
            held = []  # of rows that are not there
    if held and pa.Table.from_batches(held)["id"].null_count:
        yield _block(pa.Table.from_batches(held))


def blocks(rows: DataFrame, features: DataFrame, names: DataFrame, partitions: int) -> DataFrame:
    """packed() in bytes: y, sizes (features of each row), ids, vals of many rows at once, in order of row_id within a partition."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = features.join(names, "name").select("row_id", null("double", "label"), "pos", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    all_ = rows.select("row_id", F.col("label").cast("double").alias("label"), null("int", "pos"), null("long", "id"), null("double", "value")).unionByName(known)
    all_ = all_.repartition(partitions, "row_id").sortWithinPartitions("row_id", F.col("id").isNotNull(), "pos", "id", "value")
    return all_.select("row_id", "label", "id", "value").mapInArrow(_blocks, "y binary, sizes binary, ids binary, vals binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """y, sizes, ids, vals of each block."""
    for b in batches:
        for held in zip(*(b.column(n) for n in _BLOCK.names), strict=True):
            yield tuple(np.ascontiguousarray(np.frombuffer(unsqueeze(x.as_py()), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1) for x, kind in zip(held, _KINDS, strict=True))


def row_blocks(rows: DataFrame) -> DataFrame:
    """blocks() of rows that carry their features: label, ids, vals. No row is moved; features without a value are left out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vals = b.column("ids"), b.column("vals")
            row, has = np.repeat(np.arange(len(b)), ids.value_lengths().to_numpy()), vals.flatten().is_valid().to_numpy(zero_copy_only=False)
            flat = lambda x: x.flatten().fill_null(0).to_numpy()[has]
            yield _written(b.column("label").to_numpy(), np.bincount(row[has], minlength=len(b)), flat(ids), flat(vals))

    return rows.select(F.col("label").cast("double").alias("label"), F.col("ids").cast("array<int>").alias("ids"), F.col("vals").cast("array<double>").alias("vals")).mapInArrow(made, "y binary, sizes binary, ids binary, vals binary")


def _losses(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.where(z > 30, z, np.where(z < -30, 0.0, np.log1p(np.exp(np.clip(z, -30, 30))))) - np.where(y > 0, z, 0.0)))


def _shares(rows: DataFrame, at_least: int) -> int:
    """Partitions, one for each PASS_ROWS rows."""
    return max(at_least, -(-rows.count() // PASS_ROWS))


def latent_forward(rows: DataFrame, features: DataFrame, inner: DataFrame, outer: list[float]) -> DataFrame:
    """rows with z of a hidden sigmoid layer: inner holds (name, v array), outer the weight of each unit."""
    assert outer
    h = features.join(inner, "name").groupBy("row_id").agg(*[F.sum(F.get("v", F.lit(j)) * F.col("value")).alias(f"a{j}") for j in range(len(outer))])
    unit = [F.coalesce(scalar.sigmoid(F.col(f"a{j}")) * float(x), F.lit(0.0)) for j, x in enumerate(outer)]  # 0: no feature has this unit
    z = h.select("row_id", sum(unit[1:], unit[0]).alias("z"))
    idle = 0.5 * sum(outer)  # a row without features has 1/2 in every unit
    return rows.join(z, "row_id", "left").withColumn("z", F.coalesce("z", F.lit(idle)))


def _sigmoid(z: float) -> float:
    return 1.0 if z > 30 else 0.0 if z < -30 else 1 / (1 + np.exp(-z))


def _moved_weight(x: float, g: float, c: LogisticConfig, rate: float) -> float:
    if c.norm == 2:
        return x - rate * (g + c.lam * x)
    g += c.lam if x > 0 else -c.lam if x < 0 else -c.lam if g > c.lam else c.lam if g < -c.lam else 0.0
    new = x - rate * g
    return 0.0 if x * new < 0 else new


def _sgd_block(w: list[float], y: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vals: np.ndarray, c: LogisticConfig, rate: float) -> None:
    """_sgd_pass over a block, in plain numbers: a row has few features."""
    at, ids, vals = 0, ids.tolist(), vals.tolist()
    for label, n in zip(y.tolist(), sizes.tolist(), strict=True):
        if not n:
            continue
        i, v = ids[at : at + n], vals[at : at + n]
        at += n
        old = [w[x] for x in i]
        z = sum(map(mul, old, v))
        r = (1.0 if z > 30 else 0.0 if z < -30 else 1 / (1 + exp(-z))) - label
        for x, new in zip(i, [_moved_weight(a, r * b, c, rate) for a, b in zip(old, v, strict=True)], strict=True):
            w[x] = new


def _sgd_pass(w: np.ndarray, labels, ids, vals, c: LogisticConfig, rate: float) -> np.ndarray:
    for y, i, v in zip(labels, ids, vals, strict=True):
        if not len(i):
            continue
        i, v = np.asarray(i), np.asarray(v)
        g = (_sigmoid(float(w[i] @ v)) - y) * v
        x = w[i]
        if c.norm == 2:
            w[i] = x - rate * (g + c.lam * x)
        else:
            g = np.where(x > 0, g + c.lam, np.where(x < 0, g - c.lam, np.where(g > c.lam, g - c.lam, np.where(g < -c.lam, g + c.lam, g))))
            new = x - rate * g
            w[i] = np.where(x * new < 0, 0.0, new)
    return w


def _loss(w: np.ndarray, labels, ids, vals) -> float:
    total = 0.0
    for y, i, v in zip(labels, ids, vals, strict=True):
        z = float(w[np.asarray(i, int)] @ np.asarray(v)) if len(i) else 0.0
        total += (z if z > 30 else 0.0 if z < -30 else np.log1p(np.exp(z))) - (z if y > 0 else 0.0)
    return total


#: Rows of a partition of distributed descent.
PASS_ROWS = 250_000


def fit_sgd(rows: DataFrame, features: DataFrame, names: DataFrame, config: LogisticConfig, mode: str = "distributed", partitions: int | None = None, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """name, w after stochastic gradient descent.

    exact: one task takes the rows in order of row_id, an epoch after the other, and stops when the loss falls by no more than
    the tolerance. distributed: each partition runs an epoch on its share from common weights, which are then averaged by the
    partitions' rows. It sums up the loss of the weights that it starts from, too, and where that fell by no more than the
    tolerance, the weights stay as they were before that epoch. The weights (one number a feature) pass through the driver, and report(epoch from 1, weights) is called
    after each epoch. Without partitions there is one for each PASS_ROWS rows.
    """
    d, c = names.count(), config

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        w, last = np.zeros(d), np.inf
        for e in range(c.epochs):
            w = _sgd_pass(w, pdf.label, pdf.ids, pdf.vals, c, c.rate / (1 + c.decay * e))
            now = _loss(w, pdf.label, pdf.ids, pdf.vals)
            if last - now <= c.tolerance:
                break
            last = now
        return pd.DataFrame({"id": np.arange(d), "w": w})

    if mode == "exact" and report is None:
        return packed(rows, features, names).groupBy(F.lit("all")).applyInPandas(exact, "id long, w double").join(names, "id").select("name", "w")
    named = lambda w: rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "id long, w double").join(names, "id").select("name", "w")
    partitions = 1 if mode == "exact" else partitions  # the same epochs, a job each, so that there are reports in between
    data = blocks(rows, features, names, partitions or _shares(rows, 8)).persist()
    w, last = np.zeros(d), np.inf
    for e in range(c.epochs):

        def epoch(batches: Iterator[pa.RecordBatch], w=w, e=e) -> Iterator[pa.RecordBatch]:
            own, n, loss = w.tolist(), 0, 0.0
            for y, sizes, ids, vals in _read(batches):
                loss += _losses(np.bincount(np.repeat(np.arange(len(y)), sizes), w[ids] * vals, len(y)), y)
                _sgd_block(own, y, sizes, ids, vals, c, c.rate / (1 + c.decay * e))
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.r_[loss, np.array(own) * n]), pa.array(np.full(d + 1, n))], names=["id", "s", "n"])

        got = {r["id"]: r for r in data.mapInArrow(epoch, "id long, s double, n long").groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        now = got.pop(-1)["s"]
        if e and last - now <= c.tolerance:
            break
        last = now if e else np.inf  # the zero weights before the first epoch don't count
        for i, r in got.items():
            w[i] = r["s"] / r["n"] if r["n"] else w[i]
        if report:
            report(e + 1, named(w))
    data.unpersist()
    return named(w)


def fit_latent(rows: DataFrame, features: DataFrame, names: DataFrame, config: LogisticConfig, partitions: int | None = None) -> DataFrame:
    """name, v (a number a hidden unit), and one row with name null for the output weights.

    Without partitions there is one for each PASS_ROWS rows. A partition takes its rows in order of row_id, an epoch from common weights,
    which are then averaged by the partitions' rows as in fit_sgd; a task holds a block of rows. With one partition that is a pass over all rows in order.
    Training ends where an epoch lowers the loss by no more than the tolerance. latent_tables keeps the inner vectors in a table.
    """
    *_, (_, w) = _latent(rows, features, names, config, partitions)
    return _layer(names, w)


def _layer(names: DataFrame, w: np.ndarray) -> DataFrame:
    ids = [*range(len(w) - 1), -1]
    out = names.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, w, strict=True)], "id long, v array<double>")
    return out.join(names, "id", "left").select("name", "v")


def _latent(rows: DataFrame, features: DataFrame, names: DataFrame, config: LogisticConfig, partitions: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(epoch, vectors by id and the output weights behind them): the start as epoch 0, and after each epoch."""
    d, c, k = names.count(), config, max(1, config.hidden)
    data = blocks(rows, features, names, partitions or _shares(rows, 1)).persist()
    rng = np.random.default_rng(c.seed)
    inner, outer = ((rng.random(shape) - 0.5) / np.sqrt(k) for shape in ((d, k), k))
    w, last = np.vstack([inner, outer]), np.inf
    yield 0, w
    for e in range(c.epochs):

        def epoch(batches: Iterator[pa.RecordBatch], w=w, e=e) -> Iterator[pa.RecordBatch]:
            own, n, loss = w.tolist(), 0, 0.0
            for y, sizes, ids, vals in _read(batches):
                row, inner = np.repeat(np.arange(len(y)), sizes), w[:-1]
                s = np.column_stack([np.bincount(row, inner[ids, j] * vals, len(y)) for j in range(k)])
                loss += _losses(1 / (1 + np.exp(-np.clip(s, -30, 30))) @ w[-1], y)
                _latent_block(own, y, sizes, ids, vals, c, c.rate / (1 + c.decay * e))
                n += len(y)
            sums = np.vstack([np.array(own) * n, [[loss] + [0.0] * (k - 1)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2)), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(np.full(d + 2, n))], names=["id", "s", "n"])

        parts = data.mapInArrow(epoch, "id long, s array<double>, n long").groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(k)]).collect()
        got = {r["id"]: r for r in parts}
        if not got or not got[0]["n"]:
            break
        now = got[d + 1]["s0"]
        if e and last - now <= c.tolerance:
            break
        last = now if e else np.inf
        w = np.array([[got[i][f"s{j}"] / got[i]["n"] for j in range(k)] for i in range(d + 1)])
        yield e + 1, w
    data.unpersist()


def _latent_block(w: list[list[float]], y: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vals: np.ndarray, c: LogisticConfig, rate: float) -> None:
    """Each row in turn moves the vectors of its features and the output weights, the last of w."""
    at, ids, vals, outer = 0, ids.tolist(), vals.tolist(), w[-1]
    units, lam = range(len(outer)), c.lam
    for label, n in zip(y.tolist(), sizes.tolist(), strict=True):
        i, v = ids[at : at + n], vals[at : at + n]
        at += n
        mine = [w[x] for x in i]
        s = []
        for j in units:
            z = 0.0
            for vec, value in zip(mine, v, strict=True):
                z += vec[j] * value
            s.append(1 / (1 + exp(-(30.0 if z > 30 else -30.0 if z < -30 else z))))
        z = sum(map(mul, s, outer))
        r = (1.0 if z > 30 else 0.0 if z < -30 else 1 / (1 + exp(-z))) - label
        back = [r * o * x * (1 - x) for o, x in zip(outer, s, strict=True)]
        new = [[a - rate * (value * b + lam * a) for a, b in zip(vec, back, strict=True)] for vec, value in zip(mine, v, strict=True)]
        for x, vec in zip(i, new, strict=True):  # of a repeated feature the last counts
            w[x] = vec
        for j in units:
            outer[j] -= rate * (r * s[j] + lam * outer[j])


def latent_epochs(rows: DataFrame, features: DataFrame, names: DataFrame, config: LogisticConfig, partitions: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(epoch from 1, model as of fit_latent) for each epoch, all from one run."""
    for epoch, w in _latent(rows, features, names, config, partitions):
        if epoch:
            yield epoch, _layer(names, w)


def _batch(data: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows (blocks) at w: partial sums by partition, then one row a feature to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss = np.zeros(len(w)), 0.0
        for y, sizes, i, v in _read(batches):
            row = np.repeat(np.arange(len(y)), sizes)
            z = np.bincount(row, w[i] * v, len(y))
            loss += _losses(z, y)
            r = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
            g += np.bincount(i, r[row] * v, len(w))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(w))), pa.array(np.concatenate([[loss], g]))], names=["id", "s"])

    sums = data.mapInArrow(part, "id long, s double").groupBy("id").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(w) + 1)
    for r in sums:
        out[r["id"] + 1] = r["s"]
    return out[0], out[1:]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, *, l1: float = 0.0, iterations: int = 50, memory: int = 5, tolerance: float = 1e-5, each: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
    """L-BFGS for a function with gradient, each(step from 1, w) after each step; with l1 > 0 OWL-QN for f + l1 * |w|_1. Backtracking (Armijo 1e-4), 30 halvings at most."""

    def whole(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, g = f(x)
        if not l1:
            return value, g, g
        at_zero = np.where(g > l1, g - l1, np.where(g < -l1, g + l1, 0.0))
        return value + l1 * np.abs(x).sum(), g, np.where(x > 0, g + l1, np.where(x < 0, g - l1, at_zero))

    value, g, sub = whole(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for number in range(1, iterations + 1):
        d, alphas = -sub, []
        for s, y in reversed(pairs):
            alphas.append((s @ d) / (y @ s))
            d = d - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (y @ s)) * s
        if l1:
            d = np.where(d * sub >= 0, 0.0, d)
        slope = float(d @ sub)
        if slope >= 0:
            break
        length = np.linalg.norm(d)
        step = 1.0 if pairs or length >= 0.125 else 1 / length
        orthant = np.where(w != 0, np.sign(w), -np.sign(sub))
        for _ in range(30):
            new = w + step * d
            if l1:
                new = np.where(new * orthant < 0, 0.0, new)
            new_value, new_g, new_sub = whole(new)
            if new_value <= value + 1e-4 * float((new - w) @ sub):
                break
            step /= 2
        else:
            break
        s, y = new - w, new_g - g
        done = abs(value - new_value) <= tolerance or y @ y < 1e-30
        if s @ y > 1e-30:
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        w, value, g, sub = new, new_value, new_g, new_sub
        if each:
            each(number, w)
        if done:
            break
    return w


def fit_batch(rows: DataFrame, features: DataFrame, names: DataFrame, *, lam: float, norm: int, iterations: int = 50, tolerance: float = 1e-5, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """name, w at the minimum of the objective: L-BFGS (norm 2) or OWL-QN (norm 1), one Spark job for each evaluation;
    report(step from 1, weights) after each step."""
    return fit_blocks(blocks(rows, features, names, _shares(rows, 8)), names, lam=lam, norm=norm, iterations=iterations, tolerance=tolerance, report=report)


def fit_blocks(data: DataFrame, names: DataFrame, *, lam: float, norm: int, iterations: int = 50, tolerance: float = 1e-5, report: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """fit_batch on blocks() or row_blocks()."""
    named = lambda w: names.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "id long, w double").join(names, "id").select("name", "w")
    data, d = data.persist(), names.count()

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = _batch(data, w)
        return (1 + loss + lam * float(w @ w), g + 2 * lam * w) if norm == 2 else (1 + loss, g)

    w = minimise(f, np.zeros(d), l1=lam if norm == 1 else 0.0, iterations=iterations, tolerance=tolerance, each=(lambda n, w: report(n, named(w))) if report else None)
    data.unpersist()
    return named(w)
