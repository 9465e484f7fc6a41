import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import latent_tables, linear, metrics


def data(spark, n=200, seed=5):
    """Labels by the exclusive or of two features, which a layer finds and one line doesn't; f9 is not among the names."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([*[(i, float(v)) for i, v in enumerate(y)], (n, 1.0)], "row_id long, label double")  # the last has no features
    values = [(i, j, f"f{j}", float(x[i, j])) for i in range(n) for j in range(3)]
    features = spark.createDataFrame([*values, (0, 3, "f0", 0.5), (1, 3, "f9", 2.0)], "row_id long, pos int, name string, value double")
    x[0, 0] += 0.5
    names = spark.createDataFrame([(f"f{j}", j) for j in range(4)], "name string, id long")
    return rows, features, names, np.vstack([x, np.zeros(3)]), np.append(y, 1.0)


def loss_of(z, y):
    return float(np.sum(np.logaddexp(0, z) - y * z))


def test_step_matches_the_plain_gradient(spark):
    rows, features, names, x, y = data(spark)
    c, lam = linear.LogisticConfig(rate=0.2, hidden=2), 0.01
    layer = latent_tables.start(names, c)
    old = {r.name: np.array(r.vec) for r in layer.inner.collect()}
    v, w = np.array([old[f"f{j}"] for j in range(3)]), layer.outer
    s = 1 / (1 + np.exp(-x @ v))
    r = y - 1 / (1 + np.exp(-s @ w))
    uses = np.array([201, 200, 200])[:, None]  # the entry twice in row 0 is two uses
    gv = x.T @ (r[:, None] * w * s * (1 - s)) - lam * uses * v
    gw = s.T @ r - lam * len(y) * w
    loss, n, new = latent_tables.step(rows, features, layer, rate=0.2, lam=lam)
    assert n == 201 and np.isclose(loss, loss_of(s @ w, y))
    got = {q.name: q for q in new.inner.collect()}
    for j in range(3):
        assert np.allclose(got[f"f{j}"].vec, v[j] + 0.2 * gv[j] / np.sqrt(gv[j] @ gv[j] / 2 + 1e-12))
    assert np.allclose(got["f3"].vec, old["f3"]) and set(got) == {"f0", "f1", "f2", "f3"}  # in no row
    assert np.allclose(new.outer, w + 0.2 * gw / np.sqrt(gw @ gw / 2 + 1e-12)) and np.isclose(new.acc, gw @ gw / 2)


def test_loss_within_two_percent_of_one_task(spark):
    rows, features, names, x, y = data(spark)
    exact = {r["name"]: r["v"] for r in linear.fit_latent(rows, features, names, linear.LogisticConfig(rate=0.1, epochs=4, hidden=2, norm=2)).collect()}
    inner = spark.createDataFrame([(k, v) for k, v in exact.items() if k], "name string, v array<double>")
    of = lambda t: t.agg(metrics.logistic_loss(F.col("z"), F.col("label"))).first()[0]
    told = []
    layer, losses = latent_tables.train(rows, features, names, linear.LogisticConfig(rate=1.0, epochs=5, hidden=2), steps=1, report=lambda n, at: told.append((n, at.outer.tolist())))
    now = of(latent_tables.forward(rows, features, layer))
    assert now <= 1.02 * of(linear.latent_forward(rows, features, inner, exact[None]))
    assert losses[-1] < losses[0] and [n for n, _ in told] == list(range(1, len(losses) + 1)) and told[-1][1] == layer.outer.tolist()
    more, later = latent_tables.train(rows, features, names, linear.LogisticConfig(rate=1.0, epochs=1, hidden=2), steps=2, layer=layer)
    assert later[0] < losses[0] and more.acc > layer.acc


def test_epochs_in_one_task(spark):
    rows, features, names, x, y = data(spark, 60)
    c = linear.LogisticConfig(rate=0.1, epochs=3, hidden=2, tolerance=-1e9)
    rng = np.random.default_rng(c.seed)
    v, w = ((rng.random(shape) - 0.5) / np.sqrt(2) for shape in ((4, 2), 2))
    plain = []
    order = [*range(60), 60]
    for _ in range(3):
        for i in order:
            at = [0, 1, 2, 0] if i == 0 else [0, 1, 2] if i < 60 else []
            value = np.array([x[0, 0] - 0.5, x[0, 1], x[0, 2], 0.5] if i == 0 else x[i] if i < 60 else [])
            s = 1 / (1 + np.exp(-value @ v[at]))
            r = 1 / (1 + np.exp(-s @ w)) - y[i]
            v[at] -= 0.1 * np.outer(value, r * w * s * (1 - s))
            w -= 0.1 * r * s
        plain.append((v.copy(), w.copy()))
    for (n, part), (v, w) in zip(linear.latent_epochs(rows, features, names, c), plain, strict=True):
        got = {r["name"]: r["v"] for r in part.collect()}
        assert np.allclose(got[None], w) and np.allclose([got[f"f{j}"] for j in range(4)], v)
    assert n == 3
    last = {r["name"]: r["v"] for r in linear.fit_latent(rows, features, names, c).collect()}
    assert last == got


def test_stops_by_the_tolerance_and_takes_empty_tables(spark):
    rows, features, names, *_ = data(spark)
    c = linear.LogisticConfig(rate=0.5, epochs=5, hidden=2, tolerance=1e9)
    assert len(latent_tables.train(rows, features, names, c, steps=1)[1]) == 2
    layer, losses = latent_tables.train(rows.limit(0), features.limit(0), names, c, steps=1)
    assert losses == [0.0, 0.0] and layer.inner.count() == 4 and layer.acc == 0.0
    idle = latent_tables.forward(rows.where("row_id = 200"), features, layer).first()
    assert idle.s == [0.5, 0.5] and np.isclose(idle.z, layer.outer.sum() / 2)
    with pytest.raises(ValueError):
        latent_tables.train(rows, features, names, c, steps=0)
