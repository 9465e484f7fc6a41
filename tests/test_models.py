"""Operators without SQL against plain versions, invariants and pyspark.ml."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions import order, scalar
from loomstat.operators import cluster, distance, embed, encode, graph, linear, metrics, series, topics, trees
from loomstat.sources import text


# --- sequences and series ----------------------------------------------------------------------------------------------


def dtw(x, y):
    d = np.full((len(x), len(y)), np.inf)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            c = (a - b) ** 2
            if i == j == 0:
                d[i, j] = c
                continue
            ways = [d[i - 1, j - 1] + c] if i and j else []
            ways += [d[i - 1, j]] * (i > 0) + [d[i, j - 1]] * (j > 0)
            d[i, j] = c + min(ways)
    return np.sqrt(d[-1, -1])


def lcss(x, y):
    if len(x) < 2 or len(y) < 2:
        return 0
    t = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1, j + 1] = t[i, j] + 1 if a == b else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_distances(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 5, rng.integers(1, 9)).tolist(), rng.integers(0, 5, rng.integers(1, 9)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x array<long>, y array<long>")
    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    got = df.select("id", distance.dtw(as_double(F.col("x")), as_double(F.col("y"))).alias("d"), distance.lcss(F.col("x"), F.col("y")).alias("l")).collect()
    for r in got:
        assert r.d == pytest.approx(dtw(*rows[r.id][1:])) and r.l == lcss(*rows[r.id][1:])
    empty = spark.createDataFrame([([], [1.0])], "x array<double>, y array<double>")
    assert empty.select(distance.dtw(F.col("x"), F.col("y"))).first()[0] == -1.0
    words = spark.createDataFrame([("", "abc"), ("kitten", "sitting")], "x string, y string")
    assert [r[0] for r in words.select(distance.edit_distance(F.col("x"), F.col("y"))).collect()] == [0, 3]


def test_viterbi_worked_example():
    labels = [0, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert series.viterbi_path(labels, 10, 5) == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert series.viterbi_path([1], 10, 5) == [0]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        labels = rng.integers(0, 2, 8).tolist()

        def value(p, labels=labels):
            return sum(np.log(3) * (a == b) for a, b in zip(p, labels)) + sum(np.log(4) * (a == b) for a, b in zip(p, p[1:]))

        best = max(value([k >> i & 1 for i in range(8)]) for k in range(256))
        assert value(series.viterbi_path(labels, 4, 3)) == pytest.approx(best)


def median(v):
    return sorted(v)[(len(v) - 1) // 2]


def split_plain(y, m, score):
    """The shared dynamic programme of both break detectors, cell by cell."""
    n = len(y)
    best, num, prev = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for s in range(2 * m, n + 1):
        for t in range(m, s - m + 1):
            v = best[t] + score(y, prev[t], t, s, num[t])
            if v > best[s]:
                best[s], num[s], prev[s] = v, num[t] + 1, t
    out, i = [], n
    while i > 0:
        i = prev[i]
        if i:
            out.append(i)
    return out[::-1]


def sse(v):
    x = np.arange(len(v))
    return float(((v - np.polyval(np.polyfit(x, v, 1), x)) ** 2).sum())


def test_break_detectors():
    rng = np.random.default_rng(2)
    for _ in range(5):
        y = np.concatenate([rng.normal(m, 1, rng.integers(8, 20)) for m in (0, 6, -3)])
        edm = lambda y, p, t, s, k: (t - p) * (s - t) / (s - p) ** 2 * (median(y[p:t]) - median(y[t:s])) ** 2 - 0.5
        assert series.edm_breaks(y, 5, 0.5, 1) == split_plain(y, 5, edm)
        lsp = lambda y, p, t, s, k: (sse(y[p:s]) - sse(y[p:t]) - sse(y[t:s])) * (t - p) * (s - t) / (s - p) ** 2 - k * 2.0
        assert series.lsp_breaks(y, 6, 2.0) == split_plain(y, 6, lsp)
    assert series.edm_breaks(np.zeros(9), 5) == [] and series.lsp_breaks(np.zeros(3), 2) == []
    y = np.r_[np.zeros(40), np.full(40, 5.0)] + rng.normal(0, 0.3, 80)
    votes = series.bcp_votes(y, window=10)
    assert abs(int(np.argmax(votes[20:])) + 20 - 40) <= 2 and series.bcp_votes(np.ones(30)).sum() == 0


def test_modl_finds_the_border_and_ignores_noise():
    values = list(range(60))
    one = [1] * 60
    clean = series.modl_splits(one, [1] * 30 + [0] * 30, [0] * 30 + [1] * 30)
    assert clean == [29]
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 2, 60)
    assert len(series.modl_splits(one, (1 - noise).tolist(), noise.tolist())) <= 2 and values


def test_loess_against_polyfit(spark):
    rng = np.random.default_rng(3)
    y = np.sin(np.arange(40) / 5) + rng.normal(0, 0.1, 40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, idx int, y double")
    got = {r.idx: r.fit for r in series.loess(df, "k", 11).collect()}
    for i in range(40):
        st = max(0, min(i - 5, 40 - 11))
        x = np.arange(st, st + 11)
        w = (1 - (np.abs(x - i) / max(i - st, st + 10 - i)) ** 3) ** 3
        assert got[i] == pytest.approx(np.polyval(np.polyfit(x - i, y[x], 2, w=np.sqrt(np.maximum(w, 0))), 0), abs=1e-6)
    y[20] += 50
    spiky = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, idx int, y double")
    plain = {r.idx: r.fit for r in series.loess(spiky, "k", 11).collect()}
    robust = {r.idx: r.fit for r in series.loess(spiky, "k", 11, robust=2).collect()}
    assert abs(robust[20] - np.sin(4)) < abs(plain[20] - np.sin(4)) / 5
    assert {r.fit for r in series.loess(df, "k", 5).collect()} == {float(v) for v in df.toPandas().y}


def test_patterns_do_not_overlap(spark):
    rng = np.random.default_rng(4)
    shape = np.sin(np.arange(10))
    rows = [(i, (np.r_[rng.normal(0, 1, 20), shape * 3, rng.normal(0, 1, 15), shape * 5]).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "row int, y array<double>")
    got = series.patterns(df, "row", 10, 10, seed=1).toPandas()
    assert got.groupby("cluster").size().min() >= 2
    for _, g in got.groupby("row"):
        for c in g.cluster.unique():
            mine, others = g[g.cluster == c]["at"].to_numpy(), g[g.cluster != c]["at"].to_numpy()
            assert all(abs(a - b) >= 10 for a in mine for b in others)


def test_moves_go_on_until_no_node_gains(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(rng.choice(16, 2, replace=False).tolist())) for _ in range(30)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src int, dst int, w double")
    comm = graph._sweeps_joined(edges, graph.RESOLUTION)
    assert graph._wishes(edges, comm, graph.RESOLUTION).isEmpty()


def test_distributed_descent_stops_by_the_tolerance(spark, sparse):
    rows, feats, names, _, _ = sparse
    base = linear.LogisticConfig(rate=0.1, epochs=12, norm=2, lam=0.0, tolerance=0.0)
    seen: dict = {}
    linear.fit_sgd(rows, feats, names, base, partitions=2, report=lambda e, w: seen.__setitem__(e, {r["name"]: r["w"] for r in w.collect()}))
    scored = {e: linear.linear_scores(rows, feats, spark.createDataFrame([*w.items()], "name string, w double")) for e, w in seen.items()}
    loss = {e: s.agg(metrics.logistic_loss(F.col("z"), F.col("label")).alias("l")).first()["l"] for e, s in scored.items()}
    falls = {e: loss[e - 1] - loss[e] for e in loss if e > 1}
    tolerance = (falls[3] + falls[4]) / 2
    stop = next(e for e in sorted(falls) if falls[e] <= tolerance)
    got = {r["name"]: r["w"] for r in linear.fit_sgd(rows, feats, names, replace(base, tolerance=tolerance), partitions=2).collect()}
    assert stop < 12 and got == pytest.approx(seen[stop])


def in_turn(members: list[tuple], length: int) -> dict:
    """Kept windows by bucket: buckets one after another in order of first appearance."""
    groups: dict = {}
    for bucket, key, at in sorted(members, key=lambda m: m[1:]):
        groups.setdefault(bucket, []).append((key, at))
    taken, kept = [], {}
    for bucket, own in groups.items():
        free = [(k, a) for k, a in own if all(k != o or abs(a - p) >= length for o, p in taken)]
        if len(free) >= 2:
            kept[bucket] = free
            taken += free
    return kept


def test_overlaps_are_decided_in_rounds_as_in_turn(spark):
    rng, members = np.random.default_rng(8), []
    for key in range(5):
        last: dict = {}
        for at in range(60):
            bucket = int(rng.integers(18))
            if rng.random() < 0.6 and at - last.get(bucket, -9) >= 5:
                last[bucket] = at
                members.append((bucket, key, at))
    df = spark.createDataFrame(members, "bucket int, row int, at int")
    got: dict = {}
    for r in series.without_overlaps(df.repartition(3), "row", 5).collect():
        got.setdefault(r["bucket"], []).append((r["row"], r["at"]))
    assert {b: sorted(w) for b, w in got.items()} == in_turn(members, 5)
    assert series.without_overlaps(df.limit(0), "row", 5).isEmpty()


# --- models ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, label double").persist()
    feats = spark.createDataFrame([(i, j, f"f{j}", float(x[i, j])) for i in range(300) for j in range(3)], "row_id long, pos int, name string, value double").persist()
    names = spark.createDataFrame([(f"f{j}", j) for j in range(3)], "name string, id long")
    return rows, feats, names, x, y


def test_batch_fits_meet_pyspark_ml(spark, sparse):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows, feats, names, x, y = sparse
    ml = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    for norm, lam, reg, mix in ((2, 2.0, 2 * 2.0 / 300, 0.0), (1, 10.0, 10.0 / 300, 1.0)):
        w = {r["name"]: r["w"] for r in linear.fit_batch(rows, feats, names, lam=lam, norm=norm, iterations=100, tolerance=1e-9).collect()}
        model = LogisticRegression(fitIntercept=False, standardization=False, regParam=reg, elasticNetParam=mix, tol=1e-10, maxIter=300).fit(ml)
        assert np.allclose([w[f"f{j}"] for j in range(3)], model.coefficients.toArray(), atol=2e-3)


def test_stochastic_fits_lower_the_loss(spark, sparse):
    rows, feats, names, x, y = sparse
    auc = lambda w: metrics.auc(linear.linear_scores(rows, feats, w), "z", "label").first()["auc"]
    best = auc(linear.fit_batch(rows, feats, names, lam=0.0, norm=2))
    c = linear.LogisticConfig(rate=0.05, epochs=5, norm=2, lam=1e-3)
    for mode in ("exact", "distributed"):
        assert auc(linear.fit_sgd(rows, feats, names, c, mode=mode, partitions=2)) > best - 0.01
    latent = {r["name"]: r["v"] for r in linear.fit_latent(rows, feats, names, linear.LogisticConfig(rate=0.1, epochs=10, hidden=2, norm=2)).collect()}
    inner = spark.createDataFrame([(k, v) for k, v in latent.items() if k], "name string, v array<double>")
    z = linear.latent_forward(rows, feats, inner, latent[None])
    assert metrics.auc(z, "z", "label").first()["auc"] > best - 0.02


def test_tree_splits_are_the_best(spark, sparse):
    rows, feats, names, x, y = sparse
    gh = rows.select("row_id", (0.5 - F.col("label")).alias("g"), F.lit(0.25).alias("h"))
    tree = trees.grow(gh, feats, leaves=3, depth=2, wr=1.0, nr=0.0, min_rows=5)
    g, best = 0.5 - y, (-1, None, None)
    loss = lambda m: -(g[m].sum() ** 2) / (2 * (0.25 * m.sum() + 1))
    for j in range(3):
        v = np.unique(x[:, j])
        for cut in (v[1:] + v[:-1]) / 2:
            m = x[:, j] >= cut
            if m.sum() >= 5 and (~m).sum() >= 5:
                best = max(best, (loss(np.ones(300, bool)) - loss(m) - loss(~m), f"f{j}", cut))
    table = tree.rows()
    assert (table[0][3], table[0][4]) == (best[1], pytest.approx(best[2])) and sum(t[2] for t in table) == 3
    assert sum(t[1] for t in table if t[2]) == 300


def test_boosting_learns_and_scores_alike(spark, sparse):
    rows, feats, *_ = sparse
    c = trees.BoostConfig(rate=0.5, trees=3, leaves=4, depth=3, weight_cost=1.0)
    found, scores = trees.boost_binary(rows, feats, c)
    assert metrics.auc(scores, "f", "label").first()["auc"] > 0.85
    again = trees.score_trees(rows, feats, found, 0.5)
    assert again.join(scores, "row_id").where("abs(score - f) > 1e-9").isEmpty()
    _, ranked = trees.boost_rank(rows, feats, c)
    assert metrics.auc(ranked, "f", "label").first()["auc"] > 0.8
    warm = scores.select("row_id", F.col("f").alias("score"))
    assert trees.boost_binary(rows, feats, trees.BoostConfig(rate=0.5, trees=0), warm)[1].where("f = 0").count() < 300


def test_multiclass_on_separable_rows(spark):
    names = ["B", "A", "C"]
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "row_id long, label double")
    feats = spark.createDataFrame([(i, 0, names[i % 3], 1.0) for i in range(60)], "row_id long, pos int, name string, value double")
    found, scores = trees.boost_multiclass(rows, feats, trees.BoostConfig(rate=0.5, trees=2, leaves=3, depth=2, binary=True))
    best = scores.groupBy("row_id", "label").agg(F.max_by("cls", "f").alias("c"))
    assert best.where("label <> c").isEmpty() and {c for c, _ in found} == {0, 1, 2}
    p = metrics.softmax(scores, "row_id", "f")
    assert metrics.multiclass_loss(p, "p", "cls", "label").first()["loss"] < 60 * np.log(3)
    assert metrics.multiclass_auc(p, "p", "cls", "label").first()["auc"] == 1.0


def test_kmeans(spark):
    rng = np.random.default_rng(6)
    base = np.eye(4)[rng.integers(0, 3, 200)]
    v = base + rng.normal(0, 0.05, (200, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)] + [(999, [0.0, 0.0, 0.0, 1.0])], "row_id long, v array<double>")
    got, centers = cluster.kmeans(df, "v", 3, min_potential=5.0, seed=3)
    labels = got.where("row_id < 900").toPandas().sort_values("row_id").cls.to_numpy()
    assert len(set(zip(labels.tolist(), base.argmax(1).tolist()))) == 3 and got.where("row_id = 999").first()["cls"] == -1
    assert all(abs(np.linalg.norm(c) - 1) < 1e-9 for c in centers)
    assert len(cluster.kmeans(df, "v", 8)[1]) == 1  # the potential never passes the default bound


def test_gaussian_clusters(spark):
    rng = np.random.default_rng(7)
    pts = np.r_[rng.normal(0, 1, (150, 2)), rng.normal(12, 1, (150, 2))]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "row_id long, x double, y double")
    got, stats = cluster.gaussian_clusters(df, 2)
    by = got.toPandas().sort_values("row_id").cls
    assert by[:150].nunique() == 1 and by[150:].nunique() == 1 and sum(s["n"] for s in stats) == 300


@pytest.mark.parametrize("mode", ["exact", "distributed"])
def test_louvain_finds_cliques(spark, mode):
    links = [(a + 10 * c, b + 10 * c, 1.0) for c in range(3) for a in range(5) for b in range(a)] + [(0, 10, 0.1), (10, 20, 0.1)]
    edges = graph.symmetric(spark.createDataFrame(links, "src long, dst long, w double"))
    comm = graph.louvain(edges, mode=mode)
    assert {(r["node"], r["comm"]) for r in comm.collect()} == {(a + 10 * c, 10 * c) for c in range(3) for a in range(5)}
    alone = comm.select("node", F.col("node").alias("comm"))
    assert graph.modularity(edges, comm).first()[0] > graph.modularity(edges, alone).first()[0]


def corpus(spark):
    rng = np.random.default_rng(8)
    rows = [(f"d{d}", p, f"{'ab'[d % 2]}{rng.integers(0, 6)}", f"l{d % 3}", float(d % 2 * 9 + rng.normal()), float(rng.normal())) for d in range(30) for p in range(20)]
    return spark.createDataFrame(rows, "doc string, pos long, word string, local string, px double, py double")


@pytest.mark.parametrize("mode", ["exact", "distributed"])
def test_lda_parts_words(spark, mode):
    t = corpus(spark)
    c = topics.TopicConfig(topics=2, sweeps=30 if mode == "exact" else 15, alpha=0.1, beta=0.1, seed=1)
    got = topics.lda(t, c, mode)
    assert got.count() == 600 and got.where("topic NOT BETWEEN 1 AND 2").isEmpty()
    pdf = got.toPandas()
    purity = pdf.assign(side=pdf.word.str[0]).groupby(["side", "topic"]).size().unstack(fill_value=0)
    assert purity.max(axis=1).sum() / 600 > 0.85
    again = topics.lda(t, c, mode).toPandas().sort_values(["doc", "pos"]).topic.tolist()
    assert again == pdf.sort_values(["doc", "pos"]).topic.tolist()


def test_other_topic_models_keep_tokens(spark):
    t = corpus(spark)
    a = topics.local_lda(t, topics.LocalConfig(topics=2, sweeps=3)).toPandas()
    assert len(a) == 600 and ((a.x == 1) == (a.topic == -1)).all() and a[a.x == 0].topic.between(1, 2).all()
    b = topics.region_lda(t, topics.RegionConfig(topics=2, regions=3, sweeps=3, least=5)).toPandas()
    assert len(b) == 600 and b[b.x == 1].t.between(0, 2).all() and b[b.x == 0].t.between(0, 1).all()


def test_huffman_is_optimal():
    import heapq

    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 40):
        counts = sorted(rng.integers(1, 100, n).tolist(), reverse=True)
        paths, codes = embed.huffman(counts)
        assert len({tuple(c) for c in codes}) == n
        if n > 1:
            assert sum(2.0 ** -len(c) for c in codes) == 1.0
            heap, total = list(counts), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                s = heapq.heappop(heap) + heapq.heappop(heap)
                total += s
                heapq.heappush(heap, s)
            assert sum(c * len(k) for c, k in zip(counts, codes)) == total
            assert all(p[0] == n - 2 and len(p) == len(c) for p, c in zip(paths, codes))


def test_vectors_and_network_learn(spark):
    t = corpus(spark).select(F.col("doc").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("word").alias("token"))
    c = embed.VectorConfig(size=6, epochs=30, rate=0.1, partitions=2)
    words, inner = embed.word_vectors(t, c)
    v = {r["token"]: np.array(r["vec"]) for r in words.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    same = np.mean([cos(v[f"a{i}"], v[f"a{j}"]) for i in range(6) for j in range(i)])
    cross = np.mean([cos(v[f"a{i}"], v[f"b{j}"]) for i in range(6) for j in range(6)])
    assert same > cross + 0.3
    assert embed.document_vectors(t, words, inner, c).count() == 30
    together, inner = embed.train_documents(t, embed.VectorConfig(size=6, epochs=20, rate=0.1, partitions=2))
    d = {r["doc_id"]: np.array(r["vec"]) for r in together.collect()}
    assert len(d) == 30 and cos(d["d0"], d["d2"]) > cos(d["d0"], d["d1"]) + 0.3
    net = embed.rnn(t, embed.VectorConfig(size=6, epochs=6, rate=0.1)).where("part = 'loss'").orderBy("id").collect()
    assert net[-1]["vec"][0] < net[0]["vec"][0]
    with pytest.raises(ValueError):
        embed.VectorConfig(window=1)


# --- sources, encoding, scalars, order ---------------------------------------------------------------------------------


def write(tmp_path, name, *lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_text_sources(spark, tmp_path):
    rows, feats = text.read_sparse(spark, write(tmp_path, "v", "1\tA\t2.5\tB\tx", "0\tC\t-1e1", "", "bad"), binary=False)
    assert [(r["label"]) for r in rows.orderBy("row_id").collect()] == [1.0, 0.0, 0.0]
    assert [(r["pos"], r["name"], r["value"]) for r in feats.orderBy("row_id", "pos").collect()] == [(0, "A", 2.5), (1, "B", 0.0), (0, "C", -10.0)]
    rows, feats = text.read_sparse(spark, write(tmp_path, "b", "2\t2\tA\tB"), binary=True, counted=True)
    assert rows.first()["label"] == 2.0 and [r["name"] for r in feats.orderBy("pos").collect()] == ["A", "B"]
    assert text.read_tokens(spark, write(tmp_path, "t", "A\tB", "C")).count() == 3
    assert text.read_edges(spark, write(tmp_path, "e", "a\tb\t2", "b\tc\t1.5")).count() == 4
    assert text.read_points(spark, write(tmp_path, "p", "1\t2")).first()["y"] == 2.0
    assert text.read_matrix(spark, write(tmp_path, "m", "1 2  3"), 3).first()["v"] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="expected 2 numbers"):
        text.read_matrix(spark, str(tmp_path / "m"), 2).collect()
    assert text.read_topic_tokens(spark, write(tmp_path, "z", "d\tw\t3", "d\tv")).where("topic IS NULL").count() == 1
    assert text.read_region_tokens(spark, write(tmp_path, "r", "d\tw\t1.5\t2")).first()["px"] == 1.5
    assert text.read_local_tokens(spark, write(tmp_path, "l", "d\tq\tw\t1")).first()["x"] == 1
    assert text.read_scores(spark, write(tmp_path, "s", "0.25")).first()["score"] == 0.25


def test_tree_text_round_trip(spark, tmp_path):
    table = [(0, 9, 0, "qty", 24.5, 0.0, 0.5, 1, 2), (1, 5, 1, "", 0.0, 0.5, 0.0, -1, -1), (2, 4, 1, "", 0.0, -0.25, 0.0, -1, -1)]
    lines = ["n\tleaf\tAttr\taval\tNode_wei\tNode_loss\tleft\tright"] + [f"{t[0]}\t{t[2]}\t{t[3]}\t{t[4]}\t{t[5]}\t{t[6]}\t{t[7]}\t{t[8]}" for t in table]
    got = text.read_tree(spark, write(tmp_path, "tree", *lines)).orderBy("idx").collect()
    assert [(r["idx"], r["leaf"], r["aval"], r["left"]) for r in got] == [(0, 0, 24.5, 1), (1, 1, 0.0, -1), (2, 1, 0.0, -1)]
    text.write_tsv(spark.createDataFrame([("a", 0.5)], "name string, w double"), str(tmp_path / "coe"), {"name": "%s", "w": "%.10f"})
    assert spark.read.text(str(tmp_path / "coe")).first()[0] == "a\t0.5000000000"


def test_dictionary(spark):
    t = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "token string, at long")
    d = encode.first_appearance(t, "token", "at")
    assert {(r["token"], r["id"], r["n"]) for r in d.collect()} == {("b", 0, 2), ("a", 1, 1), ("c", 2, 1)}
    left = encode.forget(d, spark.createDataFrame([("a",)], "token string"), "token")
    assert {r["id"] for r in left.collect()} == {0, 2}
    assert encode.encode(t, left, "token").count() == 3


def test_scalars(spark):
    df = spark.createDataFrame([(" \t a b\n", "12.5x", 40.0)], "s string, n string, z double")
    r = df.select(scalar.trim(F.col("s")), scalar.trim(F.col("s"), right=False), scalar.to_double(F.col("n")), scalar.sigmoid(F.col("z")), scalar.softplus(F.col("z")), scalar.boosted_sigmoid(-F.col("z")), scalar.split_keep_empty(F.lit("a,,b;"), ",;")).first()
    assert tuple(r) == ("a b", "a b\n", 12.5, 1.0, 40.0, 1e-5, ["a", "", "b", ""])
    pairs = spark.createDataFrame([(0.0, 0.5), (0.0, 3.0), (0.0, -3.0), (2.0, 0.5), (-2.0, 0.5)], "w double, g double")
    inside, zero = ([x[0] for x in pairs.select(scalar.l1_subgradient(F.col("w"), F.col("g"), 1.0, z)).collect()] for z in (False, True))
    assert inside == [0.5, 2.0, -2.0, 1.5, -0.5] and zero == [0.0, 2.0, -2.0, 1.5, -0.5]


def test_order_over_buckets(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, v int").repartition(7)
    got = {r["i"]: r["n"] for r in order.numbered(df, "v", [F.col("i")], "n", buckets=9).collect()}
    want = {int(i): k for k, i in enumerate(np.lexsort((np.arange(500), v)))}
    assert got == want
    ranks = metrics.tied_ranks(df, "v", buckets=5).toPandas().set_index("i")["rank"]
    assert np.allclose(ranks.sort_index(), pd.Series(v).rank())


def test_auc_without_both_classes(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.auc(df, "s", "y").first()["auc"] is None


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    """Dense numbers in file order, whatever the splits: start scores meet their rows, and a missing one is an error."""
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        (folder / f"part-{f}").write_text("".join(f"{i % 2}\tf{f}_{i}\n" + "\n" * (i % 7 == 0) for i in range(2000 * (3 - f))))
    scores = write(tmp_path, "scores", *[str(i) for i in range(12000)])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        rows, feats = text.read_sparse(spark, str(folder), binary=True)
        assert rows.rdd.getNumPartitions() > 3
        got = [r["name"] for r in feats.orderBy("row_id").collect()]
        assert got == [f"f{f}_{i}" for f in range(3) for i in range(2000 * (3 - f))]
        assert [r["row_id"] for r in rows.orderBy("row_id").collect()] == list(range(12000))
        init = text.read_scores(spark, scores)
        start = trees._start(rows, init, ["row_id"])
        assert start.where("f <> row_id").count() == 0 and start.count() == 12000
        with pytest.raises(ValueError, match="1 of 12000"):
            trees._start(rows, init.where("row_id <> 7"), ["row_id"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    with pytest.raises(Exception, match="has changed since"):
        rows.where("row_id >= 0").collect()


def test_reports_after_each_tree_and_start_scores(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "row_id long, label double")
    feats = spark.createDataFrame([(i, 0, f"c{i % 3}", 1.0) for i in range(60)], "row_id long, pos int, name string, value double")
    seen = []
    config = trees.BoostConfig(rate=0.5, trees=2, leaves=3, depth=2, binary=True)
    _, scores = trees.boost_multiclass(rows, feats, config, test=(rows, feats), report=lambda n, name, s: seen.append((n, name, s.count())))
    assert seen == [(n, name, 180) for n in (1, 2) for name in ("train", "test")]
    init = scores.select("row_id", "cls", F.col("f").alias("score"))
    _, more = trees.boost_multiclass(rows, feats, trees.BoostConfig(rate=0.5, trees=1, leaves=3, depth=2, binary=True), init=init)
    hit = lambda s: s.where("cls = label").agg(F.avg("f")).first()[0]
    assert hit(more) > hit(scores)
    two = rows.withColumn("label", (F.col("label") > 0).cast("double"))
    seen.clear()
    trees.boost_binary(two, feats, config, test=(two, feats), report=lambda n, name, s: seen.append((n, name, s.columns)))
    assert seen[0] == (1, "train", ["row_id", "label", "f"]) and seen[1][1] == "test"


def test_sibling_sums_and_ranges_of_values_give_the_same_splits(spark):
    rng = np.random.default_rng(12)
    rows = [(i, int(i % 3 == 0), float(rng.normal()), 1.0) for i in range(240)]
    feats = [(i, n, float(rng.integers(0, 40)) / 4) for i in range(240) for n in ("a", "b", "c") if rng.random() < 0.8]
    gh, f = spark.createDataFrame(rows, "row_id long, node int, g double, h double"), spark.createDataFrame(feats, "row_id long, name string, value double")
    options = {"wr": 0.5, "nr": 0.0, "min_rows": 5}
    plain = sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in trees.split_candidates(gh, f, **options).collect())
    whole, one = trees.value_sums(gh.withColumn("node", F.lit(9)), f), trees.value_sums(gh.where("node = 1"), f)
    sums = trees.sibling_sums(whole, one, 0).unionByName(one)
    for buckets in (1, 4):
        got = trees.candidates(sums, trees.node_stats(gh, 0.5, 0.0), buckets=buckets, **options).collect()
        assert sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in got) == plain
