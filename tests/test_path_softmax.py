import numpy as np
from pyspark.sql import functions as F

from loomstat.operators import embed, path_softmax


def corpus(spark, docs=40, seed=3):
    """Two themes whose words don't mix."""
    rng = np.random.default_rng(seed)
    rows = [(d, p, f"{'ab'[d % 2]}{min(int(rng.zipf(1.6)), 9)}") for d in range(docs) for p in range(15)]
    return spark.createDataFrame([*rows, (900, 0, "a1")], "doc_id long, pos int, token string")


def coded(spark):
    tokens = corpus(spark)
    vocab = embed.vocabulary(tokens)
    table = embed.huffman_codes(vocab)
    return tokens.join(vocab.select("token", "id"), "token").select("doc_id", "pos", "id"), path_softmax.paths(table), table.orderBy("id").collect()


def test_step_matches_the_plain_gradient(spark):
    tokens, codes, table = coded(spark)
    c = path_softmax.PathConfig(size=5)
    vectors, inner = path_softmax.start(codes, c), path_softmax.start_inner(codes, 5)
    inner = inner.withColumn("vec", F.array(*[(F.pmod(F.col("node") * 5 + j, F.lit(7)) - 3) / 10.0 for j in range(5)]))
    v = {r.id: np.array(r.vec) for r in vectors.collect()}
    w = {r.node: np.array(r.vec) for r in inner.collect()}
    docs = {}
    for r in tokens.collect():
        docs.setdefault(r.doc_id, {})[r.pos] = r.id
    gv, gw, total, n = {}, {}, 0.0, 0
    for doc in docs.values():
        ids = [doc[p] for p in range(len(doc))]
        for i, own in enumerate(ids):
            lo = max(0, min(i - 2, len(ids) - 5))
            near = ids[lo:i] + ids[i + 1 : lo + 5]
            if not near:
                continue
            h, e = np.mean([v[x] for x in near], 0), np.zeros(5)
            for node, code in zip(table[own].path, table[own].code):
                sign = 1 - 2 * code
                p = 1 / (1 + np.exp(-sign * (w[node] @ h)))
                total -= np.log(p)
                e += (1 - p) * sign * w[node]
                gw[node] = gw.get(node, 0) + (1 - p) * sign * h
            for x in near:
                gv[x] = gv.get(x, 0) + e
            n += 1
    loss, new_v, new_w = path_softmax.step(tokens, codes, vectors, inner, window=5, rate=0.3, size=5)
    got = loss.first()
    assert got.n == n and np.isclose(got.loss, total)
    for old, grads, new, key in ((v, gv, new_v, "id"), (w, gw, new_w, "node")):
        for r in new.collect():
            g = grads[r[key]]
            assert np.allclose(r.vec, old[r[key]] + 0.3 * g / np.sqrt(g @ g / 5 + 1e-12)) and np.isclose(r.acc, g @ g / 5)
    kept = path_softmax.step(tokens, codes, vectors, inner, window=5, rate=0.3, size=5, fixed=True)[2]
    assert {r.node: tuple(r.vec) for r in kept.collect()} == {k: tuple(x) for k, x in w.items()}


def test_training_lowers_the_loss(spark):
    tokens, codes, _ = coded(spark)
    c = path_softmax.PathConfig(size=6, epochs=3, steps=2, rate=0.3)
    vectors, inner, losses = path_softmax.train(tokens, codes, c)
    got = [r.loss / r.n for r in losses.orderBy("epoch").collect()]
    assert got[-1] < 0.85 * got[0]
    vec = {r.id: np.array(r.vec) for r in vectors.collect()}
    assert len(vec) == codes.count() and inner.count() == codes.count() - 1
    more = path_softmax.train(tokens, codes, path_softmax.PathConfig(size=6, epochs=1, steps=1, rate=0.3), vectors=vectors, inner=inner)[2].first()
    assert more.loss / more.n < got[0]


def test_nothing_to_learn_from(spark):
    tokens, codes, _ = coded(spark)
    vectors, inner, losses = path_softmax.train(tokens.limit(0), codes, path_softmax.PathConfig(size=3, epochs=1, steps=1))
    assert losses.first().loss == 0.0 and vectors.count() == codes.count() and vectors.where("acc > 0").isEmpty()
