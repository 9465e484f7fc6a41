import numpy as np
import pytest

from loomstat.operators import embed, series
from loomstat.sources import models
from loomstat.streaming import changepoint


def test_stream_finds_the_change(spark, tmp_path):
    rng = np.random.default_rng(0)
    y = np.r_[rng.normal(-1, 0.1, 40), rng.normal(1, 0.1, 40)]
    src = str(tmp_path / "in")
    for part, (a, b) in enumerate(((0, 30), (30, 80))):
        spark.createDataFrame([(s, i, float(y[i])) for s in (1, 2) for i in range(a, b)], "series_id long, idx long, y double").coalesce(1).write.mode("append").parquet(src)
        assert part >= 0
    stream = spark.readStream.schema("series_id long, idx long, y double").option("maxFilesPerTrigger", 1).parquet(src)
    q = changepoint.detect(stream).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM runs WHERE series_id = 1").toPandas().sort_values("idx").reset_index(drop=True)
    assert len(got) == 80 and got.run_length[38] >= 30 and got.run_length[60] <= 25


def test_filter_agrees_with_batch():
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    s, z = changepoint.start(), (x - x.mean()) / x.std(ddof=1)
    lengths = [0] + [changepoint.step(s, float(v), 500.0, 1000)[0] for v in z][:-1]
    votes = np.zeros(30, int)
    for t in range(9, 30):
        starts = [u - lengths[u] + 1 for u in range(t - 9, t + 1)]
        values, counts = np.unique(starts, return_counts=True)
        top = values[counts == counts.max()]
        votes[top[top < 30]] += 1
    assert votes.tolist() == series.bcp_votes(x, window=10).tolist()


def test_models_round_trip(spark, tmp_path):
    w = spark.createDataFrame([("a", 0.25), ("b", -1.5)], "name string, w double")
    models.save_coefficients(w, str(tmp_path / "coe"))
    assert sorted(map(tuple, models.load_coefficients(spark, str(tmp_path / "coe")).collect())) == [("a", 0.25), ("b", -1.5)]
    v = spark.createDataFrame([("x", [0.5, -0.125])], "token string, vec array<double>")
    models.save_vectors(v, str(tmp_path / "vec"))
    assert models.load_vectors(spark, str(tmp_path / "vec")).first()["vec"] == [0.5, -0.125]
    tree = [(0, 9, 0, "q", 2.5, 0.0, 0.5, 1, 2), (1, 5, 1, None, None, 0.5, 0.0, -1, -1), (2, 4, 1, None, None, -0.25, 0.0, -1, -1)]
    models.save_trees([tree, tree], spark, str(tmp_path / "trees"))
    assert models.load_trees(spark, str(tmp_path / "trees")) == [tree, tree]
    models.save_tree_text(tree, spark, str(tmp_path / "text"))
    from loomstat.sources.text import read_tree

    assert [r["leaf"] for r in read_tree(spark, str(tmp_path / "text")).orderBy("idx").collect()] == [0, 1, 1]
    got = spark.createDataFrame([(1, 0, 0.5)], "row_id long, cls int, dist double")
    models.save_clusters(got, [[1.0, 0.0]], str(tmp_path / "cl"))
    assert models.load_vectors(spark, str(tmp_path / "cl/cents")).first()["token"] == "cluster_0000"
    t = spark.createDataFrame([("d", "w", 1), ("d", "v", 2)], "doc string, word string, topic int")
    models.save_topics(t, 2, str(tmp_path / "tp"))
    assert spark.read.parquet(str(tmp_path / "tp/doc_topic")).first()["2"] == 1

def test_document_vectors_continue_with_one_side_fixed(spark):
    rows = [(d, p, t) for d in range(12) for p, t in enumerate(("a", "b", "c", "a") if d % 2 else ("x", "y", "z", "x"))]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string")
    c = embed.VectorConfig(epochs=3, size=6, rate=0.2)
    vocab = embed.vocabulary(tokens)
    vecs, inner = embed.train_documents(tokens, c)
    before = {r.doc_id: r.vec for r in vecs.collect()}
    moved, same = embed.train_documents(tokens, c, vocab=vocab, start=vecs, inner=inner, fixed="inner")
    assert (same == inner).all() and {r.doc_id: r.vec for r in moved.collect()} != before
    still, other = embed.train_documents(tokens, c, vocab=vocab, start=vecs, inner=inner, fixed="documents")
    assert {r.doc_id: r.vec for r in still.collect()} == before and (other != inner).any()
    on, further = embed.train_documents(tokens, c, vocab=vocab, start=vecs, inner=inner)
    assert (further != inner).any() and {r.doc_id: r.vec for r in on.collect()} != before
    with pytest.raises(ValueError, match="fixed"):
        embed.train_documents(tokens, c, fixed="vocabulary")
    _, kept = embed.word_vectors(tokens, c, vocab=vocab, inner=inner, fixed=True)
    assert (kept == inner).all()


def test_network_continues_from_a_saved_one(spark, tmp_path):
    rows = [(d, p, t) for d in range(10) for p, t in enumerate("abcabcab")]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string")
    c, path = embed.NetworkConfig(rate=0.1, size=6, epochs=2), str(tmp_path / "network")
    embed.rnn(tokens, c).write.parquet(path)
    start = models.load_network(spark, path)
    assert {n: m.shape for n, m in start.items()} == {"u": (3, 6), "w": (6, 6), "inner": (2, 6)}
    loss = lambda df: [r.vec[0] for r in df.where("part = 'loss'").orderBy("id").collect()]
    twice = loss(embed.rnn(tokens, c, start=start))
    whole = loss(embed.rnn(tokens, embed.NetworkConfig(rate=0.1, size=6, epochs=4)))
    assert twice == pytest.approx(whole[2:])
    assert (embed.NetworkConfig().rate, embed.NetworkConfig().size, embed.NetworkConfig().window, embed.NetworkConfig().epochs) == (0.001, 50, 3, 1)
