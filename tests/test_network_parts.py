import numpy as np
from pyspark.sql import functions as F

from loomstat.operators import embed, network_parts, path_softmax


def corpus(spark, docs=30):
    rng = np.random.default_rng(4)
    rows = [(d, p, f"{'ab'[d % 2]}{(p + int(rng.random() < 0.2)) % 4}") for d in range(docs) for p in range(12)]
    t = spark.createDataFrame([*rows, (900, 0, "a1")], "doc_id long, pos int, token string")
    vocab = embed.vocabulary(t)
    coded = embed.huffman_codes(vocab)
    return t, vocab, t.join(vocab.select("token", "id"), "token").select("doc_id", "pos", "id"), path_softmax.paths(coded)


def matrices(network):
    rows = network.table().orderBy("id").collect()
    return {part: np.array([r.vec for r in rows if r.part == part]) for part in ("u", "w", "inner")}


def test_one_part_is_the_network_of_one_task(spark):
    t, vocab, tokens, codes = corpus(spark)
    c = embed.VectorConfig(size=4, epochs=2, rate=0.2)
    begin = network_parts.start(codes, c)
    network, losses = network_parts.train(tokens, codes, c, network=begin)
    want = embed.rnn(t, c, vocab=vocab, start=matrices(begin)).collect()
    got = matrices(network)
    for r in want:
        if r.part == "loss":
            assert np.isclose(r.vec[0], losses[r.id])
        else:
            assert np.allclose(r.vec, got[r.part][r.id])


def test_parts_learn_as_one_task_does(spark):
    t, vocab, tokens, codes = corpus(spark)
    c = embed.VectorConfig(size=4, epochs=4, rate=0.5)
    begin = network_parts.start(codes, c)
    network, losses = network_parts.train(tokens, codes, c, network=begin, part_tokens=120)  # pieces of 30 tokens, four bins
    one = [r.vec[0] for r in embed.rnn(t, c, vocab=vocab, start=matrices(begin)).where("part = 'loss'").orderBy("id").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0] and losses[-1] < one[0]
    now = network_parts.forward(tokens, codes, network_parts.loaded(network.table()))
    n, mean = now.agg(F.count("*"), F.avg("loss")).first()
    assert n == 30 * 11 and mean < losses[0]


def test_pieces_hold_each_step_once(spark):
    rows = [(d, p, p % 5) for d, n in ((1, 1), (2, 2), (3, 23), (4, 8), (5, 9), (6, 3)) for p in range(n)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, id int")
    got = network_parts.deal(tokens, 32).collect()
    steps = sorted((r.doc_id, r.first + i, a, b) for r in got for i, (a, b) in enumerate(zip(r.ids, r.ids[1:])))
    assert steps == [(d, p, p % 5, (p + 1) % 5) for d, n in ((2, 2), (3, 23), (4, 8), (5, 9), (6, 3)) for p in range(n - 1)]
    assert max(len(r.ids) for r in got) <= 9 and len({r.bin for r in got}) <= 2


def test_without_documents(spark):
    _, _, tokens, codes = corpus(spark)
    c = embed.VectorConfig(size=3, epochs=2)
    network, losses = network_parts.train(tokens.where("doc_id = 900"), codes, c)
    assert losses == [] and network.weights.count() == 2 * codes.count() - 1
