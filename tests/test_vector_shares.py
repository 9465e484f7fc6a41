import numpy as np
import pytest

from loomstat.operators import embed


@pytest.fixture()
def tokens(spark):
    rows = [(d, p, t) for d in range(40) for p, t in enumerate("abcabcab" if d % 2 else "xyzzyxxy")]
    return spark.createDataFrame(rows, "doc_id long, pos int, token string")


def test_shares_follow_the_tokens(monkeypatch):
    monkeypatch.setattr(embed, "PART_TOKENS", 100)
    assert [embed.VectorConfig().shares(n) for n in (0, 100, 101, 950)] == [1, 1, 2, 10] and embed.VectorConfig(partitions=3).shares(950) == 3


def test_word_vectors_spread_out_by_tokens(spark, tokens, monkeypatch):
    monkeypatch.setattr(embed, "PART_TOKENS", 100)
    seen = []
    monkeypatch.setattr(embed, "averaged", lambda parts, *keys, f=embed.averaged: seen.append(parts.where("n > 0").select("share").distinct().count()) or f(parts, *keys))
    words, _ = embed.word_vectors(tokens, embed.VectorConfig(epochs=1, size=4))
    assert seen == [4] and words.count() == 6


def test_document_vectors_spread_out_by_tokens(spark, tokens, monkeypatch):
    monkeypatch.setattr(embed, "PART_TOKENS", 100)
    seen = []
    monkeypatch.setattr(embed, "averaged", lambda parts, *keys, f=embed.averaged: seen.append(parts.where("n > 0").select("share").distinct().count()) or f(parts, *keys))
    vecs, _ = embed.train_documents(tokens, embed.VectorConfig(epochs=1, size=4))
    assert seen == [4] and vecs.count() == 40


def test_network_spreads_out_by_tokens(spark, tokens, monkeypatch):
    monkeypatch.setattr(embed, "PART_TOKENS", 100)
    got = embed.rnn(tokens, embed.VectorConfig(epochs=5, size=4, rate=0.2)).collect()
    losses = [r.vec[0] for r in sorted((r for r in got if r.part == "loss"), key=lambda r: r.id)]
    assert len(losses) == 5 and losses[-1] < losses[0]
    assert sorted(p for p in {r.part for r in got}) == ["inner", "loss", "u", "w"] and sum(r.part == "u" for r in got) == 6


def test_averages_weigh_shares_by_tokens(spark):
    t = spark.createDataFrame([(0, 1, [1.0, 2.0], 1), (0, 0, [4.0, 8.0], 2), (0, 2, [9.0, 9.0], 0)], "id int, share int, vec array<double>, n long")
    assert [list(r) for r in embed.averaged(t, "id")] == [[0, [3.0, 6.0]]]
    soft = embed.Softmax([3, 2, 1], 2)
    assert np.allclose(soft.step(np.array([0.1, 0.2]), 1, 0.1)[0], -np.log(0.5) * len(soft.paths[1]))
