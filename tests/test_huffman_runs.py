import random

import numpy as np
import pytest

from loomstat.operators import embed


def runs_of(counts):
    return [(c, counts.count(c)) for c in sorted(set(counts), reverse=True)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_give_the_paths_of_the_two_queues(seed):
    rng = random.Random(seed)
    for size in (1, 2, 3, 5, 17, 64, 301):
        counts = sorted((rng.choice([1, 1, 1, 2, 2, 3, 4, 8, rng.randrange(1, 500)]) for _ in range(size)), reverse=True)
        leaf, inner = embed.huffman_runs(runs_of(counts))
        assert embed.huffman_paths(np.arange(size), size, leaf, inner) == embed.huffman(counts)


def test_segments_grow_with_different_counts_alone():
    leaf, inner = embed.huffman_runs([(7, 1_000_000), (3, 50_000_001), (1, 2_000_000_000)])
    assert len(leaf) + len(inner) < 400
    paths, codes = embed.huffman_paths(np.array([0, 999_999, 2_050_999_999]), 2_051_000_001, leaf, inner)
    assert all(p[0] == 2_050_999_999 for p in paths) and all(len(p) == len(c) for p, c in zip(paths, codes)) and len(paths[2]) >= len(paths[0])


def test_codes_of_a_vocabulary(spark):
    tokens = spark.createDataFrame([(0, i, t) for i, t in enumerate("a b a c d a b e f g h a".split())], "doc_id long, pos int, token string")
    vocab = embed.vocabulary(tokens)
    rows = embed.huffman_codes(vocab).orderBy("id").collect()
    paths, codes = embed.huffman([r.cnt for r in rows])
    assert [list(r.path) for r in rows] == paths and [list(r.code) for r in rows] == codes
    assert embed.huffman_codes(vocab.limit(0)).count() == 0
