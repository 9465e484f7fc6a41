from collections import Counter, defaultdict

import pytest

from loomstat.llm import mixing

from .helpers import docs, edge_rows, prose, words


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is above the cap is shared out again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got):
    sizes, taken, n = defaultdict(int), defaultdict(int), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
        n[s] += 1
    want = plain_targets(sizes)
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    return want, taken


def test_edges_and_reruns(spark):
    rows = edge_rows()
    table = docs(spark, rows)
    got = mixing.mix(table).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in rows)
    check(rows, got)
    again = mixing.mix(table.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(table.limit(0)).count() == 0


def test_many_chunks_stay_near_target(spark):
    rows = [(i, prose(i, 1 + i * i % 120), ["hot", "a", "b", None][min(3, i % 6)]) for i in range(1500)]
    got = mixing.mix(docs(spark, rows), chunk_rows=40).collect()
    want, taken = check(rows, got)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 60


def test_expectation_of_copies():
    hits = 0
    for seed in range(4000):
        p, q = mixing.settle_pair(0.3, 10.0, 0.6, 5.0, mixing.coin(1, 2, seed))
        assert p * 10 + q * 5 == pytest.approx(6.0) and (p in (0.0, 1.0) or q in (0.0, 1.0)) and 0 <= p <= 1 and 0 <= q <= 1
        hits += p
    assert hits / 4000 == pytest.approx(0.3, abs=0.02)


def test_take_repeats_rows_with_all_columns(spark):
    rows = edge_rows()
    table = docs(spark, rows)
    table = table.selectExpr("*", "1 AS own", "2 AS copies", "3 AS k_")
    taken = mixing.take(table)
    assert taken.columns == table.columns
    assert taken.count() == sum(r.copies for r in mixing.mix(table).collect())
