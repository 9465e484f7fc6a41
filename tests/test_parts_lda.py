from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomstat.operators import parts_lda, topics


def planted(spark, docs=60, length=24, seed=5):
    """Documents of two subjects in three locals; a third of the words is their local's own. Local l0 holds half of all."""
    rng, rows = np.random.default_rng(seed), []
    for d in range(docs):
        local = "l0" if d % 2 else f"l{1 + d % 4 // 2}"
        for i in range(length):
            word = f"{local}-{rng.integers(4)}" if rng.random() < 1 / 3 else f"{'ab'[d % 3 % 2]}{rng.integers(6)}"
            rows.append((f"d{d}", i, local, word))
    return spark.createDataFrame(rows, "doc string, pos long, local string, word string")


def likelihood(pdf: pd.DataFrame, c) -> float:
    """Log likelihood a token of the counts that the tokens (doc, local, word, x, topic) have."""
    v, vb = pdf.word.nunique(), pdf.word.nunique() * c.beta
    nd, nw, nt, n1 = Counter(), Counter(), Counter(), Counter()
    nl, nq = Counter(), Counter()
    for r in pdf.itertuples():
        if r.x:
            n1[r.doc] += 1
            nl[r.word, r.local] += 1
            nq[r.local] += 1
        else:
            nd[r.doc, r.topic] += 1
            nw[r.word, r.topic] += 1
            nt[r.topic] += 1
    assert v
    total, size = 0.0, Counter(pdf.doc)
    for r in pdf.itertuples():
        n0 = size[r.doc] - n1[r.doc]
        p0 = (c.gamma0 + n0) / (c.gamma0 + c.gamma1 + size[r.doc])
        shared = sum((c.alpha + nd[r.doc, t]) * (c.beta + nw[r.word, t]) / (vb + nt[t]) for t in range(1, c.topics + 1)) / (c.topics * c.alpha + n0)
        total += np.log(p0 * shared + (1 - p0) * (c.beta + nl[r.word, r.local]) / (vb + nq[r.local]))
    return total / len(pdf)


def test_switch_model_over_parts_is_as_likely_as_in_one_task(spark):
    t = planted(spark)
    c = topics.LocalConfig(topics=2, sweeps=15, alpha=0.1, beta=0.05, seed=2)
    now = t.withColumn("z", F.pmod(F.xxhash64("doc", "pos"), F.lit(2)).cast("int"))
    dealt = parts_lda.deal(now, "local", 300)
    assert dealt.count() == t.count() and dealt.select("part").distinct().count() >= 4  # l0 has 720 tokens
    done = parts_lda.switch_sweeps(now, c, 300)
    got = done.select("doc", "pos", "local", "word", (F.col("z") == -1).cast("int").alias("x"), F.when(F.col("z") == -1, -1).otherwise(F.col("z") + 1).alias("topic")).toPandas()
    assert sorted(zip(got.doc, got.pos, got.local, got.word, strict=True)) == sorted(map(tuple, t.toPandas().itertuples(index=False)))
    exact = topics.local_lda(t, c, "exact").toPandas()
    assert likelihood(got, c) > 1.02 * likelihood(exact, c)  # both are below 0
    assert got[got.word.str[0] == "l"].x.mean() > 0.8 and got[got.word.str[0] != "l"].x.mean() < 0.2
    few = replace(c, sweeps=2)
    one, two = (parts_lda.switch_sweeps(x, few, 300).toPandas().sort_values(["doc", "pos"]).z.tolist() for x in (now, now.repartition(7)))
    assert one == two
    # what the last sweep changed, added to the counts before it, makes the counts after it
    for by in (["word"], ["word", "local"]):
        before = parts_lda.counted(done.select(*by, F.col("z0").alias("z")), *by, "z")
        merged = parts_lda.merged(before, done, *by).select(*by, "z", "n").collect()
        assert sorted(merged) == sorted(parts_lda.counted(done, *by, "z").collect())


def test_long_documents_and_hot_locals_are_split(spark):
    rows = [("long", i, "hot", f"w{i % 9}") for i in range(1000)] + [(f"s{i}", 0, "hot" if i % 2 else f"q{i}", f"w{i % 9}") for i in range(600)] + [(None, 0, None, None)] * 3
    t = spark.createDataFrame(rows, "doc string, pos long, local string, word string").withColumn("z", F.lit(0))
    for local in ("local", None):
        sizes = parts_lda.deal(t, local, 100).groupBy("part").count().toPandas()["count"]
        assert sizes.sum() == 1603 and sizes.max() < 250
    done = parts_lda.switch_sweeps(t, topics.LocalConfig(topics=3, sweeps=2), 100)
    assert done.count() == 1603 and done.where("split").count() == 1000 and done.where("z NOT BETWEEN -1 AND 2").isEmpty()
    assert parts_lda.switch_sweeps(t.limit(0), topics.LocalConfig(topics=3, sweeps=1)).isEmpty()


def part(rows: list[dict]) -> pd.DataFrame:
    base = {"part": 3, "kind": parts_lda.TOKEN, "doc": None, "pos": 0, "local": None, "word": None, "px": None, "py": None, "z": 0, "n": 0, "split": False}
    return pd.DataFrame([base | r for r in rows])


def shares(run_of, rows, n=1500):
    seen = Counter()
    for seed in range(n):
        seen[run_of([seed])(part(rows)).z.iloc[0]] += 1
    return {z: m / n for z, m in seen.items()}


def test_switch_draws_have_the_models_shares():
    c = topics.LocalConfig(topics=2, alpha=0.3, beta=0.2, gamma0=0.7, gamma1=0.4)
    heads = [{"kind": parts_lda.WORD, "word": "w", "z": 0, "n": 3}, {"kind": parts_lda.WORD, "word": "w", "z": 1, "n": 1}, {"kind": parts_lda.PAIR, "word": "w", "local": "q", "z": -1, "n": 2}, {"kind": parts_lda.LOCAL, "local": "q", "n": 5}]
    heads += [{"kind": parts_lda.DOC, "doc": "d", "z": z, "n": n} for z, n in ((0, 2), (1, 1), (-1, 3))]
    token = {"doc": "d", "word": "w", "local": "q", "z": 0, "split": True}
    got = shares(lambda s: parts_lda.switch_task(c, np.array([6.0, 4.0]), 8, s), [*heads, token])
    vb, nd, nw, nt = 8 * 0.2, (1, 1), (2, 1), (5, 4)
    p = {z: (0.7 + 2) * (0.3 + nd[z]) * (0.2 + nw[z]) / (vb + nt[z]) / (0.6 + 2) for z in (0, 1)} | {-1: (0.4 + 3) * (0.2 + 2) / (vb + 5)}
    for z, x in p.items():
        assert abs(got[z] - x / sum(p.values())) < 0.05


def test_region_draws_have_the_models_shares_and_small_regions_rest():
    c = topics.RegionConfig(topics=2, regions=2, alpha=0.3, beta=0.2, gamma0=0.7, gamma1=0.4, weight=1.5, least=3)
    shared, own = np.array([[0, 0, 2.0, 2.0, 0, 4.0]]), np.array([[1.0, 0, 1, 1, 0.5, 0.75], [0, 1, 1, 2, 0, 2.0]])
    heads = [{"kind": parts_lda.WORD, "word": "w", "z": z, "n": n} for z, n in ((0, 3), (2, 2), (3, 1))]
    heads += [{"kind": parts_lda.DOC, "doc": "d", "z": z, "n": n} for z, n in ((0, 2), (1, 1), (2, 3))]
    token = {"doc": "d", "word": "w", "z": 2, "split": True, "px": 0.5, "py": -0.2}
    nz = np.array([6.0, 4, 5, 3])
    got = shares(lambda s: parts_lda.region_task(c, nz, shared, own, 8, s), [*heads, token])

    def gauss(g):
        dx, dy = 0.5 - g[0], -0.2 - g[1]
        inverse = np.linalg.inv([[g[2], g[4]], [g[4], g[3]]])
        return np.exp(-np.array([dx, dy]) @ inverse @ [dx, dy] / 2) / np.sqrt(g[5])

    vb, nw, nz1 = 8 * 0.2, (3, 0, 1, 1), (6, 4, 4, 3)
    p = [(0.7 + 3) * (0.3 + n) / (0.6 + 3) * gauss(shared[0]) for n in (2, 1)] + [(0.4 + 2) * (1.5 + n) / (3 + 7) * gauss(g) for n, g in zip((4, 3), own, strict=True)]
    p = [a * (0.2 + nw[z]) / (vb + nz1[z]) for z, a in enumerate(p)]
    for z, x in enumerate(p):
        assert abs(got[z] - x / sum(p)) < 0.05
    rests = parts_lda.region_task(c, np.array([6.0, 4, 2, 3]), shared, own, 8, [1])(part([*heads, token]))
    assert rests.z.tolist() == [2]


def test_regions_over_parts_are_found(spark):
    """Three regions, each with words of its own at a place of its own, and shared words all over: a region's words lie together."""
    rng, rows = np.random.default_rng(3), []
    for d in range(80):
        for i in range(20):
            r = int(rng.integers(3))
            if rng.random() < 0.7:
                rows.append((f"d{d}", i, f"r{r}-{rng.integers(4)}", 8.0 * r + rng.normal(), float(rng.normal()), 1, r if rng.random() < 0.6 else int(rng.integers(3))))
            else:
                rows.append((f"d{d}", i, f"g{rng.integers(5)}", 12 * rng.random() - 2, 4 * float(rng.normal()), 0, int(rng.integers(2))))
    t = spark.createDataFrame(rows, "doc string, pos long, word string, px double, py double, x int, t int")
    c = topics.RegionConfig(topics=2, regions=3, sweeps=12, every=3, least=20, alpha=0.1, beta=0.05)
    start = t.withColumn("z", F.when(F.col("x") == 0, F.col("t")).otherwise(F.col("t") + 2).cast("int"))
    done = parts_lda.region_sweeps(start, c, topics.region_stats, 400)
    assert done.select("part").distinct().count() >= 3
    got = done.toPandas()
    assert len(got) == len(rows)
    mine = got[(got.z >= 2) & (got.word.str[0] == "r")]
    assert len(mine) / (got.word.str[0] == "r").sum() > 0.8
    assert (mine.word.str[1].astype(int) == mine.z - 2).mean() > 0.95
    moments = topics.region_stats(done.where("z >= 2"), "z").toPandas().set_index("z")
    for z, g in got[got.z >= 2].groupby("z"):
        assert abs(moments.mx[z] - g.px.mean()) < 1e-9 and abs(moments["cov"][z] - np.cov(g.px, g.py, ddof=0)[0, 1]) < 1e-9
    out = topics.region_lda(t.drop("x", "t"), c)
    assert out.columns == ["doc", "pos", "word", "px", "py", "x", "t"] and out.count() == len(rows)
