"""Topic models by collapsed Gibbs sampling: plain, global/local, and topics with regions.

exact mode samples token after token in one task; distributed mode samples documents in parallel against the word and topic
counts of the sweep before and merges the counts after each sweep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators import packed_lda, parts_lda, sparse_lda
from loomstat.scratch import cut


@dataclass
class TopicConfig:
    alpha: float = 0.05
    beta: float = 0.01
    topics: int = 50
    sweeps: int = 20
    seed: int = 0


@dataclass
class LocalConfig(TopicConfig):
    gamma0: float = 0.5
    gamma1: float = 0.5


@dataclass
class RegionConfig(TopicConfig):
    gamma0: float = 0.5
    gamma1: float = 0.5
    regions: int = 30
    weight: float = 1.0
    every: int = 10
    least: int = 100


def start_topics(tokens: DataFrame, k: int, seed: int, topic: str = "topic", first: int = 1) -> DataFrame:
    """tokens with topic filled in where it is null, by a hash of the token's place."""
    known = F.col(topic) if topic in tokens.columns else F.lit(None).cast("int")
    return tokens.withColumn(topic, F.coalesce(known, (first + F.pmod(F.xxhash64("doc", "pos", "word", F.lit(seed)), F.lit(k))).cast("int")))


def counts(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.groupBy(*by).agg(F.count("*").alias("n"))


def pivoted(tokens: DataFrame, row: str, k: int, topic: str = "topic", first: int = 1) -> DataFrame:
    """row and a column for each topic first .. first + k - 1; tokens of other topics count nowhere, but keep their row."""
    return tokens.groupBy(row).pivot(topic, list(range(first, first + k))).count().na.fill(0)


def local_words(tokens: DataFrame) -> DataFrame:
    """word and a column for each local: how many tokens (word, local, x) of the word are the local's own (x = 1)."""
    own = F.count(F.when(F.col("x") == 1, 1))
    return tokens.groupBy("word").pivot("local").agg(own).na.fill(0)


def region_words(tokens: DataFrame, regions: int) -> DataFrame:
    """word and a column for each region 0 .. regions - 1: how many tokens (word, x, t) of the word are the region's (x = 1)."""
    return pivoted(tokens.withColumn("t", F.when(F.col("x") == 1, F.col("t"))), "word", regions, "t", 0)


def region_dispersion(tokens: DataFrame) -> DataFrame:
    """region, n, mx, my, vx, vy, cov, det of the places of the tokens that are a region's own."""
    return region_stats(tokens.where("x = 1").withColumnRenamed("t", "region"), "region")


def bucket_sums(tokens: DataFrame, doc: str, word: str, alpha: float, beta: float, k: int) -> DataFrame:
    """One row (e, f, g) for a token of doc and word: smoothing, document and word part of the sampling weights.

    e = sum of alpha beta / (V beta + n_t) over topics 1 .. k, f = sum of beta n_dt / (V beta + n_t),
    g = sum of (alpha + n_dt) n_wt / (V beta + n_t).
    """
    v = tokens.agg(F.countDistinct("word").cast("double").alias("v"))
    t = tokens.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("topic"))
    t = t.join(counts(tokens, "topic").withColumnRenamed("n", "nt"), "topic", "left")
    t = t.join(counts(tokens.where(F.col("doc") == doc), "topic").withColumnRenamed("n", "nd"), "topic", "left")
    t = t.join(counts(tokens.where(F.col("word") == word), "topic").withColumnRenamed("n", "nw"), "topic", "left").na.fill(0, ["nt", "nd", "nw"])
    t = t.join(F.broadcast(v)).withColumn("s", F.col("v") * beta + F.col("nt"))  # one row
    return t.agg(F.sum(alpha * beta / F.col("s")).alias("e"), F.sum(beta * F.col("nd") / F.col("s")).alias("f"), F.sum((alpha + F.col("nd")) * F.col("nw") / F.col("s")).alias("g"))


def _sweep_docs(pdf: pd.DataFrame, c: TopicConfig, nw: dict, nt: np.ndarray, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """One sweep over tokens sorted by document; nw and nt are changed in place. Topics from 0."""
    topic = pdf.topic.to_numpy().copy() - 1
    docs, words = pdf.doc.to_numpy(), pdf.word.to_numpy()
    edges = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        nd = np.bincount(topic[lo:hi], minlength=c.topics).astype(float)
        u = rng.random(hi - lo)
        for i in range(hi - 1, lo - 1, -1):
            t, row = topic[i], nw[words[i]]
            nd[t] -= 1
            row[t] -= 1
            nt[t] -= 1
            p = np.cumsum((c.alpha + nd) * (c.beta + row) / (vocabulary * c.beta + nt))
            t = min(int(np.searchsorted(p, u[i - lo] * p[-1], "right")), c.topics - 1)
            topic[i] = t
            nd[t] += 1
            row[t] += 1
            nt[t] += 1
    return topic + 1


TOKEN = "doc string, pos long, word string, topic int"


def lda(tokens: DataFrame, config: TopicConfig, mode: str = "distributed", sampler: str = "sparse", grouped: bool = False) -> DataFrame:
    """doc, pos, word, topic (1 .. k) after the sweeps.

    tokens: doc, pos, word and, if there, topic; grouped tells that a document's tokens lie next to each other, as an explode leaves them. In
    distributed mode documents are dealt into parts of about PART_TOKENS tokens; a part gets the counts of its own words. Up to LANE_TOPICS
    topics the parts stay packed where they are (packed_lda). The sparse sampler's draws cost the topics of a document and a word; the dense one (exact
    mode only) works all k topics out for each token.
    """
    c = config
    base = tokens.select(F.col("doc").cast("string").alias("doc"), F.col("pos").cast("long").alias("pos"), F.col("word").cast("string").alias("word"), *(["topic"] if "topic" in tokens.columns else []))
    now = start_topics(base, c.topics, c.seed).select("doc", "pos", "word", "topic")
    if mode != "exact" and c.topics <= sparse_lda.LANE_TOPICS:
        return packed_lda.lda(now, c.sweeps, c.topics, c.alpha, c.beta, c.seed, grouped)
    vocabulary = base.agg(F.countDistinct("word")).first()[0]
    if mode == "exact":
        return now.groupBy(F.lit("all")).applyInPandas(_exact(c, vocabulary, sampler), TOKEN)
    now = cut(now)
    parts = max(1, -(-now.count() // sparse_lda.PART_TOKENS))
    for sweep in range(c.sweeps):
        nt = np.zeros(c.topics)
        for r in counts(now, "topic").collect():  # a row a topic
            nt[r["topic"] - 1] = r["n"]
        now = cut(sparse_lda.sweep(now, parts, c.alpha, c.beta, nt, vocabulary, [c.seed, sweep]))
    return now


def _exact(c: TopicConfig, vocabulary: int, sampler: str):
    """The function that sweeps over all tokens in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "pos"]).reset_index(drop=True)
        rng = np.random.default_rng(c.seed)
        nt = np.bincount(pdf.topic - 1, minlength=c.topics).astype(float)
        by_word = {w: g.to_numpy() - 1 for w, g in pdf.groupby("word").topic}
        if sampler == "dense":
            nw = {w: np.bincount(t, minlength=c.topics).astype(float) for w, t in by_word.items()}
            for _ in range(c.sweeps):
                pdf["topic"] = _sweep_docs(pdf, c, nw, nt, vocabulary, rng)
            return pdf
        held = sparse_lda.SparseSampler(c.alpha, c.beta, nt, vocabulary, {w: dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)) for w, t in by_word.items()})
        docs, words, topic = pdf.doc.to_numpy(), pdf.word.tolist(), (pdf.topic - 1).tolist()
        edges = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]).tolist() if len(docs) else [0]
        for _ in range(c.sweeps):
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                topic[lo:hi] = held.sweep(words[lo:hi], topic[lo:hi], rng.random(hi - lo))
        return pdf.assign(topic=np.array(topic, int) + 1)

    return run


def hash_text(text: str) -> int:
    """A number from text that is the same in every process."""
    h = 1469598103934665603
    for b in str(text).encode():
        h = (h ^ b) * 1099511628211 % (1 << 63)
    return h


def _draw(p: np.ndarray, u: float) -> int:
    p = np.cumsum(p)
    return min(int(np.searchsorted(p, u * p[-1], "right")), len(p) - 1)


def local_lda(tokens: DataFrame, config: LocalConfig, mode: str = "distributed") -> DataFrame:
    """doc, pos, local, word, x, topic: each token is global (x = 0, with a topic 1 .. k) or its local's own (x = 1, topic -1).

    exact: one task, documents in order. distributed: parts of documents, those of a local together as long as they fit (parts_lda).
    """
    c = config

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "pos"]).reset_index(drop=True)
        rng = np.random.default_rng(c.seed)
        codes = {n: pd.factorize(pdf[n]) for n in ("doc", "word", "local")}
        (d, ds), (w, ws), (q, qs) = (codes[n] for n in ("doc", "word", "local"))
        v = len(ws)
        x, topic = pdf.x.to_numpy().copy(), np.where(pdf.x == 1, 0, pdf.topic - 1).astype(int)
        nd, nw, nt = np.zeros((len(ds), c.topics)), np.zeros((v, c.topics)), np.zeros(c.topics)
        nl, nql, sw = np.zeros((len(qs), v)), np.zeros(len(qs)), np.zeros((len(ds), 2))

        def put(i: int, s: int) -> None:
            sw[d[i], x[i]] += s
            if x[i]:
                nl[q[i], w[i]] += s
                nql[q[i]] += s
            else:
                nd[d[i], topic[i]] += s
                nw[w[i], topic[i]] += s
                nt[topic[i]] += s

        for i in range(len(pdf)):
            put(i, 1)
        for _ in range(c.sweeps):
            for i in range(len(pdf)):
                put(i, -1)
                shared = (c.alpha + nd[d[i]]) * (c.beta + nw[w[i]]) / (v * c.beta + nt) / (c.topics * c.alpha + nd[d[i]].sum())
                g = (c.gamma0 + sw[d[i], 0]) * shared
                own = (c.gamma1 + sw[d[i], 1]) * (c.beta + nl[q[i], w[i]]) / (v * c.beta + nql[q[i]])
                t = _draw(np.append(g, own), rng.random())
                x[i], topic[i] = (1, 0) if t == c.topics else (0, t)
                put(i, 1)
        return pdf.assign(x=x, topic=np.where(x == 1, -1, topic + 1))

    t = start_topics(tokens, c.topics, c.seed).withColumn("x", F.coalesce(F.col("x"), F.lit(0)).cast("int") if "x" in tokens.columns else F.lit(0))
    t = t.select(*[F.col(n).cast("string") for n in ("doc",)], F.col("pos").cast("long"), F.col("local").cast("string"), F.col("word").cast("string"), "x", "topic")
    if mode == "distributed":
        done = parts_lda.switch_sweeps(t.withColumn("z", F.when(F.col("x") == 1, parts_lda.OWN).otherwise(F.col("topic") - 1).cast("int")), c)
        own = F.col("z") == parts_lda.OWN
        return done.select("doc", "pos", "local", "word", own.cast("int").alias("x"), F.when(own, -1).otherwise(F.col("z") + 1).cast("int").alias("topic"))
    return t.groupBy(F.lit("all")).applyInPandas(run, "doc string, pos long, local string, word string, x int, topic int")


def region_stats(tokens: DataFrame, by: str) -> DataFrame:
    """by, n, mx, my, vx, vy, cov, det of the places of each region's tokens."""
    t = tokens.groupBy(by).agg(F.count("*").alias("n"), F.avg("px").alias("mx"), F.avg("py").alias("my"), F.var_pop("px").alias("vx"), F.var_pop("py").alias("vy"), F.covar_pop("px", "py").alias("cov"))
    return t.withColumn("det", F.col("vx") * F.col("vy") - F.col("cov") * F.col("cov"))


def region_lda(tokens: DataFrame, config: RegionConfig, mode: str = "distributed") -> DataFrame:
    """doc, pos, word, px, py, x, t: each token belongs to a global topic (x = 0, t in 0 .. k-1) or a region (x = 1, t in 0 .. l-1).

    Topics share one Gaussian fitted at the start; regions are refitted every so many sweeps, and regions with few tokens keep theirs as
    they are. exact: one task, documents in order. distributed: parts of documents, which regions are too small is decided once a sweep (parts_lda).
    """
    c = config

    def moments(px, py):
        if len(px) < 2:
            return None
        vx, vy, cv = px.var(), py.var(), ((px - px.mean()) * (py - py.mean())).mean()
        det = vx * vy - cv * cv
        return (px.mean(), py.mean(), vx, vy, cv, det) if det > 0 else None

    def density(g, x, y):
        if g is None:
            return 0.0
        mx, my, vx, vy, cv, det = g
        dx, dy = x - mx, y - my
        return np.exp(-(vy * dx * dx - 2 * cv * dx * dy + vx * dy * dy) / det / 2) / np.sqrt(det)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "pos"]).reset_index(drop=True)
        rng = np.random.default_rng(c.seed)
        (d, ds), (w, ws) = pd.factorize(pdf.doc), pd.factorize(pdf.word)
        v, px, py = len(ws), pdf.px.to_numpy(), pdf.py.to_numpy()
        x = pdf.x.fillna(pd.Series(rng.integers(0, 2, len(pdf)))).to_numpy().astype(int)
        t = pdf.t.fillna(pd.Series(np.where(x == 0, rng.integers(0, c.topics, len(pdf)), rng.integers(0, c.regions, len(pdf))))).to_numpy().astype(int)
        both = c.topics + c.regions
        z = np.where(x == 0, t, c.topics + t)
        nd, nw, nz, size = np.zeros((len(ds), c.topics)), np.zeros((v, both)), np.zeros(both), np.bincount(d)
        shared = moments(px[x == 0], py[x == 0])
        own = [None] * c.regions

        def put(i, s):
            if z[i] < c.topics:
                nd[d[i], z[i]] += s
            nw[w[i], z[i]] += s
            nz[z[i]] += s

        for i in range(len(pdf)):
            put(i, 1)
        for sweep in range(c.sweeps):
            if sweep % c.every == 0:
                own = [moments(px[z == c.topics + r], py[z == c.topics + r]) for r in range(c.regions)]
            for i in range(len(pdf)):
                if z[i] >= c.topics and nz[z[i]] < c.least:
                    continue
                put(i, -1)
                words = (c.beta + nw[w[i]]) / (v * c.beta + nz)
                n0 = nd[d[i]].sum()
                first = (c.gamma0 + n0) * (c.alpha + nd[d[i]]) / (c.topics * c.alpha + n0) * density(shared, px[i], py[i])
                n = nz[c.topics :]
                second = (c.gamma1 + size[d[i]] - 1 - n0) * (c.weight + n) / (c.weight * c.regions + n.sum()) * np.array([density(g, px[i], py[i]) for g in own])
                p = np.append(first, second) * words
                z[i] = _draw(p, rng.random()) if p.sum() > 0 else z[i]
                put(i, 1)
        return pdf.assign(x=(z >= c.topics).astype(int), t=np.where(z < c.topics, z, z - c.topics))

    have = lambda n: F.col(n).cast("int") if n in tokens.columns else F.lit(None).cast("int")
    t = tokens.select(F.col("doc").cast("string"), F.col("pos").cast("long"), F.col("word").cast("string"), F.col("px").cast("double"), F.col("py").cast("double"), have("x").alias("x"), have("t").alias("t"))
    if mode == "distributed":
        pick = lambda n, what: F.pmod(F.xxhash64("doc", "pos", "word", F.lit(what), F.lit(c.seed)), F.lit(n))
        t = t.withColumn("x", F.coalesce("x", pick(2, "x")))
        z = F.when(F.col("x") == 0, F.coalesce("t", pick(c.topics, "t"))).otherwise(c.topics + F.coalesce("t", pick(c.regions, "t")))
        done = parts_lda.region_sweeps(t.withColumn("z", z.cast("int")), c, region_stats)
        x = F.col("z") >= c.topics
        return done.select("doc", "pos", "word", "px", "py", x.cast("int").alias("x"), F.when(x, F.col("z") - c.topics).otherwise(F.col("z")).cast("int").alias("t"))
    return t.groupBy(F.lit("all")).applyInPandas(run, "doc string, pos long, word string, px double, py double, x int, t int")
