"""Gibbs sweeps of the switch and the region model over many tasks.

Tokens are dealt once into parts of about PART_TOKENS tokens. In a sweep a part's tokens are drawn one after another, starting from
the counts of the sweep before: those of the part's own words, of its locals and of documents that are split over parts come in
front of the tokens. What changed is then added to the count tables by key. Only the counts of topics and of regions (k + l
numbers) and the regions' Gaussians pass through the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.sparse_lda import PART_TOKENS, SparseSampler, lanes
from loomstat.scratch import cut

#: kinds of rows that a task gets: counts of its words, of its words in locals, of its locals, of split documents; and its tokens
WORD, PAIR, LOCAL, DOC, TOKEN = range(5)
#: slot of a token that is its local's own
OWN = -1
_KINDS = {"part": "long", "kind": "int", "doc": "string", "pos": "long", "local": "string", "word": "string", "px": "double", "py": "double", "z": "int", "n": "long", "split": "boolean"}
_OUT = "part long, split boolean, doc string, pos long, local string, word string, px double, py double, z int, z0 int"


def deal(tokens: DataFrame, local: str | None = None, size: int | None = None) -> DataFrame:
    """tokens with part and split: whether the token's document lies in several parts.

    A document stays in one part unless it has more than size tokens. With local, documents of the same (least) local stay
    together unless that local has more than size tokens; small ones share a part by hash.
    """
    size = size or PART_TOKENS
    home = F.min(local) if local else F.lit(None).cast("string")
    docs = tokens.groupBy("doc").agg(F.count("*").alias("m"), home.alias("home"))
    pieces = F.ceil(F.col("m") / size)
    number = lambda *of: F.shiftrightunsigned(F.xxhash64(*of), 1)
    if local:
        homes = docs.groupBy("home").agg(F.sum("m").alias("h"))
        docs = docs.join(homes.withColumnRenamed("home", "of"), F.col("home").eqNullSafe(F.col("of")))
    else:
        docs = docs.withColumn("h", F.lit(0))
    groups = max(1, -(-tokens.count() // size))
    small = F.pmod(number("home" if local else "doc"), F.lit(groups))
    large = number(F.coalesce("home", F.lit("")), F.pmod(number("doc"), F.ceil(F.col("h") / size)))
    docs = docs.select(F.col("doc").alias("of"), pieces.alias("pieces"), F.when(F.col("h") > size, large).otherwise(small).alias("base"))
    t = tokens.join(docs, F.col("doc").eqNullSafe(F.col("of")))
    part = F.when(F.col("pieces") > 1, number("base", F.pmod(number("doc", "pos"), F.col("pieces")))).otherwise(F.col("base"))
    return t.withColumns({"part": part, "split": F.col("pieces") > 1}).drop("of", "pieces", "base")


def counted(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.groupBy(*by).agg(F.count("*").alias("n"))


def merged(table: DataFrame, swept: DataFrame, *by: str) -> DataFrame:
    """A count table by (by, z) with what a sweep changed: tokens leave slot z0 and take slot z."""
    change = swept.where("z <> z0").select(*by, F.explode(F.array(*[F.struct(F.col(c).alias("z"), F.lit(n).cast("long").alias("n")) for c, n in (("z0", -1), ("z", 1))])).alias("c")).select(*by, "c.z", "c.n")
    return table.unionByName(change).groupBy(*by, "z").agg(F.sum("n").alias("n")).where("n <> 0")


def _shaped(df: DataFrame, kind: int) -> DataFrame:
    df = df.withColumn("kind", F.lit(kind))
    null = {"z": F.lit(0), "n": F.lit(0), "pos": F.lit(0), "split": F.lit(False)}
    return df.select(*[(F.col(c) if c in df.columns else null.get(c, F.lit(None))).cast(t).alias(c) for c, t in _KINDS.items()])


def _for_parts(held: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """The rows of a count table for each part that holds their key; null keys are keys, too."""
    keys = held.select(*[F.col(c).alias(f"__{c}") for c in by], "part").distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return table.join(keys, on).drop(*[f"__{c}" for c in by])


def _swept(now: DataFrame, heads: list[tuple[DataFrame, int]], run) -> DataFrame:
    rows = _shaped(now, TOKEN)
    for df, kind in heads:
        rows = rows.unionByName(_shaped(df, kind))
    return cut(rows.groupBy("part").applyInPandas(run, _OUT))


def _parted(pdf: pd.DataFrame) -> tuple[dict[int, pd.DataFrame], pd.DataFrame, list[int]]:
    """Rows by kind in order, so that a task that runs again draws the same, the tokens in order, and where their documents begin and end."""
    kinds = {k: pdf[pdf.kind == k].sort_values(["doc", "local", "word", "z"]) for k in range(TOKEN)}
    t = pdf[pdf.kind == TOKEN].sort_values(["doc", "pos", "word", "local"]).reset_index(drop=True)
    docs = pd.factorize(t.doc)[0]
    edges = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]).tolist() if len(t) else [0]
    return kinds, t, edges


def _doc_slots(kinds: dict[int, pd.DataFrame]) -> dict:
    """Counts of slots of each split document."""
    out: dict = {}
    for d, z, n in zip(kinds[DOC].doc, kinds[DOC].z.tolist(), kinds[DOC].n.tolist(), strict=True):
        out.setdefault(d, {})[z] = n
    return out


def _rows(kind: pd.DataFrame) -> dict:
    out: dict = {}
    for w, z, n in zip(kind.word, kind.z.tolist(), kind.n.tolist(), strict=True):
        if z != OWN:
            out.setdefault(w, {})[z] = n
    return out


def _rng(seed: list[int], pdf: pd.DataFrame) -> np.random.Generator:
    return np.random.default_rng([*seed, int(pdf.part.iloc[0])])


def switch_task(c, nt: np.ndarray, vocabulary: int, seed: list[int]):
    """The function that draws a part's tokens: a topic, or OWN."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = _rng(seed, pdf)
        kinds, t, edges = _parted(pdf)
        held = SparseSampler(c.alpha, c.beta, nt, vocabulary, _rows(kinds[WORD]))
        own = Counter(dict(zip(zip(kinds[PAIR].word, kinds[PAIR].local, strict=True), kinds[PAIR].n.tolist(), strict=True)))
        total = Counter(dict(zip(kinds[LOCAL].local, kinds[LOCAL].n.tolist(), strict=True)))
        whole = _doc_slots(kinds)
        docs, words, locals_, slots, split = t.doc.tolist(), t.word.tolist(), t.local.tolist(), t.z.tolist(), t.split.tolist()
        u, floor, ka = rng.random(len(t)).tolist(), vocabulary * c.beta, c.topics * c.alpha
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            doc = dict(whole[docs[lo]]) if split[lo] else dict(Counter(slots[lo:hi]))
            n1 = doc.pop(OWN, 0)
            n0 = sum(doc.values())
            held.hold(doc)
            for i in range(lo, hi):
                z, word, local = slots[i], words[i], locals_[i]
                row = held.rows.setdefault(word, {})
                if z == OWN:
                    own[word, local] -= 1
                    total[local] -= 1
                    n1 -= 1
                else:
                    held.move(row, z, -1)
                    n0 -= 1
                shared = (c.gamma0 + n0) * (held.e + held.f + held.g(row)) / (ka + n0)
                alone = (c.gamma1 + n1) * (c.beta + own[word, local]) / (floor + total[local])
                x = u[i] * (shared + alone)
                if x < shared:
                    slots[i] = z = held.draw(row, x / shared)
                    held.move(row, z, 1)
                    n0 += 1
                else:
                    slots[i] = OWN
                    own[word, local] += 1
                    total[local] += 1
                    n1 += 1
            held.leave()
            held.since += hi - lo
            if held.since >= c.topics:
                held.refresh()
        return t.assign(z0=t.z, z=slots)[_names()]

    return run


def _names() -> list[str]:
    return [f.split()[0] for f in _OUT.split(", ")]


def switch_sweeps(tokens: DataFrame, c, size: int | None = None) -> DataFrame:
    """tokens (doc, pos, local, word, z: topic 0 .. k - 1 or OWN) with z after the sweeps."""
    null = F.lit(None).cast("double")
    now = cut(deal(tokens, "local", size).select("part", "split", "doc", "pos", "local", "word", null.alias("px"), null.alias("py"), "z"))
    vocabulary = tokens.agg(F.countDistinct("word") + F.max(F.col("word").isNull().cast("int"))).first()[0] or 0
    words, own = cut(counted(now, "word", "z")), cut(counted(now.where(F.col("z") == OWN), "word", "local", "z"))
    for sweep in range(c.sweeps):
        nt = _totals(words.where(F.col("z") != OWN), c.topics)
        by_local = own.groupBy("local").agg(F.sum("n").alias("n"))
        parted = now.where("split")
        heads = [
            (_for_parts(now, words.where(F.col("z") != OWN), "word"), WORD),
            (_for_parts(now, own, "word", "local"), PAIR),
            (_for_parts(now, by_local, "local"), LOCAL),
            (_for_parts(parted, counted(parted, "doc", "z"), "doc"), DOC),
        ]
        now = _swept(now, heads, switch_task(c, nt, vocabulary, [c.seed, sweep]))
        words, own = cut(merged(words, now, "word")), cut(merged(own, now, "word", "local").where(F.col("z") == OWN))
    return now


def _totals(words: DataFrame, slots: int) -> np.ndarray:
    out = np.zeros(slots)
    for r in words.groupBy("z").agg(F.sum("n").alias("n")).collect():  # a row a topic or region
        out[r["z"]] = r["n"]
    return out


def density(g: np.ndarray, x: float, y: float) -> np.ndarray:
    """Gaussian densities (but for 1 / 2 pi) at a point; rows of g are mx, my, vx, vy, cov, det, and det 0 gives 0."""
    det = np.where(g[:, 5] > 0, g[:, 5], 1)
    dx, dy = x - g[:, 0], y - g[:, 1]
    p = np.exp(-(g[:, 3] * dx * dx - 2 * g[:, 4] * dx * dy + g[:, 2] * dy * dy) / det / 2) / np.sqrt(det)
    return np.where(g[:, 5] > 0, p, 0)


def region_task(c, nz: np.ndarray, shared: np.ndarray, own: np.ndarray, vocabulary: int, seed: list[int]):
    """The function that draws a part's tokens: a topic 0 .. k - 1, or region r as k + r. Tokens of regions that held fewer than
    least tokens when the sweep began keep their region, in all tasks alike. Tokens are drawn in steps, one of each document (sparse_lda.lanes)."""
    k = c.topics
    frozen = nz[k:] < c.least

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, held = _rng(seed, pdf), nz.astype(float)
        kinds, t, _ = _parted(pdf)
        if not len(t):
            return t.assign(z0=t.z)[_names()]
        d, names = pd.factorize(t.doc, use_na_sentinel=False)
        w, words = pd.factorize(pd.concat([kinds[WORD].word, t.word]), use_na_sentinel=False)
        heads, slots = len(kinds[WORD]), t.z.to_numpy().astype(np.int64)
        both, w, own_words = len(nz), w[heads:], w[:heads]
        nw, nd = np.zeros((len(words), both)), np.bincount(d * both + slots, minlength=len(names) * both).reshape(-1, both).astype(float)
        nw[own_words, kinds[WORD].z.to_numpy()] = kinds[WORD].n.to_numpy()
        at = dict(zip(names, range(len(names)), strict=True))
        for doc, counts in _doc_slots(kinds).items():  # of documents that lie in several parts
            if doc in at:
                nd[at[doc]] = [counts.get(z, 0) for z in range(both)]
        px, py, u = t.px.to_numpy()[:, None], t.py.to_numpy()[:, None], rng.random(len(t))
        fixed = np.append(np.zeros(k, bool), frozen)
        for at in lanes(d):
            at = at[~fixed[slots[at]]]
            z, row = slots[at], np.arange(len(at))
            mine, rows, less = nd[d[at]], nw[w[at]], np.repeat(held[None], len(at), 0)
            for counts in (mine, rows, less):
                counts[row, z] -= 1
            p = (c.beta + rows) / (vocabulary * c.beta + less)
            n0, n1, n = mine[:, :k].sum(1, keepdims=True), mine[:, k:].sum(1, keepdims=True), less[:, k:]
            p[:, :k] *= (c.gamma0 + n0) * (c.alpha + mine[:, :k]) / (k * c.alpha + n0) * density(shared, px[at], py[at])
            p[:, k:] *= (c.gamma1 + n1) * (c.weight + n) / (c.weight * c.regions + n.sum(1, keepdims=True)) * density(own, px[at], py[at])
            p.cumsum(1, out=p)
            new = np.where(p[:, -1] > 0, np.minimum((p <= (u[at] * p[:, -1])[:, None]).sum(1), both - 1), z)
            for counts, base in ((nd, d[at] * both), (nw, w[at] * both)):
                np.add.at(counts.reshape(-1), base + z, -1.0)
                np.add.at(counts.reshape(-1), base + new, 1.0)
            held += np.bincount(new, minlength=both) - np.bincount(z, minlength=both)
            slots[at] = new
        return t.assign(z0=t.z, z=slots)[_names()]

    return run


def _gaussians(stats: DataFrame, by: str, rows: int) -> np.ndarray:
    out = np.zeros((rows, 6))
    for r in stats.where("n >= 2 AND det > 0").collect():  # a row a region
        out[r[by]] = [r[c] for c in ("mx", "my", "vx", "vy", "cov", "det")]
    return out


def region_sweeps(tokens: DataFrame, c, stats, size: int | None = None) -> DataFrame:
    """tokens (doc, pos, word, px, py, z: topic 0 .. k - 1 or region k .. k + l - 1) with z after the sweeps.

    stats(df, by) gives each region's moments, which Spark merges from partial sums. They are fitted anew every so many sweeps.
    """
    k = c.topics
    now = cut(deal(tokens, size=size).select("part", "split", "doc", "pos", F.lit(None).cast("string").alias("local"), "word", "px", "py", "z"))
    vocabulary = tokens.agg(F.countDistinct("word") + F.max(F.col("word").isNull().cast("int"))).first()[0] or 0
    words = cut(counted(now, "word", "z"))
    shared = _gaussians(stats(now.where(F.col("z") < k).withColumn("region", F.lit(0)), "region"), "region", 1)
    own = shared
    for sweep in range(c.sweeps):
        if sweep % c.every == 0:
            own = _gaussians(stats(now.where(F.col("z") >= k).withColumn("region", F.col("z") - k), "region"), "region", c.regions)
        parted = now.where("split")
        heads = [(_for_parts(now, words, "word"), WORD), (_for_parts(parted, counted(parted, "doc", "z"), "doc"), DOC)]
        now = _swept(now, heads, region_task(c, _totals(words, k + c.regions), shared, own, vocabulary, [c.seed, sweep]))
        words = cut(merged(words, now, "word"))
    return now
