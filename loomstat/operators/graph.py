"""Communities of weighted graphs. Edges (src, dst, w) hold both directions of every link."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.scratch import cut

RESOLUTION = 2.0


def symmetric(links: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions."""
    one = links.select("src", "dst", F.col("w").cast("double").alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, k: the weight of a node's edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))


def community_weights(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """node, comm, w: how much weight a node has to each community of (node, comm) next to it; loops don't count."""
    near = edges.where("src <> dst").join(comm.select(F.col("node").alias("dst"), "comm"), "dst")
    return near.groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("w"))


def community_stats(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """comm, nodes, total (weight of its nodes' edges), inner (weight inside, both directions)."""
    k = comm.join(degrees(edges), "node", "left").groupBy("comm").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("k", F.lit(0.0))).alias("total"))
    inside = edges.join(comm.select(F.col("node").alias("src"), "comm"), "src").join(comm.select(F.col("node").alias("dst"), F.col("comm").alias("other")), "dst").where("comm = other")
    return k.join(inside.groupBy("comm").agg(F.sum("w").alias("inner")), "comm", "left").withColumn("inner", F.coalesce("inner", F.lit(0.0)))


def delta_q(edges: DataFrame, comm: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """node, own, comm, dq = w - resolution / 2 * k * total / m for each community next to a node; the own one without the node.

    m is half the sum of all edge rows, so resolution 2 divides by the sum of link weights as the engine this follows does.
    """
    m = edges.agg((F.sum("w") / 2).alias("m"))
    stats = community_stats(edges, comm).select("comm", "total")
    t = community_weights(edges, comm).join(comm.select("node", F.col("comm").alias("own")), "node").join(degrees(edges), "node").join(stats, "comm").join(F.broadcast(m))  # one row
    rest = F.when(F.col("comm") == F.col("own"), F.col("total") - F.col("k")).otherwise(F.col("total"))
    return t.select("node", "own", "comm", (F.col("w") - resolution / 2 * F.col("k") * rest / F.col("m")).alias("dq"))


def modularity(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """One row (modularity)."""
    s = community_stats(edges, comm)
    m2 = F.sum("total")
    return s.agg((F.sum("inner") / m2 - F.sum(F.col("total") * F.col("total")) / (m2 * m2)).alias("modularity"))


def contract(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """Communities as nodes, weights between them summed up, what is inside dropped."""
    a, b = comm.select(F.col("node").alias("src"), F.col("comm").alias("cs")), comm.select(F.col("node").alias("dst"), F.col("comm").alias("cd"))
    return edges.join(a, "src").join(b, "dst").where("cs <> cd").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w"))


def _sweeps_exact(pdf: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """Local moves node by node in order of id, until none gains."""
    near: dict = {}
    for s, d, w in pdf[["src", "dst", "w"]].sort_values(["src", "dst"]).itertuples(index=False):
        near.setdefault(s, []).append((d, w))
    k = {s: sum(w for _, w in e) for s, e in near.items()}
    m = sum(k.values()) / 2
    comm, total = {s: s for s in near}, dict(k)
    moved = True
    while moved:
        moved = False
        for node in sorted(near):
            weights: dict = {}
            for d, w in near[node]:
                if d != node:
                    weights[comm[d]] = weights.get(comm[d], 0.0) + w
            own = comm[node]
            gain = {c: w - resolution / 2 * k[node] * (total[c] - k[node] * (c == own)) / m for c, w in weights.items() if w > 0}
            best = min(gain, key=lambda c: (-gain[c], c), default=own)
            if best != own and gain[best] > max(0.0, gain.get(own, 0.0)) + 1e-12:
                total[own] -= k[node]
                total[best] += k[node]
                comm[node], moved = best, True
    return pd.DataFrame({"node": list(comm), "comm": list(comm.values())})


def _wishes(edges: DataFrame, comm: DataFrame, resolution: float) -> DataFrame:
    """node, to for the nodes that gain by another community than their own."""
    t = delta_q(edges, comm, resolution)
    best = t.groupBy("node", "own").agg(F.max_by("comm", F.struct("dq", "comm")).alias("to"), F.max("dq").alias("dq"), F.max(F.when(F.col("comm") == F.col("own"), F.col("dq"))).alias("here"))
    return best.where((F.col("to") != F.col("own")) & (F.col("dq") > F.greatest(F.lit(0.0), F.coalesce("here", F.lit(0.0))) + 1e-12)).select("node", "to")


def _sweeps_joined(edges: DataFrame, resolution: float, rounds: int | None = None) -> DataFrame:
    """Local moves by joins, until no node gains: in each of the first ten rounds a hash half of the nodes moves at once to the best community.

    Such moves can undo each other. So from then on a community takes part in one move a round, that of the node with the least hash, and
    the modularity rises with each.
    """
    comm, i = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("comm", F.col("node"))), 0
    while rounds is None or i < rounds:
        new = cut(comm.join(_wishes(edges, comm, resolution), "node", "left"))
        if new.where("to IS NOT NULL").isEmpty():
            break
        comm, i = _moved(new, i), i + 1
    return comm


def _moved(new: DataFrame, i: int) -> DataFrame:
    """node, comm after the moves of round i; new: node, comm and, for nodes that gain, to."""
    rank = F.struct(F.xxhash64("node", F.lit(i)), "node")
    if i < 10:
        return new.select("node", F.coalesce(F.when(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0, F.col("to")), "comm").alias("comm"))
    first = new.where("to IS NOT NULL").select("node", rank.alias("rank"), F.explode(F.array("comm", "to")).alias("of")).groupBy("of").agg(F.min_by("node", "rank").alias("node"))
    goes = first.groupBy("node").count().where("count = 2").select("node", F.lit(True).alias("goes"))
    return new.join(goes, "node", "left").select("node", F.when(F.col("goes"), F.col("to")).otherwise(F.col("comm")).alias("comm"))


def louvain(edges: DataFrame, *, mode: str = "distributed", resolution: float = RESOLUTION, rounds: int | None = None) -> DataFrame:
    """node, comm: local moves and contraction in turn while nodes move.

    exact moves one node at a time in order of id, in one task (for graphs that fit an executor); distributed moves by joins, and its
    results differ. comm is the smallest node of a community in both. rounds, if given, ends the local moves of a level early.
    """
    current, label = edges, edges.select(F.col("src").alias("node")).distinct().withColumn("comm", F.col("node"))
    kind = dict(edges.dtypes)["src"]
    while True:
        if mode == "exact":
            step = current.groupBy(F.lit("all")).applyInPandas(lambda pdf: _sweeps_exact(pdf, resolution), f"node {kind}, comm {kind}")
        else:
            step = _sweeps_joined(current, resolution, rounds)
        step = cut(step)
        if step.select("comm").distinct().count() == step.count():  # no two nodes came together
            break
        label = cut(label.join(step.select(F.col("node").alias("comm"), F.col("comm").alias("next")), "comm", "left").select("node", F.coalesce("next", "comm").alias("comm")))
        current = cut(contract(current, step))
    names = label.groupBy("comm").agg(F.min("node").alias("first"))
    return label.join(names, "comm").select("node", F.col("first").alias("comm"))
