"""The recurrent network over parts of documents: no task or driver holds the vocabulary.

The vectors of tokens (u) and of inner nodes are a table (part, id, vec), as embed.rnn writes it. A part of the documents fetches the vectors
of its own tokens and of the nodes on their paths, learns from its documents in order, and hands on what changed. A vector's changes are averaged
over the parts that used it, by uses, so one part alone moves it all the way and many don't overshoot; the k x k matrix w is averaged by tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators import embed
from loomstat.operators.path_softmax import summed
from loomstat.scratch import cut

#: Tokens of a part, about. Documents are split into pieces of a quarter of it.
PART_TOKENS = 100_000


@dataclass
class Network:
    """weights: table (part, id, vec) with part u or inner; w: the k x k matrix."""

    weights: DataFrame
    w: np.ndarray

    def table(self) -> DataFrame:
        """part (u, w, inner), id, vec."""
        rows = self.weights.sparkSession.createDataFrame([("w", i, x.tolist()) for i, x in enumerate(self.w)], "part string, id int, vec array<double>")
        return self.weights.select("part", F.col("id").cast("int").alias("id"), "vec").unionByName(rows)


def start(codes: DataFrame, config: embed.VectorConfig) -> Network:
    """u and w at random in (-0.5, 0.5) / sqrt(k), u by a hash of id, and inner nodes at 0. codes: (id, steps of (node, sign))."""
    k = config.size
    near = [(F.pmod(F.xxhash64("id", F.lit(j), F.lit(config.seed)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) / float(np.sqrt(k)) for j in range(k)]
    u = codes.select(F.lit("u").alias("part"), F.col("id").cast("long").alias("id"), F.array(*near).alias("vec"))
    nodes = codes.select(F.explode("steps.node").alias("id")).distinct()
    inner = nodes.select(F.lit("inner").alias("part"), F.col("id").cast("long").alias("id"), F.array_repeat(F.lit(0.0), k).alias("vec"))
    return Network(cut(u.unionByName(inner)), (np.random.default_rng(config.seed).random((k, k)) - 0.5) / np.sqrt(k))


def loaded(table: DataFrame) -> Network:
    """A network from its table; w's k rows come to the driver."""
    w = np.array([r["vec"] for r in table.where("part = 'w'").orderBy("id").collect()])
    return Network(cut(table.where("part IN ('u', 'inner')").select("part", F.col("id").cast("long").alias("id"), "vec")), w)


def deal(tokens: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """bin, doc_id, first, ids: pieces of documents, dealt into bins of about so many tokens by a hash.

    tokens: (doc_id, pos, id), pos from 0 without gaps. A piece ends with the token that the next one begins with, so each step from a
    token to the next is in one piece; a later piece begins with an empty state. A token alone has no step and no piece.
    """
    long = max(2, part_tokens // 4)
    at = F.floor(F.col("pos") / long)
    both = F.when((F.col("pos") % long == 0) & (F.col("pos") > 0), F.array(at - 1, at)).otherwise(F.array(at))
    pieces = tokens.select("doc_id", "pos", "id", F.explode(both).alias("piece")).groupBy("doc_id", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
    pieces = cut(pieces.where(F.size("s") > 1).select("doc_id", (F.col("piece") * long).alias("first"), F.transform("s", lambda x: x["id"].cast("long")).alias("ids")))
    total = pieces.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    return pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "first"), F.lit(max(1, -(-total // part_tokens)))))


def needs(pieces: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bin, part, id) of the vectors that each bin uses, and (bin, id, steps), the paths of its tokens."""
    own = cut(pieces.select("bin", F.explode("ids").alias("id")).distinct())
    paths = cut(own.join(codes.select(F.col("id").cast("long").alias("id"), "steps"), "id").select("bin", "id", "steps"))
    nodes = paths.select("bin", F.explode("steps.node").alias("id")).distinct()
    return cut(own.select("bin", F.lit("u").alias("part"), "id").unionByName(nodes.select("bin", F.lit("inner").alias("part"), F.col("id").cast("long").alias("id")))), paths


class _Part:
    """The vectors and paths of a bin, numbered by place."""

    def __init__(self, held: pd.DataFrame, size: int):
        def of(part: str) -> tuple[np.ndarray, pd.DataFrame]:
            mine = held[held.part == part].sort_values("id")
            return mine.id.to_numpy(np.int64), mine

        (self.tokens, u), (self.nodes, inner), (coded, paths) = of("u"), of("inner"), of("path")
        assert (coded == self.tokens).all()
        matrix = lambda t: np.array(t.vec.tolist(), float).reshape(-1, size)
        self.u = matrix(u)
        at = [np.searchsorted(self.nodes, np.asarray(x, np.int64)) for x in paths.nodes]
        self.soft = embed.Softmax.of(at, [np.asarray(x, float) for x in paths.signs], matrix(inner))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tokens, np.asarray(ids, np.int64))


def _binned(pieces: DataFrame, need: DataFrame, paths: DataFrame, weights: DataFrame) -> DataFrame:
    """All that a bin works on: bin, part, id, vec, nodes, signs, doc_id, first. Parts u and inner have vec, path its nodes and signs, doc its ids as nodes."""
    vectors = need.join(weights, ["part", "id"]).select("bin", "part", "id", "vec")
    steps = paths.select("bin", F.lit("path").alias("part"), "id", F.col("steps.node").alias("nodes"), F.col("steps.sign").alias("signs"))
    docs = pieces.select("bin", F.lit("doc").alias("part"), F.col("ids").alias("nodes"), "doc_id", "first")
    return vectors.unionByName(steps, allowMissingColumns=True).unionByName(docs, allowMissingColumns=True)


def _documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bin's documents, in order."""
    return pdf[pdf.part == "doc"].sort_values(["doc_id", "first"])


def forward(tokens: DataFrame, codes: DataFrame, network: Network, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, pos, loss of each token after its document's first."""
    pieces, w = deal(tokens, part_tokens), network.w
    binned = _binned(pieces, *needs(pieces, codes), network.weights)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = _Part(pdf, len(w)), []
        for d in _documents(pdf).itertuples():
            losses = embed.rnn_document(part.place(d.nodes), part.u, w.copy(), part.soft, 0.0, 0, learn=False)
            out.append(pd.DataFrame({"doc_id": d.doc_id, "pos": int(d.first) + 1 + np.arange(len(losses)), "loss": losses}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "pos": [], "loss": []})

    return binned.groupBy("bin").applyInPandas(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, pos long, loss double")


def _learner(w: np.ndarray, config: embed.VectorConfig, steps: int):
    return lambda pdf: _learned(_Part(pdf, config.size), _documents(pdf), w, config.rate, steps)


def _learned(part: _Part, docs: pd.DataFrame, w: np.ndarray, rate: float, steps: int) -> pd.DataFrame:
    """part, id, vec, uses: changes times uses of u and inner nodes, w (a row a bin) times steps, and the loss."""
    old_u, old_inner, w = part.u.copy(), part.soft.inner.copy(), w.copy()
    uses, visits, losses = np.zeros(len(old_u), int), np.zeros(len(old_inner), int), []
    for ids in docs.nodes:
        doc = part.place(ids)
        losses += embed.rnn_document(doc, part.u, w, part.soft, rate, steps)
        np.add.at(uses, doc[:-1], 1)
        for t in doc[1:]:
            visits[part.soft.paths[t]] += 1
    rows = [("u", i, x, n) for i, x, n in zip(part.tokens, (part.u - old_u) * uses[:, None], uses, strict=True) if n]
    rows += [("inner", i, x, n) for i, x, n in zip(part.nodes, (part.soft.inner - old_inner) * visits[:, None], visits, strict=True) if n]
    rows += [("w", 0, w.ravel() * len(losses), len(losses)), ("loss", 0, [sum(losses)], len(losses))]
    return pd.DataFrame(rows, columns=["part", "id", "vec", "uses"])


def train(tokens: DataFrame, codes: DataFrame, config: embed.VectorConfig, steps: int = 3, *, network: Network | None = None, part_tokens: int = PART_TOKENS) -> tuple[Network, list[float]]:
    """The network after config.epochs, and the mean loss of each epoch.

    With one part an epoch is that of embed.rnn on the same documents. network continues from another. What comes to the driver is
    w and the loss, k * k + 1 sums an epoch. Without a step from a token to another the start is given back.
    """
    network = network or start(codes, config)
    pieces, k = cut(deal(tokens, part_tokens)), config.size
    need, paths = needs(pieces, codes)
    losses = []
    for _ in range(config.epochs):
        told = cut(_binned(pieces, need, paths, network.weights).groupBy("bin").applyInPandas(_learner(network.w, config, steps), "part string, id long, vec array<double>, uses long"))
        few = told.where("part IN ('w', 'loss')").select("part", "uses", F.posexplode("vec").alias("at", "x"))
        sums = few.groupBy("part", "at").agg(F.sum("x").alias("x"), F.sum("uses").alias("n")).collect()
        if not sums:
            break
        new = {(r["part"], r["at"]): r["x"] / r["n"] for r in sums}
        losses.append(new.pop(("loss", 0)))
        changed = told.where("part IN ('u', 'inner')")
        moves = summed(changed, ["part", "id"], F.lit(1.0), "vec", k).join(changed.groupBy("part", "id").agg(F.sum("uses").alias("uses")), ["part", "id"])
        both = network.weights.join(moves, ["part", "id"], "left")
        to = F.zip_with("vec", "grad", lambda v, g: v + g / F.col("uses"))
        network = Network(cut(both.select("part", "id", F.coalesce(to, F.col("vec")).alias("vec"))), np.array([new["w", i] for i in range(k * k)]).reshape(k, k))
    return network, losses
