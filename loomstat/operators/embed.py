"""Word vectors, document vectors and a recurrent language model, all with hierarchical softmax over a Huffman tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions import order
from loomstat.scratch import cut


#: Tokens of a partition, where a configuration names no number of partitions.
PART_TOKENS = 250_000


@dataclass
class VectorConfig:
    """Without partitions there are as many as it takes at PART_TOKENS tokens each."""

    rate: float = 0.025
    size: int = 20
    window: int = 5
    epochs: int = 5
    partitions: int | None = None
    seed: int = 0

    def shares(self, tokens: int) -> int:
        return self.partitions or max(1, -(-tokens // PART_TOKENS))

    def __post_init__(self) -> None:
        if self.window < 2:
            raise ValueError("window is 2 at least")


@dataclass
class NetworkConfig(VectorConfig):
    """The recurrent network's own defaults."""

    rate: float = 0.001
    size: int = 50
    window: int = 3
    epochs: int = 1


def vocabulary(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """token, cnt, id by falling count, ties by token; of all tokens, or of so many of the most frequent ones."""
    counted = tokens.groupBy("token").agg(F.count("*").alias("cnt")).withColumn("__less", -F.col("cnt"))
    if most is not None:
        counted = counted.orderBy("__less", "token").limit(most)
    return order.numbered(counted, "__less", [F.col("token")], "id").drop("__less")


def huffman(counts: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Paths (inner nodes from the root) and codes of tokens in falling order of count.

    Two queues, leaves from the rarest on and inner nodes in order of making; of equal counts the leaf goes first. The first of a pair gets 0.
    """
    v = len(counts)
    if v == 1:
        return [[0]], [[0]]
    weight, parent, bit = list(counts) + [0] * (v - 1), [0] * (2 * v - 1), [0] * (2 * v - 1)
    leaf, inner = v - 1, v
    for made in range(v, 2 * v - 1):
        for b in (0, 1):
            if leaf >= 0 and (inner >= made or weight[leaf] <= weight[inner]):
                pick, leaf = leaf, leaf - 1
            else:
                pick, inner = inner, inner + 1
            parent[pick], bit[pick] = made, b
            weight[made] += weight[pick]
    paths, codes = [], []
    for i in range(v):
        path, code, node = [], [], i
        while node != 2 * v - 2:
            code.append(bit[node])
            node = parent[node]
            path.append(node - v)
        paths.append(path[::-1])
        codes.append(code[::-1])
    return paths, codes


def huffman_runs(runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The tree of huffman() from runs (count, how many tokens) in falling order of count: leaf and inner segments.

    A segment (first, base, width, bit) tells where the items from place first on go: with width 2 in pairs to the inner nodes from base on,
    the first of a pair with 0, with width 1 a single item to node base with this bit. Leaves have their places in the order in which they are
    picked (the last token first), inner nodes in order of making. There are about as many segments as different counts.
    """
    leaves, inner = [[c, n] for c, n in reversed(runs)], []
    at, made, segments = {"leaf": 0, "inner": 0}, 0, {"leaf": [], "inner": []}
    first = {"leaf": 0, "inner": 0}  # of the queues' runs
    queues = {"leaf": leaves, "inner": inner}
    left = sum(n for _, n in runs)

    def front() -> str:
        leaf = leaves[first["leaf"]][0] if first["leaf"] < len(leaves) else None
        own = inner[first["inner"]][0] if first["inner"] < len(inner) else None
        return "leaf" if own is None or leaf is not None and leaf <= own else "inner"

    def take(kind: str, n: int, width: int, bit: int) -> int:
        run = queues[kind][first[kind]]
        segments[kind].append((at[kind], made, width, bit))
        at[kind] += n
        run[1] -= n
        if not run[1]:
            first[kind] += 1
        return run[0]

    while left > 1:
        kind = front()
        pairs = queues[kind][first[kind]][1] // 2
        if pairs:
            inner.append([2 * take(kind, 2 * pairs, 2, 0), pairs])
        else:
            pairs, weight = 1, take(kind, 1, 1, 0)
            inner.append([weight + take(front(), 1, 1, 1), 1])
        made += pairs
        left -= pairs
    return np.array(segments["leaf"], np.int64).reshape(-1, 4), np.array(segments["inner"], np.int64).reshape(-1, 4)


def _up(place: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner nodes above places, and the bits that lead down from them."""
    first, base, width, bit = segments[np.searchsorted(segments[:, 0], place, "right") - 1].T
    return base + (place - first) // width, np.where(width == 2, (place - first) % 2, bit)


def huffman_paths(ids: np.ndarray, tokens: int, leaf: np.ndarray, inner: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Paths and codes of the tokens of these ids among so many tokens, from huffman_runs()."""
    if tokens == 1:
        return [[0] for _ in ids], [[0] for _ in ids]
    node, bit = _up(tokens - 1 - ids, leaf)
    steps = [(np.arange(len(ids)), node, bit)]
    while len(steps[-1][0]):
        rows, node, _ = steps[-1]
        on = node < tokens - 2  # not the root
        node, bit = _up(node[on], inner) if on.any() else (node[on], node[on])
        steps.append((rows[on], node, bit))
    paths, codes = [[] for _ in ids], [[] for _ in ids]
    for rows, nodes, bits in reversed(steps):
        for row, n, b in zip(rows.tolist(), nodes.tolist(), bits.tolist(), strict=True):
            paths[row].append(n)
            codes[row].append(b)
    return paths, codes


def huffman_codes(vocab: DataFrame) -> DataFrame:
    """token, cnt, id, path, code, for a vocabulary whose ids from 0 fall with the count.

    Only the different counts and how many tokens have each come to the driver; paths are worked out where the tokens lie.
    """
    runs = [(r["cnt"], r["n"]) for r in vocab.groupBy("cnt").agg(F.count("*").alias("n")).orderBy(F.desc("cnt")).collect()]
    tokens, (leaf, inner) = sum(n for _, n in runs), huffman_runs(runs)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, codes = huffman_paths(pdf.id.to_numpy(), tokens, leaf, inner)
            yield pdf.assign(path=paths, code=codes)

    return vocab.select("token", F.col("cnt").cast("long").alias("cnt"), F.col("id").cast("int").alias("id")).mapInPandas(coded, "token string, cnt long, id int, path array<int>, code array<int>")


def context_pairs(tokens: DataFrame, window: int) -> DataFrame:
    """doc_id, pos, other for every token and the other places of its window.

    The window is `window` consecutive places. It starts window // 2 places before the token where the document has room on both
    sides; nearer to an end it lies at that end.
    """
    n = F.count("*").over(Window.partitionBy("doc_id"))
    t = tokens.select("doc_id", "pos", n.alias("n"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - window // 2, F.col("n") - window))
    t = t.withColumn("st", start).withColumn("other", F.explode(F.sequence("st", F.least(F.col("st") + window, F.col("n")) - 1)))
    return t.where("other <> pos").select("doc_id", "pos", "other")


def context_means(tokens: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """doc_id, pos, mean of the context tokens' vectors (token, vec)."""
    placed = tokens.join(vectors, "token").select("doc_id", F.col("pos").alias("other"), "vec")
    parts = context_pairs(tokens, window).join(placed, ["doc_id", "other"]).select("doc_id", "pos", F.posexplode("vec").alias("at", "x"))
    m = parts.groupBy("doc_id", "pos", "at").agg(F.avg("x").alias("x"))
    return m.groupBy("doc_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


class Softmax:
    """Inner nodes of the tree and one step of learning."""

    def __init__(self, counts: list[int], size: int):
        paths, codes = huffman(counts)
        self.paths, self.signs = [np.array(p) for p in paths], [1 - 2 * np.array(c, float) for c in codes]
        self.inner = np.zeros((max(1, len(counts) - 1), size))

    @classmethod
    def of(cls, paths: list[np.ndarray], signs: list[np.ndarray], inner: np.ndarray) -> Softmax:
        """A part of a tree, its tokens and nodes numbered by place."""
        self = cls.__new__(cls)
        self.paths, self.signs, self.inner = paths, signs, inner
        return self

    def step(self, h: np.ndarray, token: int, rate: float, learn: bool = True) -> tuple[float, np.ndarray]:
        """Loss of token given h, and its gradient on h; inner nodes move along."""
        p, out = self.pull(h, token, rate, learn)
        return float(-np.log(np.maximum(p, 1e-12)).sum()), out

    def pull(self, h: np.ndarray, token: int, rate: float, learn: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """step() without the loss: the chances of the turns of token's path, and the gradient on h."""
        path, sign = self.paths[token], self.signs[token]
        rows = self.inner[path]
        p = 1 / (1 + np.exp(-np.maximum(np.minimum(sign * (rows @ h), 30), -30)))
        g = (1 - p) * sign
        if learn:
            self.inner[path] = rows + (rate * g)[:, None] * h
        return p, g @ rows


def averaged(parts: DataFrame, *keys: str) -> list:
    """keys and vec of rows (keys, share, vec, n): the mean of the shares' vectors weighed by n, always added up in order of share."""
    one = F.transform(F.sort_array(F.collect_list(F.struct("share", F.transform("vec", lambda x: x * F.col("n")).alias("vec")))), lambda s: s["vec"])  # as many as partitions
    total = F.aggregate("all", F.transform(F.get("all", F.lit(0)), lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return parts.where("n > 0").groupBy(*keys).agg(one.alias("all"), F.sum("n").alias("n")).select(*keys, F.transform(total, lambda x: x / F.col("n")).alias("vec")).collect()  # a row a vector


def documents(tokens: DataFrame, vocab: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, ids: token ids in order, of documents with at least so many known tokens."""
    known = tokens.join(vocab.select("token", "id"), "token")
    d = known.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return d.where(F.size("ids") >= least)


def word_vectors(tokens: DataFrame, config: VectorConfig, *, vocab: DataFrame | None = None, start: np.ndarray | None = None, inner: np.ndarray | None = None, fixed: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(token, cnt, id, vec) and the inner vectors: context means predict each token.

    Documents are dealt over config.shares() partitions; each epoch the partitions learn from common vectors, which are then averaged. vocab,
    start (vectors in id order) and inner continue from a model; fixed keeps the inner vectors as they are.
    """
    c = config
    vocab = vocabulary(tokens) if vocab is None else vocab
    words = vocab.orderBy("id").collect()
    cnt = [r["cnt"] for r in words]
    v = len(words)
    rng = np.random.default_rng(c.seed)
    vec = start if start is not None else (rng.random((v, c.size)) - 0.5) / max(1, v)
    inner = inner if inner is not None else np.zeros((max(1, v - 1), c.size))
    shares = c.shares(sum(cnt))
    docs = documents(tokens, vocab, 2).repartition(shares, "doc_id").sortWithinPartitions("doc_id").persist()
    total = sum(cnt) * c.epochs
    for epoch in range(c.epochs):

        def learn(batches: Iterator[pd.DataFrame], vec=vec, inner=inner, epoch=epoch) -> Iterator[pd.DataFrame]:
            own, soft, seen, n = vec.copy(), Softmax(cnt, c.size), sum(cnt) * epoch, 0
            soft.inner[:] = inner
            for pdf in batches:
                for ids in pdf.ids:
                    ids = [int(x) for x in ids]
                    rate = c.rate * max(1e-4, 1 - seen / (total + 1))
                    for i, token in enumerate(ids):
                        lo = max(0, min(i - c.window // 2, len(ids) - c.window))
                        near = ids[lo:i] + ids[i + 1 : lo + c.window]
                        _, g = soft.pull(np.add.reduce(own[near], 0) / len(near), token, rate, not fixed)
                        g = rate * g
                        for x in near:  # a token may be there twice
                            own[x] += g
                    seen, n = seen + len(ids) * shares, n + len(ids)
            yield pd.DataFrame({"kind": [0] * v + [1] * len(soft.inner), "id": [*range(v), *range(len(soft.inner))], "share": TaskContext.get().partitionId(), "vec": [*own.tolist(), *soft.inner.tolist()], "n": n})

        parts = averaged(docs.mapInPandas(learn, "kind int, id int, share int, vec array<double>, n long"), "kind", "id")
        if not parts:
            break
        vec, inner = vec.copy(), inner.copy()
        for r in parts:
            (vec if r["kind"] == 0 else inner)[r["id"]] = r["vec"]
    docs.unpersist()
    out = tokens.sparkSession.createDataFrame([(r["token"], r["cnt"], r["id"], vec[r["id"]].tolist()) for r in words], "token string, cnt long, id int, vec array<double>")
    return out, inner


def document_vectors(tokens: DataFrame, vocab: DataFrame, inner: np.ndarray, config: VectorConfig) -> DataFrame:
    """doc_id, vec: a vector that predicts each of its document's tokens. Inner vectors are fixed, so documents are independent."""
    c = config
    cnt = [r["cnt"] for r in vocab.orderBy("id").collect()]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        soft = Softmax(cnt, inner.shape[1])
        soft.inner[:] = inner
        for pdf in batches:
            out = []
            for ids in pdf.ids:
                vec = (np.random.default_rng([c.seed, len(ids)]).random(inner.shape[1]) - 0.5) / inner.shape[1]
                for _ in range(c.epochs):
                    for t in ids:
                        _, g = soft.pull(vec, int(t), c.rate, False)
                        vec = vec + c.rate * g
                out.append(vec.tolist())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "vec": out})

    return documents(tokens, vocab).mapInPandas(learn, f"doc_id {dict(tokens.dtypes)['doc_id']}, vec array<double>")


def train_documents(tokens: DataFrame, config: VectorConfig, *, vocab: DataFrame | None = None, start: DataFrame | None = None, inner: np.ndarray | None = None, fixed: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, vec) and the inner vectors, learned together.

    vocab, start (doc_id, vec) and inner continue from a model; documents that start doesn't have begin at random, tokens that vocab
    doesn't have are left out. fixed keeps the "inner" vectors or those of "documents" as they are.

    Each epoch a partition moves its documents' vectors and its own copy of the inner vectors, which are then averaged by tokens; the
    documents' vectors stay with their rows.
    """
    if fixed not in (None, "inner", "documents"):
        raise ValueError('fixed is None, "inner" or "documents"')
    c, vocab = config, vocabulary(tokens) if vocab is None else vocab
    cnt = [r["cnt"] for r in vocab.orderBy("id").collect()]
    inner = np.zeros((max(1, len(cnt) - 1), c.size)) if inner is None else np.array(inner, float)
    kind = dict(tokens.dtypes)["doc_id"]
    docs, fresh = documents(tokens, vocab), F.array().cast("array<double>")
    docs = docs.withColumn("vec", fresh) if start is None else docs.join(start.select("doc_id", "vec"), "doc_id", "left").withColumn("vec", F.coalesce("vec", fresh))
    docs = cut(docs.repartition(c.shares(sum(cnt)), "doc_id").sortWithinPartitions("doc_id"))
    for _ in range(c.epochs):
        out = cut(docs.mapInPandas(_document_epoch(c, cnt, inner, fixed), f"doc_id {kind}, ids array<int>, vec array<double>, inner int, share int, n long"))
        for r in averaged(out.where("inner IS NOT NULL").select("inner", "share", "vec", "n"), "inner"):
            inner[r["inner"]] = r["vec"]
        docs = out.where("inner IS NULL").select("doc_id", "ids", "vec")
    return docs.select("doc_id", "vec"), inner


def _document_epoch(c: VectorConfig, cnt: list[int], inner: np.ndarray, fixed: str | None = None):
    """One epoch over a partition: its documents with their new vectors, then its inner vectors with its number of tokens, if they move."""
    inner = inner.copy()

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        soft, n = Softmax(cnt, c.size), 0
        soft.inner[:] = inner
        for pdf in batches:
            out = []
            for ids, vec in zip(pdf.ids, pdf.vec, strict=True):
                vec = np.array(vec) if len(vec) else (np.random.default_rng([c.seed, len(ids)]).random(c.size) - 0.5) / c.size
                for t in ids:
                    _, g = soft.pull(vec, int(t), c.rate, fixed != "inner")
                    if fixed != "documents":
                        vec = vec + c.rate * g
                n += len(ids)
                out.append(vec.tolist())
            yield pdf.assign(vec=out, inner=None, share=None, n=0)
        if fixed != "inner":
            yield pd.DataFrame({"doc_id": None, "ids": None, "vec": soft.inner.tolist(), "inner": range(len(soft.inner)), "share": TaskContext.get().partitionId(), "n": n})

    return learn


def rnn_document(doc: np.ndarray, u: np.ndarray, w: np.ndarray, soft: Softmax, rate: float, steps: int, learn: bool = True) -> list[float]:
    """The loss of each token after the first. The document moves u, w and the inner nodes, w once at its end."""
    states, gw, losses = [np.zeros(len(w))], np.zeros(w.shape), []
    for t in range(len(doc) - 1):
        states.append(1 / (1 + np.exp(-np.clip(u[doc[t]] + w @ states[-1], -30, 30))))
        loss, g = soft.step(states[-1], int(doc[t + 1]), rate, learn)
        losses.append(loss)
        if not learn:
            continue
        for back in range(min(steps, t + 1)):
            s = states[t + 1 - back]
            g = g * s * (1 - s)
            gw += np.outer(g, states[t - back])
            u[doc[t - back]] += rate * g
            g = w.T @ g
    w += rate * gw
    return losses


def rnn_start(v: int, c: VectorConfig) -> dict[str, np.ndarray]:
    """The matrices of a network that has not learned yet."""
    rng, k = np.random.default_rng(c.seed), c.size
    return {"u": (rng.random((v, k)) - 0.5) / np.sqrt(k), "w": (rng.random((k, k)) - 0.5) / np.sqrt(k), "inner": np.zeros((max(1, v - 1), k))}


def rnn_losses(ids: list[np.ndarray], cnt: list[int], c: VectorConfig, steps: int = 3, start: dict[str, np.ndarray] | None = None) -> tuple[list[float], dict[str, np.ndarray]]:
    """Mean next-token loss of each epoch of an Elman network with truncated back-propagation, and its matrices; start continues from such."""
    soft, begin = Softmax(cnt, c.size), rnn_start(len(cnt), c) if start is None else start
    u, w, soft.inner = (np.array(begin[name], float) for name in ("u", "w", "inner"))
    losses = []
    for _ in range(c.epochs):
        total, n = 0.0, 0
        for doc in ids:
            if len(doc) < 2:
                continue
            found = rnn_document(doc, u, w, soft, c.rate, steps)
            total, n = total + sum(found), n + len(found)
        losses.append(total / max(1, n))
    return losses, {"u": u, "w": w, "inner": soft.inner}


def rnn(tokens: DataFrame, config: VectorConfig, steps: int = 3, *, vocab: DataFrame | None = None, start: dict[str, np.ndarray] | None = None) -> DataFrame:
    """part (u, w, inner), id, vec, and the loss of each epoch (part loss).

    With one partition (config.shares) a task takes the documents in order. With several, each epoch every partition learns from
    common matrices, which are then averaged by tokens. vocab and start continue from a model.
    """
    vocab = vocabulary(tokens) if vocab is None else vocab
    cnt = [r["cnt"] for r in vocab.orderBy("id").collect()]

    c, shares = config, config.shares(sum(cnt))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        losses, parts = rnn_losses([np.asarray(x) for x in pdf.ids], cnt, config, steps, start)
        rows = [(name, i, x.tolist()) for name, m in parts.items() for i, x in enumerate(m)]
        return pd.DataFrame(rows + [("loss", i, [x]) for i, x in enumerate(losses)], columns=["part", "id", "vec"])

    kind = "part string, id int, vec array<double>"
    if shares == 1:
        return documents(tokens, vocab, 2).groupBy(F.lit("all")).applyInPandas(run, kind)
    docs = cut(documents(tokens, vocab, 2).repartition(shares, "doc_id").sortWithinPartitions("doc_id"))
    now = {name: np.array(m, float) for name, m in (rnn_start(len(cnt), c) if start is None else start).items() if name in ("u", "w", "inner")}
    losses = []
    for _ in range(c.epochs):

        def learn(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            soft, u, w, total, n = Softmax(cnt, c.size), now["u"].copy(), now["w"].copy(), 0.0, 0
            soft.inner = now["inner"].copy()
            for pdf in batches:
                for doc in pdf.ids:
                    found = rnn_document(np.asarray(doc), u, w, soft, c.rate, steps)
                    total, n = total + sum(found), n + len(found)
            rows = [(name, i, x.tolist()) for name, m in (("u", u), ("w", w), ("inner", soft.inner), ("loss", [np.array([total / max(1, n)])])) for i, x in enumerate(m)]
            yield pd.DataFrame(rows, columns=["part", "id", "vec"]).assign(share=TaskContext.get().partitionId(), n=n)

        now = {name: m.copy() for name, m in now.items()}
        mean = 0.0
        for r in averaged(docs.mapInPandas(learn, f"{kind}, share int, n long"), "part", "id"):
            if r["part"] == "loss":
                mean = r["vec"][0]
            else:
                now[r["part"]][r["id"]] = r["vec"]
        losses.append(mean)
    rows = [(name, i, x.tolist()) for name, m in now.items() for i, x in enumerate(m)]
    return tokens.sparkSession.createDataFrame(rows + [("loss", i, [float(x)]) for i, x in enumerate(losses)], kind)
