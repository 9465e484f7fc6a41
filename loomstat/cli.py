"""Programs on text files: python -m loomstat.cli PROGRAM --train FILE --out DIR [options]."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import cluster, embed, encode, graph, latent_tables, linear, metrics, network_parts, path_softmax, topics, trees
from loomstat.session import local_session
from loomstat.sources import models, text

PROGRAMS = ["lr", "latent", "batch", "gbm", "gblr", "gbrank", "kmeans", "gauss2d", "louvain", "lda", "local-lda", "region-lda", "w2v", "d2v", "rnn", "score"]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomstat")
    p.add_argument("program", choices=PROGRAMS)
    p.add_argument("--train", required=True, help="input file")
    p.add_argument("--test", help="test file in the same layout")
    p.add_argument("--out", required=True)
    p.add_argument("--binary", action="store_true", help="features without values")
    p.add_argument("--mode", choices=["exact", "distributed"], default="distributed")
    for name, kind, value in (("rate", float, None), ("lam", float, 0.0), ("norm", int, 1), ("iterations", int, None), ("k", int, None), ("leaves", int, 2), ("depth", int, 1), ("width", int, 0), ("window", int, None), ("margin", float, 1.0), ("seed", int, 0), ("alpha", float, 0.05), ("beta", float, 0.01), ("regions", int, 30), ("min-potential", float, 1000.0), ("leaf-cost", float, 0.0), ("weight-cost", float, 0.0), ("min-rows", int, 0)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--init", help="start scores (boosting; one a class in each line for gbm), trees (score), or the folder of a model to continue (w2v, d2v, rnn)")
    p.add_argument("--fixed", choices=["inner", "documents"], help="vectors that keep their values (d2v; w2v: inner)")
    p.add_argument("--test-init", help="start scores of the test file (boosting)")
    p.add_argument("--save-every", type=int, default=0, help="save the coefficients after each so many epochs or steps, too")
    p.add_argument("--decay", type=float, default=0.0, help="lr: the rate falls by 1 / (1 + decay * epoch)")
    a = p.parse_args(argv)
    net = embed.NetworkConfig()
    usual = {"rate": net.rate, "k": net.size, "window": net.window, "iterations": net.epochs} if a.program == "rnn" else {"k": 2, "window": 5, "iterations": 10}
    for name, value in usual.items():
        if getattr(a, name) is None:
            setattr(a, name, value)
    if a.rate is None and a.program in ("lr", "latent", "gbm", "gblr", "gbrank", "score"):
        p.error("--rate is needed: nothing is learned at rate 0")
    return a


def dictionary(features: DataFrame) -> DataFrame:
    return encode.first_appearance(features.select("name", (F.col("row_id") * (1 << 24) + F.col("pos")).alias("at")), "name", "at")


def report(name: str, scored: DataFrame) -> None:
    r = metrics.auc(scored, "z", "label").join(scored.agg(metrics.logistic_loss(F.col("z"), F.col("label")).alias("loss"))).first()
    print(f"{name}: loss {r['loss']:.6f}, auc {r['auc']}")


def report_classes(name: str, scores: DataFrame) -> None:
    p = trees.softmax_gradients(scores).select("row_id", "cls", "label", "p")
    r = metrics.multiclass_loss(p, "p", "cls", "label").first()
    print(f"{name}: loss {r['loss'] / max(1, r['n']):.6f}, auc {metrics.multiclass_auc(p, 'p', 'cls', 'label').first()['auc']}")


def regression(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, feats = text.read_sparse(spark, a.train, binary=a.binary)
    names = dictionary(feats)
    config = linear.LogisticConfig(rate=a.rate or 0.0, decay=a.decay, lam=a.lam, norm=a.norm, epochs=a.iterations, hidden=a.k, seed=a.seed)
    sets = {name: text.read_sparse(spark, path, binary=a.binary) for name, path in (("train", a.train), ("test", a.test)) if path}
    if a.program == "latent":
        latent(spark, a, sets, names, config)
        return

    def step(number: int, weights: DataFrame) -> None:
        for name, data in sets.items():
            report(f"{number} {name}", linear.linear_scores(*data, weights))
        if a.save_every and number % a.save_every == 0:
            models.save_coefficients(weights, f"{a.out}/coe_{number}")

    if a.program == "batch":
        weights = linear.fit_batch(rows, feats, names, lam=a.lam, norm=a.norm, iterations=a.iterations, report=step)
    else:
        weights = linear.fit_sgd(rows, feats, names, config, mode=a.mode, report=step)
    weights = weights.persist()
    models.save_coefficients(weights, f"{a.out}/coe")
    for name, data in sets.items():
        report(name, linear.linear_scores(*data, weights))


def latent(spark: SparkSession, a: argparse.Namespace, sets: dict[str, tuple[DataFrame, DataFrame]], names: DataFrame, config: linear.LogisticConfig) -> None:
    """A report and, if wanted, a model after each epoch, and the last one; rows in order (exact) or in steps over tables."""

    def save(layer: latent_tables.Layer, path: str) -> None:
        outer = spark.createDataFrame([("output weights", layer.outer.tolist())], "name string, v array<double>")
        models.save_vectors(layer.inner.select("name", F.col("vec").alias("v")).unionByName(outer), path, "name", "v", 10)

    def step(number: int, layer: latent_tables.Layer) -> None:
        for name, data in sets.items():
            report(f"{number} {name}", latent_tables.forward(*data, layer))
        if a.save_every and number % a.save_every == 0:
            save(layer, f"{a.out}/coe_{number}")

    if a.mode == "exact":
        for number, part in linear.latent_epochs(*sets["train"], names, config, partitions=1):
            outer = np.array(part.where("name IS NULL").first()["v"])
            layer = latent_tables.Layer(part.where("name IS NOT NULL").select("name", F.col("v").alias("vec")), outer)
            step(number, layer)
    else:
        layer = latent_tables.train(*sets["train"], names, config, report=step)[0]
    save(layer, f"{a.out}/coe")


def boosting(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, feats = text.read_sparse(spark, a.train, binary=a.binary)
    config = trees.BoostConfig(rate=a.rate, trees=a.iterations, leaves=a.leaves, depth=a.depth, leaf_cost=a.leaf_cost, weight_cost=a.weight_cost, min_rows=a.min_rows, binary=a.binary, margin=a.margin, seed=a.seed)
    many = a.program == "gbm"
    starts = {name: (text.read_class_scores if many else text.read_scores)(spark, path) if path else None for name, path in (("train", a.init), ("test", a.test_init))}
    test = text.read_sparse(spark, a.test, binary=a.binary) if a.test else None
    last: dict[str, DataFrame] = {}

    def step(number: int, name: str, scores: DataFrame) -> None:
        last[name] = scores
        if many:
            report_classes(f"{number} {name}", scores)
        else:
            report(f"{number} {name}", scores.withColumnRenamed("f", "z"))

    run = {"gbm": trees.boost_multiclass, "gblr": trees.boost_binary, "gbrank": trees.boost_rank}[a.program]
    found, scores = run(rows, feats, config, init=starts["train"], test=test, test_init=starts["test"], report=step)
    if many:
        for cls in sorted({c for c, _ in found}):
            models.save_trees([t for c, t in found if c == cls], spark, f"{a.out}/class_{cls}")
    else:
        models.save_trees(found, spark, f"{a.out}/trees")
    for name, final in (last or {"train": scores}).items():
        models.save_scores(final, f"{a.out}/{name}_scores") if not many else final.write.parquet(f"{a.out}/{name}_scores")


def clusters(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.program == "kmeans":
        points = text.read_matrix(spark, a.train, a.width)
        centers = [r["v"] for r in text.read_matrix(spark, a.init, a.width).collect()] if a.init else None  # k centers
        models.save_clusters(*cluster.kmeans(points, "v", a.k, centers=centers, max_iterations=a.iterations, min_potential=a.min_potential, seed=a.seed), a.out)
    elif a.program == "gauss2d":
        assigned, stats = cluster.gaussian_clusters(text.read_points(spark, a.train), a.k, max_iterations=a.iterations, seed=a.seed)
        assigned.write.parquet(f"{a.out}/assign")
        spark.createDataFrame(stats).write.parquet(f"{a.out}/centers")
    else:
        models.save_communities(graph.louvain(text.read_edges(spark, a.train), mode=a.mode), f"{a.out}/communities")


def sampled(spark: SparkSession, a: argparse.Namespace) -> None:
    common = {"alpha": a.alpha, "beta": a.beta, "topics": a.k, "sweeps": a.iterations, "seed": a.seed}
    read = {"lda": text.read_topic_tokens, "local-lda": text.read_local_tokens, "region-lda": text.read_region_tokens}[a.program]
    tokens = read(spark, a.train).withColumnRenamed("row_id", "pos")
    if a.program == "lda":
        models.save_topics(topics.lda(tokens, topics.TopicConfig(**common), a.mode).persist(), a.k, a.out)
    elif a.program == "local-lda":
        models.save_local_topics(topics.local_lda(tokens, topics.LocalConfig(**common), a.mode).persist(), a.k, a.out)
    else:
        models.save_region_topics(topics.region_lda(tokens, topics.RegionConfig(**common, regions=a.regions), a.mode).persist(), a.k, a.regions, a.out)


def vectors(spark: SparkSession, a: argparse.Namespace) -> None:
    tokens = text.read_tokens(spark, a.train)
    kind = embed.NetworkConfig if a.program == "rnn" else embed.VectorConfig
    config = kind(rate=a.rate or 0.025, size=a.k, window=a.window, epochs=a.iterations, seed=a.seed)
    codes = models.load_huffman(spark, f"{a.init}/huffman") if a.init else embed.huffman_codes(embed.vocabulary(tokens))
    models.save_huffman(codes, f"{a.out}/huffman")
    vocab = codes.select("token", "cnt", "id")
    if a.program == "rnn" and a.mode == "distributed":
        known = tokens.join(vocab, "token").select("doc_id", "pos", "id")
        network = network_parts.loaded(spark.read.parquet(f"{a.init}/network")) if a.init else None
        network, losses = network_parts.train(known, path_softmax.paths(codes), config, a.window, network=network)
        told = spark.createDataFrame([("loss", i, [x]) for i, x in enumerate(losses)], "part string, id int, vec array<double>")
        network.table().unionByName(told).write.parquet(f"{a.out}/network")
        return
    if a.program == "rnn":
        start = models.load_network(spark, f"{a.init}/network") if a.init else None
        embed.rnn(tokens, config, a.window, vocab=vocab, start=start).write.parquet(f"{a.out}/network")
        return
    inner = models.load_matrix(spark, f"{a.init}/inner") if a.init else None
    if a.program == "w2v":
        start = vocab.join(models.load_vectors(spark, f"{a.init}/vector"), "token").orderBy("id") if a.init else None
        start = np.array([r["vec"] for r in start.collect()]) if a.init else None  # a model, not data
        found, inner = embed.word_vectors(tokens, config, vocab=vocab, start=start, inner=inner, fixed=a.fixed == "inner")
        models.save_vectors(found, f"{a.out}/vector", digits=10)
    else:
        start = models.load_vectors(spark, f"{a.init}/dvector", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")) if a.init else None
        found, inner = embed.train_documents(tokens, config, vocab=vocab, start=start, inner=inner, fixed=a.fixed)
        models.save_vectors(found, f"{a.out}/dvector", "doc_id", digits=10)
    models.save_matrix(inner, spark, f"{a.out}/inner")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, feats = text.read_sparse(spark, a.train, binary=a.binary)
    trees.score_trees(rows, feats, models.load_trees(spark, a.init), a.rate).write.parquet(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    run = {"lr": regression, "latent": regression, "batch": regression, "gbm": boosting, "gblr": boosting, "gbrank": boosting, "kmeans": clusters, "gauss2d": clusters, "louvain": clusters, "lda": sampled, "local-lda": sampled, "region-lda": sampled, "w2v": vectors, "d2v": vectors, "rnn": vectors, "score": score}
    run[a.program](spark, a)


if __name__ == "__main__":
    main()
