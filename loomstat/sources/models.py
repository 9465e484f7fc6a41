"""Model tables to text and back: coefficients, trees, clusters, topics, vectors, Huffman codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import topics, trees
from loomstat.sources.text import read_columns, write_tsv


def save_coefficients(weights: DataFrame, path: str) -> None:
    """name, w with ten decimals."""
    write_tsv(weights, path, {"name": "%s", "w": "%.10f"})


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, "name string, w double").select("name", "w")


def save_vectors(vectors: DataFrame, path: str, key: str = "token", vec: str = "vec", digits: int = 3) -> None:
    """The key and the vector's components, tab-separated."""
    parts = F.transform(vec, lambda x: F.format_string(f"%.{digits}f", x))
    vectors.select(F.concat_ws("\t", F.col(key).cast("string"), F.array_join(parts, "\t")).alias("value")).write.text(path)


def load_vectors(spark: SparkSession, path: str, key: str = "token") -> DataFrame:
    parts = F.split("value", "\t", -1)
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("double"))
    return spark.read.text(path).select(parts[0].alias(key), numbers.alias("vec"))


def save_trees(found: list[list[tuple]], spark: SparkSession, path: str) -> None:
    """Trees as one Parquet table: tree and the columns of trees.TREE_SCHEMA, breadth-first."""
    rows = [(i, *r) for i, t in enumerate(found) for r in t]
    spark.createDataFrame(rows, "tree int, " + trees.TREE_SCHEMA).coalesce(1).write.parquet(path)


def load_trees(spark: SparkSession, path: str) -> list[list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in spark.read.parquet(path).orderBy("tree", "idx").collect():  # a model, not data
        out.setdefault(r["tree"], []).append(tuple(r)[1:])
    return [out[i] for i in sorted(out)]


def save_tree_text(tree: list[tuple], spark: SparkSession, path: str) -> None:
    """One tree as tab-separated text with a header, as the text scorer reads it."""
    df = spark.createDataFrame(tree, trees.TREE_SCHEMA).drop("n").withColumnRenamed("idx", "n")
    named = df.select("n", "leaf", F.col("attr").alias("Attr"), "aval", F.col("wei").alias("Node_wei"), F.col("loss").alias("Node_loss"), "left", "right")
    named.coalesce(1).orderBy("n").write.option("sep", "\t").option("header", True).csv(path)


def save_clusters(assigned: DataFrame, centers: list[list[float]], path: str) -> None:
    """clsid (row, cluster, distance) and cents (cluster_0000 and its components) below path."""
    write_tsv(assigned, f"{path}/clsid", {"row_id": "%d", "cls": "%d", "dist": "%.6f"})
    table = assigned.sparkSession.createDataFrame([(f"cluster_{i:04d}", [float(x) for x in c]) for i, c in enumerate(centers)], "name string, vec array<double>")
    save_vectors(table, f"{path}/cents", "name", digits=6)


def save_communities(comm: DataFrame, path: str) -> None:
    write_tsv(comm.select(F.col("node").cast("string"), F.col("comm").cast("string")), path, {"node": "%s", "comm": "%s"})


def save_topics(tokens: DataFrame, k: int, path: str) -> None:
    """doc_topic and word_topic with a column a topic, and token_topic, as Parquet below path."""
    topics.pivoted(tokens, "doc", k).write.parquet(f"{path}/doc_topic")
    topics.pivoted(tokens, "word", k).write.parquet(f"{path}/word_topic")
    tokens.write.parquet(f"{path}/token_topic")


def save_local_topics(tokens: DataFrame, k: int, path: str) -> None:
    """save_topics of the global tokens, and word_local with a column a local, as Parquet below path."""
    save_topics(tokens, k, path)
    topics.local_words(tokens).write.parquet(f"{path}/word_local")


def save_region_topics(tokens: DataFrame, k: int, regions: int, path: str) -> None:
    """doc_topic and word_topic with a column a topic 0 .. k - 1, word_local with one a region, local_disp and token_topic, as Parquet below path."""
    shared = tokens.withColumn("t", F.when(F.col("x") == 0, F.col("t")))
    for row in ("doc", "word"):
        topics.pivoted(shared, row, k, "t", 0).write.parquet(f"{path}/{row}_topic")
    topics.region_words(tokens, regions).write.parquet(f"{path}/word_local")
    topics.region_dispersion(tokens).write.parquet(f"{path}/local_disp")
    tokens.write.parquet(f"{path}/token_topic")


def save_huffman(codes: DataFrame, path: str) -> None:
    codes.write.parquet(path)


def load_huffman(spark: SparkSession, path: str) -> DataFrame:
    """token, cnt, id, path, code: the vocabulary and its tree."""
    return spark.read.parquet(path)


def save_matrix(matrix: np.ndarray, spark: SparkSession, path: str) -> None:
    """id and its vector, a row of the matrix each."""
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(matrix)], "id int, vec array<double>").write.parquet(path)


def load_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["vec"] for r in spark.read.parquet(path).orderBy("id").collect()])  # a model, not data


def load_network(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The matrices u, w and inner that embed.rnn gave out, by name."""
    parts: dict[str, list] = {}
    for r in spark.read.parquet(path).where("part <> 'loss'").orderBy("part", "id").collect():  # a model, not data
        parts.setdefault(r["part"], []).append(r["vec"])
    return {name: np.array(rows) for name, rows in parts.items()}


def save_scores(scores: DataFrame, path: str, digits: int = 10) -> None:
    """row_id, f in order of rows within partitions."""
    write_tsv(scores, path, {"row_id": "%d", "f": f"%.{digits}f"})
