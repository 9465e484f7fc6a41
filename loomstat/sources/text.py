"""Tab-separated text sources and sinks. Every row carries an explicit row_id in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.scratch import cut


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, value: the trimmed lines that aren't empty, numbered from 0 without gaps.

    Files count in order of their paths and lines in order of their place, however Spark splits and deals them: each split's
    lines are counted first, a row a split, and the splits before a line are added to its place in its own. The counts go to
    all tasks, so lines stay where they are read.
    """
    lines = spark.read.text(path).select(scalar.trim(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where("value <> ''").withColumn("at", F.monotonically_increasing_id())
    splits = cut(lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("at") - F.col("first")
    changed = F.raise_error(F.lit("a file or the size of splits has changed since the lines were counted")).cast("long")
    return lines.join(F.broadcast(splits), ["file", "start"], "left").select(F.when((place >= 0) & (place < F.col("n")), F.col("before") + place).otherwise(changed).alias("row_id"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, fields of every line that isn't empty after trimming; row_id as in numbered_lines."""
    return numbered_lines(spark, path).select("row_id", scalar.split_keep_empty(F.col("value"), "\t").alias("fields"))


def read_sparse(spark: SparkSession, path: str, *, binary: bool, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows (row_id, label) and features (row_id, pos, name, value) of label, feature[, value] ... lines.

    counted files hold the number of features after the label. Names keep their full length; values that are no number are 0.
    """
    lines = read_lines(spark, path)
    skip = 3 if counted else 2
    rows = lines.select("row_id", scalar.to_double(F.col("fields")[0]).alias("label"))
    rest = lines.select("row_id", F.expr(f"slice(fields, {skip}, greatest(size(fields) - {skip - 1}, 0))").alias("f"))
    if binary:
        feats = rest.select("row_id", F.posexplode("f").alias("pos", "name")).withColumn("value", F.lit(1.0))
    else:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("f") / 2).cast("int") - 1), lambda i: F.struct(F.col("f")[2 * i].alias("name"), scalar.to_double(F.col("f")[2 * i + 1]).alias("value")))
        feats = rest.where("size(f) >= 2").select("row_id", F.posexplode(pairs).alias("pos", "p")).select("row_id", "pos", "p.name", "p.value")
    return rows, feats


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, token of one document a line."""
    return read_lines(spark, path).select(F.col("row_id").alias("doc_id"), F.posexplode("fields").alias("pos", "token"))


def read_columns(spark: SparkSession, path: str, schema: str, delimiter: str = "\t") -> DataFrame:
    """Positional columns of fixed types, with row_id; missing trailing ones are null, numbers parse like those of read_sparse."""
    wanted = [c.split() for c in schema.split(",")]
    parts = F.split(scalar.trim(F.col("value")), delimiter, -1)
    lines = numbered_lines(spark, path).select("row_id", parts.alias("f"))
    cast = {"double": scalar.to_double, "int": lambda c: scalar.to_long(c).cast("int"), "long": scalar.to_long, "string": lambda c: c}
    return lines.select("row_id", *[F.when(F.size("f") > i, cast[t](F.get("f", F.lit(i)))).alias(n) for i, (n, t) in enumerate(wanted)])


def read_topic_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc, word[, topic from 1]."""
    return read_columns(spark, path, "doc string, word string, topic int")


def read_local_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc, local, word[, x[, topic]]."""
    return read_columns(spark, path, "doc string, local string, word string, x int, topic int")


def read_region_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc, word, px, py[, x[, t]]."""
    return read_columns(spark, path, "doc string, word string, px double, py double, x int, t int")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w in both directions."""
    one = read_columns(spark, path, "src string, dst string, w double").where("dst IS NOT NULL").drop("row_id")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """row_id, x, y."""
    return read_columns(spark, path, "x double, y double")


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """row_id, v of width numbers a line, split at white space; a line of another width is an error."""
    lines = numbered_lines(spark, path).select("row_id", F.split(F.trim("value"), r"\s+").alias("f"))
    v = F.transform("f", scalar.to_double)
    return lines.select("row_id", F.when(F.size("f") == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} numbers, found "), F.size("f").cast("string")))).alias("v"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """row_id, score of one number a line."""
    return read_columns(spark, path, "score double")


def read_class_scores(spark: SparkSession, path: str) -> DataFrame:
    """row_id, cls, score of one number a class in each line."""
    return read_lines(spark, path).select("row_id", F.posexplode("fields").alias("cls", "score")).withColumn("score", scalar.to_double(F.col("score")))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """idx, n, leaf, attr, aval, wei, loss, left, right of a text tree; idx is the line's place."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    cols = [c.strip().lower() for c in raw.columns]
    t = raw.toDF(*[{"node_wei": "wei", "node_loss": "loss"}.get(c, c) for c in cols])
    typed = {"n": "int", "leaf": "int", "attr": "string", "aval": "double", "wei": "double", "loss": "double", "left": "int", "right": "int"}
    return t.select(F.col("n").cast("int").alias("idx"), *[F.expr(f"try_cast(`{c}` AS {k})").alias(c) for c, k in typed.items() if c != "n" and c in t.columns])


def write_tsv(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """One tab-separated line a row, columns in the order of formats, each by its printf format."""
    line = F.concat_ws("\t", *[F.format_string(f, F.col(c)) for c, f in formats.items()])
    df.select(line.alias("value")).write.text(path)
