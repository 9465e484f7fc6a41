"""Queries over the text sources and sinks: tables are written in a program's text layout and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.operators import embed, trees
from loomstat.plans import fixtures as fx
from loomstat.plans.registry import query
from loomstat.scratch import cut, folder
from loomstat.sources import models, text


def _file(df: DataFrame, order: list[str], line, name: str) -> str:
    """The path of a text file with a line a row of df in the given order."""
    path = folder(df.sparkSession, name)
    df.orderBy(*order).select(line.alias("value")).write.text(path)
    return path


def _tsv(*columns):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


# --- sparse rows and tokens --------------------------------------------------------------------------------------------

FLAG = "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END"
NUMBERED_SQL = f"{fx.LINES_SQL}, num AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM lin)"
VALUED_SQL = "SELECT place AS row_id, label, 0 AS pos, 'qty' AS name, l_quantity AS value FROM num UNION ALL SELECT place, label, 1, 'disc', l_discount FROM num"


def _both(spark: SparkSession, path: str, **layout):
    rows, feats = text.read_sparse(spark, path, **layout)
    return rows.join(feats, "row_id")


@query(f"WITH {NUMBERED_SQL} {VALUED_SQL}")
def scan_sparse(spark, sf):
    line = _tsv(F.expr(FLAG), F.lit("qty"), "l_quantity", F.lit("disc"), "l_discount")
    return _both(spark, _file(fx.lines(spark, sf), ["row_id"], line, "sparse"), binary=False)


@query(f"WITH {NUMBERED_SQL} {VALUED_SQL}")
def scan_sparse_counted(spark, sf):
    line = _tsv(F.expr(FLAG), F.lit("2"), F.lit("qty"), "l_quantity", F.lit("disc"), "l_discount")
    return _both(spark, _file(fx.lines(spark, sf), ["row_id"], line, "counted"), binary=False, counted=True)


@query(f"WITH {NUMBERED_SQL} SELECT place AS row_id, label, 0 AS pos, 'status=' || l_linestatus AS name, 1.0::DOUBLE AS value FROM num UNION ALL SELECT place, label, 1, 'flag=' || l_returnflag, 1.0::DOUBLE FROM num")
def scan_sparse_binary(spark, sf):
    line = _tsv(F.expr(FLAG), F.concat(F.lit("status="), "l_linestatus"), F.concat(F.lit("flag="), "l_returnflag"))
    return _both(spark, _file(fx.lines(spark, sf), ["row_id"], line, "binary"), binary=True)


def _token_file(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _file(docs, ["doc_id"], F.btrim(F.regexp_replace("text", fx.SPACES, "\t"), F.lit("\t")), "tokens")


DENSE_SQL = f"{fx.TOKENS_SQL}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM (SELECT DISTINCT doc_id FROM tok))"


@query(f"WITH {DENSE_SQL} SELECT place AS doc_id, pos, token FROM tok JOIN ids USING (doc_id)")
def scan_tokens(spark, sf):
    return text.read_tokens(spark, _token_file(spark, sf))


@query(f"WITH {DENSE_SQL}, voc AS (SELECT token FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM tok GROUP BY 1) WHERE id < 100) SELECT place AS doc_id, count(*) AS known FROM tok JOIN ids USING (doc_id) JOIN voc USING (token) GROUP BY 1")
def scan_known_tokens(spark, sf):
    """Tokens against a vocabulary that was saved and loaded: the hundred most frequent ones; documents without any go."""
    tokens = text.read_tokens(spark, _token_file(spark, sf))
    path = folder(spark, "vocabulary")
    models.save_huffman(embed.huffman_codes(embed.vocabulary(tokens, most=100)), path)
    return embed.documents(tokens, models.load_huffman(spark, path)).select("doc_id", F.size("ids").cast("long").alias("known"))


# --- topic tokens, edges, points, scores -------------------------------------------------------------------------------

EVENT_SQL = "ev AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events WHERE value IS NOT NULL)"


def _events(spark, sf):
    return fx.table(spark, sf, "events").where("value IS NOT NULL")


@query(f"WITH {EVENT_SQL} SELECT row_id, CAST(user_id AS VARCHAR) AS doc, event_type AS word, CAST(event_id % 5 + 1 AS INTEGER) AS topic FROM ev")
def scan_topic_tokens(spark, sf):
    line = _tsv("user_id", "event_type", F.col("event_id") % 5 + 1)
    return text.read_topic_tokens(spark, _file(_events(spark, sf), ["event_id"], line, "topics"))


@query(f"WITH {EVENT_SQL} SELECT row_id, CAST(user_id AS VARCHAR) AS doc, 'h' || CAST(hour(ts) AS VARCHAR) AS local, event_type AS word, CAST(event_id % 2 AS INTEGER) AS x, CAST(event_id % 5 + 1 AS INTEGER) AS topic FROM ev")
def scan_local_tokens(spark, sf):
    line = _tsv("user_id", F.concat(F.lit("h"), F.hour("ts").cast("string")), "event_type", F.col("event_id") % 2, F.col("event_id") % 5 + 1)
    return text.read_local_tokens(spark, _file(_events(spark, sf), ["event_id"], line, "locals"))


@query(f"WITH {EVENT_SQL} SELECT row_id, CAST(user_id AS VARCHAR) AS doc, event_type AS word, hour(ts)::DOUBLE AS px, value AS py, CAST(event_id % 2 AS INTEGER) AS x, CAST(event_id % 3 AS INTEGER) AS t FROM ev")
def scan_region_tokens(spark, sf):
    return text.read_region_tokens(spark, _region_file(spark, sf))


def _region_file(spark, sf):
    line = _tsv("user_id", "event_type", F.hour("ts"), "value", F.col("event_id") % 2, F.col("event_id") % 3)
    return _file(_events(spark, sf), ["event_id"], line, "regions")


@query(f"WITH {fx.GRAPH_SQL} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, w FROM edg")
def scan_edges(spark, sf):
    return text.read_edges(spark, _file(fx.nation_graph(spark, sf), ["src", "dst"], _tsv("src", "dst", "w"), "edges"))


@query(f"WITH {EVENT_SQL} SELECT row_id, hour(ts)::DOUBLE AS x, value AS y FROM ev")
def scan_points(spark, sf):
    return text.read_points(spark, _file(_events(spark, sf), ["event_id"], _tsv(F.hour("ts"), "value"), "points"))


@query("SELECT e.at AS row_id, CAST(g.i - 1 AS INTEGER) AS i, e.embedding[g.i]::DOUBLE AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, embedding FROM embeddings) e, (SELECT unnest(range(1, 65)) AS i) g")
def scan_matrix(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    line = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    return text.read_matrix(spark, _file(e, ["vec_id"], line, "matrix"), 64).select("row_id", F.posexplode("v").alias("i", "x"))


@query(f"WITH {EVENT_SQL} SELECT row_id, value AS score FROM ev")
def scan_scores(spark, sf):
    return text.read_scores(spark, _file(_events(spark, sf), ["event_id"], _tsv("value"), "scores"))


@query(f"WITH {EVENT_SQL} SELECT row_id, 0 AS cls, value AS score FROM ev UNION ALL SELECT row_id, 1, hour(ts)::DOUBLE FROM ev")
def scan_class_scores(spark, sf):
    return text.read_class_scores(spark, _file(_events(spark, sf), ["event_id"], _tsv("value", F.hour("ts")), "classes"))


# --- saved models ------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.TOKENS_SQL} SELECT token AS name, count(*) / 8.0::DOUBLE AS w FROM tok GROUP BY 1")
def saved_coefficients(spark, sf):
    path = folder(spark, "coefficients")
    models.save_coefficients(fx.tokens(spark, sf).groupBy(F.col("token").alias("name")).agg((F.count("*") / 8.0).alias("w")), path)
    return models.load_coefficients(spark, path)


@query("SELECT CAST(e.vec_id AS VARCHAR) AS token, CAST(g.i - 1 AS INTEGER) AS i, round(e.embedding[g.i]::DOUBLE, 9) AS x FROM embeddings e, (SELECT unnest(range(1, 65)) AS i) g")
def saved_vectors(spark, sf):
    path = folder(spark, "vectors")
    models.save_vectors(fx.table(spark, sf, "embeddings"), path, "vec_id", "embedding", digits=9)
    return models.load_vectors(spark, path).select("token", F.posexplode("vec").alias("i", "x"))


SMALL_TREE = [(0, 9, 0, "qty", 24.5, 0.0, 0.5, 1, 2), (1, 5, 1, None, None, 0.5, 0.0, -1, -1), (2, 4, 0, "disc", 0.05, 0.0, 0.25, 3, 4), (3, 2, 1, None, None, 2.0, 0.0, -1, -1), (4, 2, 1, None, None, -0.25, 0.0, -1, -1)]
SMALL_TREE_SQL = "tr(idx, n, leaf, attr, aval, wei, loss, l, r) AS (VALUES (0, 9, 0, 'qty', 24.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 1, 2), (1, 5, 1, NULL, NULL, 0.5, 0.0, -1, -1), (2, 4, 0, 'disc', 0.05, 0.0, 0.25, 3, 4), (3, 2, 1, NULL, NULL, 2.0, 0.0, -1, -1), (4, 2, 1, NULL, NULL, -0.25, 0.0, -1, -1))"


@query(f'WITH {SMALL_TREE_SQL} SELECT idx, leaf, attr, aval, wei, loss, l AS "left", r AS "right" FROM tr')
def saved_tree_text(spark, sf):
    path = folder(spark, "tree")
    models.save_tree_text(SMALL_TREE, spark, path)
    return text.read_tree(spark, path)


@query(f'WITH {SMALL_TREE_SQL} SELECT g.tree, idx, CAST(n AS BIGINT) AS n, leaf, attr, aval, wei, loss, l AS "left", r AS "right" FROM tr, (VALUES (0), (1)) g(tree)')
def saved_trees(spark, sf):
    path = folder(spark, "trees")
    models.save_trees([SMALL_TREE, SMALL_TREE], spark, path)
    loaded = models.load_trees(spark, path)
    return spark.createDataFrame([(i, *row) for i, t in enumerate(loaded) for row in t], "tree int, " + trees.TREE_SCHEMA)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, vec_id AS row_id, label AS cls, label / 4.0::DOUBLE AS dist FROM embeddings")
def saved_clusters(spark, sf):
    path = folder(spark, "clusters")
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cls"), (F.col("label") / 4.0).alias("dist"))
    models.save_clusters(e.orderBy("row_id"), [[1.0, 0.5], [0.25, 0.0]], path)
    back = text.read_columns(spark, f"{path}/clsid", "row long, cls int, dist double")
    return back.select(F.col("row_id").alias("at"), F.col("row").alias("row_id"), "cls", "dist")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS node, CAST(n_regionkey AS VARCHAR) AS comm FROM nation")
def saved_communities(spark, sf):
    path = folder(spark, "communities")
    models.save_communities(fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("comm")), path)
    return text.read_columns(spark, path, "node string, comm string").drop("row_id")


TOPIC_SQL = "SELECT event_type AS word, " + ", ".join(f"count(*) FILTER (event_id % 5 + 1 = {k}) AS t{k}" for k in range(1, 6)) + " FROM ev GROUP BY 1"


@query(f"WITH {EVENT_SQL} {TOPIC_SQL}")
def saved_topics(spark, sf):
    path = folder(spark, "topic-tables")
    tokens = _events(spark, sf).select(F.col("user_id").alias("doc"), F.col("event_type").alias("word"), (F.col("event_id") % 5 + 1).cast("int").alias("topic"))
    models.save_topics(tokens, 5, path)
    return spark.read.parquet(f"{path}/word_topic").select("word", *[F.col(str(k)).alias(f"t{k}") for k in range(1, 6)])


@query(f"WITH {EVENT_SQL} SELECT word, local, n FROM (SELECT event_type AS word, 'h' || CAST(hour(ts) AS VARCHAR) AS local, count(*) FILTER (event_id % 2 = 1) AS n FROM ev GROUP BY 1, 2) WHERE n > 0")
def saved_local_words(spark, sf):
    path = folder(spark, "local-tables")
    tokens = _events(spark, sf).select(F.col("user_id").alias("doc"), F.col("event_type").alias("word"), F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("local"), (F.col("event_id") % 2).cast("int").alias("x"))
    models.save_local_topics(tokens.withColumn("topic", F.when(F.col("x") == 1, -1).otherwise(1)), 2, path)
    wide = spark.read.parquet(f"{path}/word_local")
    return wide.unpivot(["word"], [c for c in wide.columns if c != "word"], "local", "n").where("n > 0")


REGION_SQL = f"{EVENT_SQL}, own AS (SELECT event_type AS word, CAST(event_id % 3 AS INTEGER) AS region, hour(ts)::DOUBLE AS px, value AS py FROM ev WHERE event_id % 2 = 1)"


def _saved_regions(spark, sf):
    path = folder(spark, "region-tables")
    tokens = text.read_region_tokens(spark, _region_file(spark, sf)).withColumnRenamed("row_id", "pos")
    models.save_region_topics(cut(tokens), 3, 3, path)
    return path


@query(f"WITH {REGION_SQL} SELECT word, count(*) FILTER (region = 0) AS r0, count(*) FILTER (region = 1) AS r1, count(*) FILTER (region = 2) AS r2 FROM own GROUP BY 1")
def saved_region_words(spark, sf):
    return spark.read.parquet(f"{_saved_regions(spark, sf)}/word_local").select("word", *[F.col(str(k)).alias(f"r{k}") for k in range(3)]).where("r0 + r1 + r2 > 0")


@query(f"WITH {REGION_SQL} SELECT region, count(*) AS n, round(avg(px), 5) AS mx, round(avg(py), 5) AS my, round(var_pop(px), 5) AS vx, round(var_pop(py), 3) AS vy, round(covar_pop(px, py), 4) AS cov FROM own GROUP BY 1")
def saved_region_dispersion(spark, sf):
    d = spark.read.parquet(f"{_saved_regions(spark, sf)}/local_disp")
    return d.select("region", "n", *[F.round(c, k).alias(c) for c, k in (("mx", 5), ("my", 5), ("vx", 5), ("vy", 3), ("cov", 4))])


@query(f"WITH {fx.TOKENS_SQL} SELECT token, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS INTEGER) AS id FROM tok GROUP BY 1")
def saved_vocabulary(spark, sf):
    """The vocabulary that a saved Huffman tree holds, by falling count."""
    path = folder(spark, "huffman")
    models.save_huffman(embed.huffman_codes(embed.vocabulary(fx.tokens(spark, sf))), path)
    return models.load_huffman(spark, path).select("token", "cnt", "id")


@query(f"WITH {fx.TOKENS_SQL} SELECT count(*) AS tokens, 1.0::DOUBLE AS kraft, count(*) AS codes FROM (SELECT DISTINCT token FROM tok)")
def huffman_is_complete(spark, sf):
    """A saved tree's codes: as many as tokens, all different, and together they fill the code space (sum of 2^-length is 1)."""
    path = folder(spark, "huffman")
    models.save_huffman(embed.huffman_codes(embed.vocabulary(fx.tokens(spark, sf))), path)
    return models.load_huffman(spark, path).agg(F.count("*").alias("tokens"), F.sum(F.pow(F.lit(2.0), -F.size("code"))).alias("kraft"), F.countDistinct("code").alias("codes"))


# --- functions and gradients with given samples ------------------------------------------------------------------------

GIVEN_SQL = """sc AS (SELECT vec_id AS row_id, embedding[1]::DOUBLE AS f, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y FROM embeddings),
  prs AS (SELECT a.row_id AS a, b.row_id AS b, a.y, a.f - b.f AS d FROM sc a JOIN sc b ON (a.row_id + 1) % 7 = b.row_id % 7 AND a.row_id // 50 = b.row_id // 50 AND a.y <> b.y),
  ups AS (SELECT a, b, CASE WHEN y = 1 AND d < 0.5 THEN d - 0.5 WHEN y = 0 AND -d < 0.5 THEN d + 0.5 ELSE 0 END AS u FROM prs)"""


def _given(spark, sf):
    s = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding")[0].cast("double").alias("f"), F.col("label").cast("double").alias("label"))
    keyed = s.select("row_id", ((F.col("row_id") + 1) % 7).alias("next"), (F.col("row_id") % 7).alias("own"), F.floor(F.col("row_id") / 50).alias("block"))
    a = keyed.select(F.col("row_id").alias("a"), F.col("next").alias("k"), "block")
    return s, a.join(keyed.select(F.col("row_id").alias("b"), F.col("own").alias("k"), "block"), ["k", "block"]).select("a", "b")


@query(f"WITH {GIVEN_SQL} SELECT row_id, round(coalesce(sum(u), 0), 9) AS g FROM sc LEFT JOIN ups ON a = row_id GROUP BY 1")
def rank_one_sided(spark, sf):
    return trees.two_class_gradients(*_given(spark, sf), 0.5).select("row_id", F.round("g", 9).alias("g"))


@query(f"WITH {GIVEN_SQL}, ends AS (SELECT a AS row_id, u FROM ups UNION ALL SELECT b, -u FROM ups) SELECT row_id, round(coalesce(sum(u), 0), 9) AS g FROM sc LEFT JOIN ends USING (row_id) GROUP BY 1")
def rank_two_sided(spark, sf):
    return trees.two_class_gradients(*_given(spark, sf), 0.5, both_ends=True).select("row_id", F.round("g", 9).alias("g"))


@query("""SELECT event_id, event_type AS both_ends, event_type || chr(9) || ' ' AS left_end, '  ' || event_type AS right_end,
  event_type AS second, 4 AS parts, value AS number, CAST(event_id AS DOUBLE) AS leading, 0.0::DOUBLE AS no_number, event_id AS whole FROM events""")
def text_functions(spark, sf):
    """Trimming, splitting with empty parts, and numbers that a text begins with."""
    e = fx.table(spark, sf, "events")
    word, parts = F.col("event_type"), scalar.split_keep_empty(F.concat(F.lit("x\t"), "event_type", F.lit("\t|")), "\t|")
    return e.select(
        "event_id", scalar.trim(F.concat(F.lit(" \r\n"), word, F.lit("\t "))).alias("both_ends"), scalar.trim(F.concat(F.lit("  "), word, F.lit("\t ")), right=False).alias("left_end"),
        scalar.trim(F.concat(F.lit("  "), word, F.lit("\t ")), left=False).alias("right_end"), parts[1].alias("second"), F.size(parts).alias("parts"),
        F.when(F.col("value").isNotNull(), scalar.to_double(F.col("value").cast("string"))).alias("number"), scalar.to_double(F.concat(F.col("event_id").cast("string"), F.lit(".0e0 units"))).alias("leading"),
        scalar.to_double(F.concat(F.lit("n"), word)).alias("no_number"), scalar.to_long(F.concat(F.col("event_id").cast("string"), F.lit(".75"))).alias("whole"),
    )


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)
  SELECT vec_id, CASE WHEN a < 0 AND b > 0 OR a > 0 AND b < 0 THEN 0 ELSE b END AS clipped, round(CASE WHEN abs(a) < 6 * abs(b) THEN pow(1 - pow(a / (6 * abs(b)), 2), 2) ELSE 0 END, 9) AS bisquare,
  round(sqrt(pow(a - c, 2) + pow(b - d, 2)), 9) AS distance, round(pow(1 - pow(abs(a) / (abs(a) + abs(b)), 3), 3), 9) AS tricube, 0.0::DOUBLE AS penalty0, 1.0::DOUBLE AS penalty1, 2 * vec_id + 1 AS penalty2,
  round(a * d - b * c, 9) AS det FROM e""")
def scalar_functions(spark, sf):
    """Clipping at 0, robust and distance weights, the distance of points, penalties of a further break, a determinant."""
    a, b, c, d = (F.col("embedding")[i].cast("double") for i in range(4))
    values = {
        "clipped": scalar.clip_crossing(a, b), "bisquare": F.round(scalar.bisquare(a, F.abs(b)), 9), "distance": F.round(F.sqrt(scalar.squared_distance(F.array(a, b), F.array(c, d))), 9),
        "tricube": F.round(scalar.tricube(a, F.abs(a) + F.abs(b)), 9), "penalty0": scalar.growth_penalty(F.col("vec_id"), 0), "penalty1": scalar.growth_penalty(F.col("vec_id"), 1),
        "penalty2": scalar.growth_penalty(F.col("vec_id"), 2), "det": F.round(a * d - b * c, 9),
    }
    return fx.table(spark, sf, "embeddings").select("vec_id", *[v.alias(n) for n, v in values.items()])
