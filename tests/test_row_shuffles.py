import re

from loomstat.operators import linear, trees
from loomstat.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_features_read_and_move_the_same_columns(spark):
    """So that Spark moves the lines once for all their views."""
    seen = {re.search(r"ReadSchema: (\S+)", plan(t)).group(1) for t in (fx.rows(spark, SF), fx.rows(spark, SF, 3), fx.features(spark, SF))}
    assert len(seen) == 1


def test_hidden_units_are_summed_in_one_move(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0)], "row_id long, label double")
    feats = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "b", -1.0)], "row_id long, name string, value double")
    inner = spark.createDataFrame([("a", [0.5, 0.0]), ("b", [1.0])], "name string, v array<double>")
    z = linear.latent_forward(rows, feats, inner, [2.0, -1.0])
    assert len(re.findall(r"Exchange hashpartitioning\(row_id", plan(z))) == 2  # features and rows
    s = lambda x: 1 / (1 + 2.718281828459045**-x)
    got = {r.row_id: r.z for r in z.collect()}
    assert abs(got[1] - (2 * s(2.0) - s(0.0))) < 1e-9 and abs(got[2] - 2 * s(-1.0)) < 1e-9 and got[3] == 0.5  # b alone has no second unit


def test_scoring_moves_only_features_that_trees_ask_for(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    feats = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, "c", 9.0), (2, "a", 1.0), (3, "c", 1.0)], "row_id long, name string, value double")
    split, leaf = [(0, 3, 0, "a", 4.0, 0.0, 0.0, 1, 2), (1, 1, 1, None, None, 1.0, 0.0, -1, -1), (2, 2, 1, None, None, -1.0, 0.0, -1, -1)], [(0, 3, 1, None, None, 0.5, 0.0, -1, -1)]
    t = trees.score_trees(rows, feats, [split, leaf], 0.1)
    assert "name" not in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan(t))[-1] and len(re.findall("Exchange hash", plan(t))) == 2
    assert {r.row_id: round(r.score, 9) for r in t.collect()} == {1: 0.15, 2: -0.05, 3: -0.05}
    assert {round(r.score, 9) for r in trees.score_trees(rows, feats, [leaf], 0.1).collect()} == {0.05}
