"""Blocks of rows that carry their features: nothing is moved, they are small, and fits are those of rows and features apart."""

import numpy as np
from pyspark.sql import functions as F

from loomstat.operators import linear
from loomstat.plans import catalog
from loomstat.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_blocks_hold_the_rows_and_move_none(spark):
    data, names = catalog._scaled_blocks(spark, SF)
    assert "Exchange" not in data._jdf.queryExecution().executedPlan().toString()
    got = [x for b in data.toArrow().to_batches() for x in linear._read([b])]
    rows, feats, _ = catalog._scaled(spark, SF)
    want = feats.join(rows, "row_id").groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.sum(F.col("value") * F.col("label")).alias("y")).collect()
    at = {r["id"]: r["name"] for r in names.collect()}
    for i in at:
        sums = np.zeros(3)
        for y, sizes, ids, vals in got:
            mine, row = ids == i, np.repeat(np.arange(len(y)), sizes)
            sums += [mine.sum(), vals[mine].sum(), (vals * y[row])[mine].sum()]
        r = next(r for r in want if r["name"] == at[i])
        assert np.allclose(sums, [r["n"], r["v"], r["y"]])
    size = data.agg(sum(F.sum(F.octet_length(c)) for c in data.columns)).first()[0]
    assert size < 30 * fx.rows(spark, SF).count()  # 60 bytes a row before


def test_fits_are_the_same(spark):
    fit = lambda t: {r["name"]: r["w"] for r in t.collect()}
    want, got = fit(linear.fit_batch(*catalog._scaled(spark, SF), lam=1.0, norm=1)), fit(linear.fit_blocks(*catalog._scaled_blocks(spark, SF), lam=1.0, norm=1))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-6 for k in want)


def test_features_without_a_value_are_left_out(spark):
    t = spark.createDataFrame([(1.0, [0, 1], [None, 2.0]), (0.0, [], []), (1.0, [1], [3.0])], "label double, ids array<int>, vals array<double>").coalesce(1)
    held = [[x.tolist() for x in b] for b in linear._read(linear.row_blocks(t).toArrow().to_batches())]
    assert [x for b in held for x in b[1]] == [1, 0, 1] and [x for b in held for x in b[3]] == [2.0, 3.0]
