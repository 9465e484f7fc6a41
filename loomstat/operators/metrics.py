"""Tied ranks, area under the ROC curve and losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions import order, scalar
from loomstat.scratch import cut

POSITIVE = 1 - 1e-10
#: Scores so close to the first of their group are tied.
NEAR = 1e-9


def _anchored(values: np.ndarray, before: float | None, tolerance: float) -> np.ndarray:
    """The first value of each ascending value's group; before is the first value of the group that was open."""
    starts = np.r_[True, ~(values[1:] - tolerance <= values[:-1])]  # further than the tolerance from the value before: a group for sure
    if before is not None and values[0] - tolerance <= before:
        starts[0] = False
    anchor = np.where(starts, values, np.nan if before is None else before)
    reach = values - tolerance
    heads = np.r_[np.flatnonzero(starts), len(values)]
    runs = [(0, heads[0], before)] if heads[0] else []
    runs += [(i, j, values[i]) for i, j in zip(heads[:-1], heads[1:], strict=True) if j - i > 1]
    for at, end, first in runs:  # values that lie close in a row: a group reaches as far as its first value does
        while at < end:
            upto = at + int(np.searchsorted(reach[at:end], first, "right"))
            anchor[at:upto] = first
            at = upto
            first = values[at] if at < end else first
    return anchor


def tie_groups(ties: DataFrame, score: str, bucket: str, tolerance: float) -> DataFrame:
    """Add __anchor, the first score of each score's group, to ties (distinct scores, dealt into range buckets).

    A group ends before the first score that is more than the tolerance above its anchor. Buckets are scanned side by side; one that
    begins inside a group of the bucket before is scanned again from that group's anchor, until no anchor that is handed on changes.
    Null and NaN are groups of their own, the first and the last.
    """
    v = F.col(score).cast("double").alias("v")
    known = cut(ties.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(bucket).alias("b"), v, F.lit(None).cast("double").alias("before")))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf.v.to_numpy())
        before = None if pd.isna(pdf.before.iloc[0]) else pdf.before.iloc[0]
        return pd.DataFrame({"b": [pdf.b.iloc[0]], "first": [x[0]], "last": [_anchored(x, before, tolerance)[-1]], "before": [before]})

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        before = None if pd.isna(pdf.before.iloc[0]) else pdf.before.iloc[0]
        return pd.DataFrame({"__v": pdf.v, "__anchor": _anchored(pdf.v.to_numpy(), before, tolerance)})

    shape = "b long, first double, last double, before double"
    ends = cut(known.groupBy("b").applyInPandas(last, shape))  # a row a bucket
    while True:
        handed = F.lag("last").over(Window.orderBy("b"))
        now = ends.withColumn("new", handed).withColumn("new", F.when(F.col("first") - tolerance <= F.col("new"), F.col("new")))
        stale = cut(now.where(~F.col("new").eqNullSafe(F.col("before"))).select("b", "new"))
        if stale.isEmpty():
            break
        again = known.drop("before").join(F.broadcast(stale.withColumnRenamed("new", "before")), "b").groupBy("b").applyInPandas(last, shape)  # a row a bucket
        ends = cut(ends.join(stale, "b", "left_anti").unionByName(again))
    found = known.drop("before").join(F.broadcast(ends.select("b", "before")), "b").groupBy("b").applyInPandas(all_of, "__v double, __anchor double")
    return ties.join(found, F.col(score).cast("double") == F.col("__v"), "left").withColumn("__anchor", F.coalesce("__anchor", F.col(score))).drop("__v")


def _grouped(ties: DataFrame, score: str, buckets: int | None, tolerance: float) -> DataFrame:
    """ties (distinct scores) with __bucket and __anchor: scores of integers are only tied where they are equal."""
    exact = tolerance == 0 or dict(ties.dtypes)[score] not in ("double", "float")
    ties = order.with_bucket(ties, score, "__bucket", buckets)
    if exact:
        return ties.withColumn("__anchor", F.col(score))
    return cut(tie_groups(ties, score, "__bucket", tolerance))


def tied_ranks(df: DataFrame, score: str, out: str = "rank", buckets: int | None = None, tolerance: float = NEAR) -> DataFrame:
    """Add 1-based ranks by score; tied scores share the mean of their places. Scores up to the tolerance above a group's first are tied."""
    ties = _grouped(df.groupBy(score).agg(F.count("*").alias("__n")), score, buckets, tolerance)
    groups = ties.groupBy("__anchor").agg(F.sum("__n").alias("__n"), F.min("__bucket").alias("__bucket"))
    groups = order.running(groups, "__bucket", [F.col("__anchor")], {"__before": F.col("__n")})
    ranks = groups.select("__anchor", (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ties.select(score, "__anchor").join(ranks, "__anchor").drop("__anchor"), score)


def auc(df: DataFrame, score: str, label: str, buckets: int | None = None, tolerance: float = NEAR) -> DataFrame:
    """One row (auc, positives, negatives): the rank-sum area with tied ranks averaged; null without both classes.

    Rows are first summed up by distinct score, so ties and repeated scores cost one row.
    """
    positive = F.when(F.col(label) >= POSITIVE, 1).otherwise(0)
    ties = _grouped(df.groupBy(score).agg(F.count("*").alias("__n"), F.sum(positive).alias("__p")), score, buckets, tolerance)
    ties = ties.groupBy("__anchor").agg(F.sum("__n").alias("__n"), F.sum("__p").alias("__p"), F.min("__bucket").alias("__bucket"))
    ties = order.running(ties, "__bucket", [F.col("__anchor")], {"__before": F.col("__n")})
    ranked = ties.agg(F.sum(F.col("__p") * (F.col("__before") + (F.col("__n") + 1) / 2)).alias("s"), F.sum("__p").alias("positives"), F.sum(F.col("__n") - F.col("__p")).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return ranked.select(F.when(p * n > 0, (F.col("s") - p * (p + 1) / 2) / (p * n)).alias("auc"), "positives", "negatives")


def logistic_loss(z: Column, y: Column) -> Column:
    """The sum of softplus(z) less z for positive labels."""
    return F.sum(scalar.softplus(z) - F.when(y > 0, z).otherwise(0.0))


def softmax(df: DataFrame, row: str, f: str, out: str = "p") -> DataFrame:
    """Add the softmax of f over the rows of one row id (one row a class), shifted by the largest f."""
    w = Window.partitionBy(row)
    shifted = F.exp(F.col(f) - F.max(f).over(w))
    return df.withColumn("__e", shifted).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def multiclass_loss(df: DataFrame, p: str, cls: str, label: str) -> DataFrame:
    return df.where(F.col(cls) == F.col(label)).agg((-F.sum(F.log(p))).alias("loss"), F.count("*").alias("n"))


def multiclass_auc(df: DataFrame, p: str, cls: str, label: str) -> DataFrame:
    """Class 0 against the rest: 1 - auc(probability of class 0, label >= 1)."""
    return auc(df.where(F.col(cls) == 0).withColumn("__y", (F.col(label) >= 1).cast("int")), p, "__y").withColumn("auc", 1 - F.col("auc"))
