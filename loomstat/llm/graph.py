"""Connected components of an edge table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node of an edge the smallest node that it is connected with.

    Each round gives a node the least label among its neighbours and then the label of its label. The rounds end when
    nothing changes; a round's joins have a row for each end of an edge at most, so a hub costs no more than its edges.
    Tables of earlier rounds are deleted.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    ends = materialize(ends.unionByName(ends.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    label = materialize(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        best = ends.join(label.select(F.col("node").alias("near"), F.col("label").alias("l")), "near").groupBy("node").agg(F.min("l").alias("l"))
        nearer = label.join(best, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        step = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = nearer.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"), (F.coalesce("next", "label") < F.col("was")).alias("moved"))
        new = materialize(new, "labels")
        discard(label)
        if new.where("moved").isEmpty():
            discard(ends)
            out = new.select("node", "label")
            out._scratch = new._scratch
            return out
        label = new
