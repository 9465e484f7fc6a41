"""Places within a key over range buckets, which split equal values too."""

from pyspark.sql import functions as F

from loomstat.functions import order


def test_equal_values_lie_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET_ROWS", 50)
    t = spark.range(0, 1000).select((F.col("id") % 2).alias("name"), F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, 1.0).otherwise(F.col("id") % 7 + 0.0).alias("value"))
    placed = order.places(t, ["name"], [F.desc("value"), F.asc("row_id")], "place").collect()
    for name in (0, 1):
        mine = sorted((-r["value"], r["row_id"], r["place"]) for r in placed if r["name"] == name)
        assert [m[2] for m in mine] == list(range(1, 501))
