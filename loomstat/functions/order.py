"""Global order without a single task: numbers, running totals and ranks over range buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.scratch import cut

#: Rows of a range bucket: there are as many buckets as that takes.
BUCKET_ROWS = 100_000


def with_bucket(df: DataFrame, value: str, out: str, buckets: int | None = None, ties: list[Column] | None = None, kept: bool = False) -> DataFrame:
    """Add the range bucket of a numeric column; nulls come first, and equal values share a bucket unless ties tell them apart.

    df is worked out once and checkpointed (unless it is kept already), and so is the result, since Spark draws the bounds anew in each run.
    """
    df = df if kept else cut(df)
    buckets = buckets or -(-df.count() // BUCKET_ROWS)
    if buckets <= 1:
        return df.withColumn(out, F.lit(0))
    return cut(df.repartitionByRange(buckets, F.col(value), *(ties or [])).withColumn(out, F.spark_partition_id()))


def running(df: DataFrame, bucket: str, order: list[Column], values: dict[str, Column], by: list[str] | None = None, after: bool = False) -> DataFrame:
    """Add running sums of values (name: column) in order of (bucket, order) within by, up to the row, or before it if not after.

    Totals of the buckets are summed up first (as many rows as buckets and keys), then rows inside their bucket.
    """
    by = by or []
    df = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    totals = df.groupBy(*by, bucket).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values])
    end = Window.currentRow if after else -1
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    df = df.join(starts, [*by, bucket])
    sums = {n: F.col(f"__s_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values}
    return df.select("*", *[c.alias(n) for n, c in sums.items()]).drop(*[f"__{k}_{n}" for n in values for k in "vts"])


def numbered(df: DataFrame, value: str, order: list[Column], out: str, buckets: int | None = None) -> DataFrame:
    """Add a dense number from 0 in ascending order of the numeric column value, then of order, which spreads equal values over buckets."""
    marked = with_bucket(df, value, "__bucket", buckets, ties=order)
    return running(marked, "__bucket", [F.col(value), *order], {out: F.lit(1)}).drop("__bucket")


def places(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Add a place from 1 within by, in the given order, over buckets of about BUCKET_ROWS rows; equal values lie in several, as order tells them apart."""
    df = cut(df)
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    marked = cut(df.repartitionByRange(buckets, *by, *order).withColumn("__bucket", F.spark_partition_id()))
    return running(marked, "__bucket", order, {out: F.lit(1)}, by=by, after=True).drop("__bucket")
