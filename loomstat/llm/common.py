"""Scratch tables, bounded broadcasts and distributed running totals shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a small table is broadcast; callers count the rows (or know them by construction) first.
BROADCAST_ROWS = 100_000

#: Tasks of a stage that a driver can look after. Partitions asked for by size are larger beyond that (0.5 GB of 100 TB), and
#: all code streams through them.
MOST_PARTITIONS = 200_000

#: Bits of a filter: so many a key, in slices of SLICE_BITS (Spark's bitmaps); 16 MB at most, so that beyond 8 million keys more other rows pass.
KEY_BITS, SLICE_BITS, MOST_SLICES = 16, 1 << 15, 4096

#: White space is byte 0x20 and bytes 0x09 to 0x0D; every other run of characters is a word.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in spark.checkpoint.dir. Where that is unset a local session gets a
    temporary folder; a cluster session is refused, since its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstat-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_base(spark)}/loomstat/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which Spark keeps for other tasks, gives free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written in here go to Python in Arrow batches of so many rows at most; the JVM holds a batch two or three times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its known or counted number of rows is within BROADCAST_ROWS, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def marked(df: DataFrame, key: str, keys: DataFrame, n: int, mark: str) -> DataFrame:
    """Add mark, a boolean: true where the long key is among the n of keys, false for nearly all other rows.

    A join with keys that follows has few rows to move and decides; without a match in the broadcast bits a row needs none.
    """
    slices = min(MOST_SLICES, max(1, -(-n * KEY_BITS // SLICE_BITS)))
    part, bits = fresh(df, "part"), fresh(df, "bits")
    place = F.pmod(F.xxhash64(key), F.lit(slices * SLICE_BITS))
    at, inside = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit(SLICE_BITS - 1))
    made = keys.select(at.alias(part), inside.alias("inside")).repartition(part).groupBy(part).agg(F.bitmap_construct_agg("inside").alias(bits))
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return df.withColumn(part, at).join(F.broadcast(made), part, "left").withColumn(mark, hit).drop(part, bits)


def running_total(df: DataFrame, key: list[str], bucket: str, order: list[Column], value: Column, out: str, cells: int) -> DataFrame:
    """Add the sum of value over the rows before each row, by key, in order of (bucket, order).

    Two levels keep any one task to a (key, bucket) cell: totals of the cells are summed up first,
    then rows within their cell. cells bounds the number of (key, bucket) cells.
    """
    df = df.withColumn("__value", value)
    totals = df.groupBy(*key, bucket).agg(F.sum("__value").alias("__cell"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*key, bucket, F.coalesce(F.sum("__cell").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(small(starts, cells), [*key, bucket])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .drop("__value", "__start")
    )


def buckets_for(rows: int, per: int = 2_000, most: int = 1 << 20) -> int:
    """How many hash buckets hold about per rows each, or more if that would take more than most."""
    return min(most, max(1, -(-rows // per)))


def partitions_for(size: float, per: float) -> int:
    """How many partitions of about per each make up size."""
    return int(min(MOST_PARTITIONS, max(1, -(-size // per))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
