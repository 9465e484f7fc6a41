"""Binary shard files through Spark's own writer, and range reads of them.

Spark's text writer puts a row's bytes and the line separator into the task's part file as they are. A file format
whose records may each end with one given byte can so be written to any store that Spark writes to, with its commit
protocol: a lost executor or a repeated task leaves no half file and no second one.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, end: str) -> None:
    """One file for each partition of the one binary column of records, each record followed by the character end."""
    column = records.columns[0]
    records.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end).option("compression", "none").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """shard (the writing partition), path, length for each file, by Spark's listing; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "path", "length")


def open_ranges(path: str):
    """A seekable file for range reads in any store that Arrow opens (file, hdfs, s3, gs)."""
    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)
