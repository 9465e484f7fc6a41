"""Dictionary encoding and the filters against a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import order
from loomstat.scratch import cut


def first_appearance(tokens: DataFrame, name: str, position: str) -> DataFrame:
    """dict(name, id, n): ids from 0 by the first position of each name, and how often it occurs."""
    seen = tokens.groupBy(name).agg(F.min(position).alias("__first"), F.count("*").alias("n"))
    return order.numbered(seen, "__first", [F.col(name)], "id").select(name, "id", "n")


def encode(tokens: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """Known tokens with their id; unknown ones drop out."""
    return tokens.join(dictionary.select(name, "id"), name)


def forget(dictionary: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The dictionary without some names; other ids stay."""
    return dictionary.join(names, name, "left_anti")


def free(dictionary: DataFrame, names: DataFrame, name: str, position: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary without some names, and freed(id, at): their ids by the first position of each name. Unknown names free nothing."""
    gone = names.groupBy(name).agg(F.min(position).alias("at")).join(dictionary.select(name, "id"), name)
    return forget(dictionary, names, name), gone.select("id", "at")


def grow(dictionary: DataFrame, tokens: DataFrame, name: str, position: str, freed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dictionary(name, id, n) with the tokens' names, and what is left of freed(id, at).

    Known names keep their id and add up n. New ones come in order of first appearance (ties by name) and get the freed ids, the last
    freed first, then ids after all that were ever given out. Null names are left out. Without a dictionary's rows ids begin at 0.
    """
    seen = tokens.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(position).alias("__first"), F.count("*").alias("__n"))
    freed = dictionary.select("id", F.lit(0).alias("at")).limit(0) if freed is None else freed
    slots = cut(order.numbered(freed.select("id", "at", (-F.col("at")).alias("__less")), "__less", [F.desc("id")], "__k"))
    added = cut(order.numbered(seen.join(dictionary, name, "left_anti"), "__first", [F.col(name)], "__k"))
    ids = dictionary.select("id").unionByName(slots.select("id")).agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    free_ids, new = slots.count(), added.count()
    fresh = F.lit(ids) + F.col("__k") - free_ids
    known = dictionary.join(seen, name, "left").select(name, F.col("id").cast("long").alias("id"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"))
    born = added.join(slots.select("__k", "id"), "__k", "left").select(name, F.coalesce("id", fresh).cast("long").alias("id"), F.col("__n").alias("n"))
    return known.unionByName(born), slots.where(F.col("__k") >= new).select("id", "at")


def known_rows(rows: DataFrame, features: DataFrame, row: str) -> DataFrame:
    """Rows that have a known feature left."""
    return rows.join(features, row, "left_semi")


def renumber(rows: DataFrame, row: str, out: str = "dense_id") -> DataFrame:
    """Dense ids from 0 for the surviving rows, in order of their id."""
    return order.numbered(rows, row, [], out)


def offsets(lengths: DataFrame, row: str, length: str) -> DataFrame:
    """Cumulative offsets: the sum of lengths before each row in order of row."""
    return order.running(order.with_bucket(lengths, row, "__bucket"), "__bucket", [F.col(row)], {"offset": F.col(length)}).drop("__bucket")
