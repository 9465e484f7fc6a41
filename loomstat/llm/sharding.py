"""Shards by balanced label propagation.

Documents with equal link keys are linked through a hub for their key, so a group of n documents has n
links and no pairs. Each round joins the groups' mass by shard to their members, lets every unit (a
group, or a piece of a group too large for one shard or one task) ask for the shard where most of its group is,
and admits the requests in order of gain while the shard has capacity left. Rounds go on until no unit
moves. Documents without links, and units that no shard has room for, then fill the shards up to equal sizes by
running totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize, read, running_total

N_SHARDS = 16
#: A linked group above this share of a shard's capacity, or of a shard's rows, is split into units of about this size.
UNIT_SHARE = 1 / 64
#: Buckets of one running total, so that its cells number shards * ORDER_CELLS at most.
ORDER_CELLS = 256


def shard_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", link: str | None = None, n_shards: int = N_SHARDS) -> DataFrame:
    """Deal docs out over n_shards: doc_id, size, text_crc32, shard int, slot long (gapless from 0 in each shard).

    size is the text's UTF-8 bytes plus 1; null texts count as empty. Documents with equal texts, or equal values of the
    column link, are linked; shards get nearly equal sums of size while cutting few links. Null links link nothing. A
    group too large for its share of a shard is cut into units, which is a cut that no balanced sharding avoids. Rows
    that repeat are each dealt, ties are broken by doc_id and hash, an empty table gives no rows, null doc_ids are dealt
    by their text. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(body) if link is None else F.when(F.col(link).isNotNull(), F.xxhash64(link))
    base = materialize(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), key.alias("link"), F.xxhash64(F.col(doc_id), body).alias("own"), F.monotonically_increasing_id().alias("nth")), "shard-base")
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = max(1.0, total / n_shards)
    unit_size, unit_rows = max(1.0, capacity * UNIT_SHARE), max(1.0, rows / n_shards * UNIT_SHARE)

    groups = base.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("members"), F.sum("size").alias("bytes")).where("members > 1")
    groups = groups.select("link", F.ceil(F.greatest(F.col("bytes") / unit_size, F.col("members") / unit_rows)).alias("parts"))
    # a large group has a unit's bytes or rows: there are 2 * n_shards / UNIT_SHARE of them at most, and their copies stay where they are
    large = F.broadcast(groups.where("parts > 1"))
    spread = base.join(large, "link", "left")
    split = spread.where("parts IS NOT NULL").withColumn("unit", F.xxhash64("link", F.pmod(F.xxhash64("own", "nth"), "parts"))).drop("parts")
    rest = spread.where("parts IS NULL AND link IS NOT NULL").drop("parts").join(groups.where("parts <= 1").select("link", F.xxhash64("link", F.lit(0)).alias("unit")), "link", "left")
    alone = base.where("link IS NULL").withColumn("unit", F.lit(None).cast("long"))
    base = materialize(split.unionByName(rest).unionByName(alone), "shard-units")
    mass = base.where("unit IS NOT NULL").groupBy("link", "unit", F.pmod("own", F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("size").alias("bytes"))
    mass = _propagate(materialize(mass, "shard-mass"), n_shards, capacity)

    units = mass.groupBy("unit").agg(F.count("*").alias("spread"), F.max("shard").alias("shard"), F.sum("bytes").alias("bytes"))
    whole = units.where("spread = 1").select("unit", "shard", "bytes")
    loads = dict(whole.groupBy("shard").agg(F.sum("bytes")).collect())
    labels = materialize(_fill(base.where("unit IS NULL"), units.where("spread > 1"), loads, n_shards, capacity, rows).unionByName(whole.select(F.lit(True).alias("is_unit"), F.col("unit").alias("item"), "shard")), "shard-labels")

    by_unit = base.where("unit IS NOT NULL").join(labels.where("is_unit").select(F.col("item").alias("unit"), "shard"), "unit")
    singles = base.where("unit IS NULL").join(labels.where("NOT is_unit").select(F.col("item").alias("own"), "shard").dropDuplicates(["own"]), "own")
    placed = by_unit.unionByName(singles).withColumn("bucket", F.pmod(F.xxhash64("own", "nth"), F.lit(buckets_for(rows))))
    placed = running_total(placed, ["shard"], "bucket", [F.col("doc_id"), F.col("own"), F.col("nth")], F.lit(1), "slot", n_shards * buckets_for(rows))
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def _propagate(mass: DataFrame, n_shards: int, capacity: float) -> DataFrame:
    """Rounds of moves over (link, unit, shard, bytes): a unit that is admitted is in one shard afterwards. Every round but
    the last makes some unit whole, so they come to an end."""
    while True:
        loads = dict(mass.groupBy("shard").agg(F.sum("bytes")).collect())  # a row for each shard
        rooms = F.array(*[F.lit(float(capacity - (loads.get(s) or 0))) for s in range(n_shards)])
        spread = mass.groupBy("link", "unit").agg(F.sum("bytes").alias("total"), F.count("*").alias("spread")).where("spread > 1").drop("spread")
        hub = mass.groupBy("link", "shard").agg(F.sum("bytes").alias("near"))
        own = mass.select("unit", "shard", F.col("bytes").alias("here"))
        asks = spread.join(hub, "link").join(own, ["unit", "shard"], "left").withColumn("room", F.element_at(rooms, F.col("shard") + 1))
        # a shard asks for what the unit doesn't hold there yet; all that leaves other shards is found free in the next round
        asks = asks.withColumn("more", F.col("total") - F.coalesce("here", F.lit(0))).where("more <= room")
        best = F.max_by(F.struct("shard", "room", "more", "near"), F.struct("near", "room", F.xxhash64("unit", "shard")))
        asks = asks.groupBy("unit", "total").agg(best.alias("b")).select("unit", "total", F.col("b.shard").alias("shard"), "b.room", "b.more", "b.near")
        asks = asks.withColumn("rank", F.lit(ORDER_CELLS - 1) - F.least(F.lit(ORDER_CELLS // 4 - 1), F.floor(F.log2(F.col("near")))) * 4 - F.pmod(F.xxhash64("unit"), F.lit(4)))
        asks = running_total(asks, ["shard"], "rank", [F.col("near").desc(), F.col("unit")], F.col("more"), "before", n_shards * ORDER_CELLS)
        moves = materialize(asks.where("before + more <= room").select("unit", F.col("shard").alias("to")), "shard-moves")
        if moves.isEmpty():
            return mass
        moved = mass.join(moves, "unit", "left").withColumn("shard", F.coalesce("to", "shard"))
        mass = materialize(moved.groupBy("link", "unit", "shard").agg(F.sum("bytes").alias("bytes")), "shard-mass")


def _fill(singles: DataFrame, units: DataFrame, loads: dict, n_shards: int, capacity: float, rows: int) -> DataFrame:
    """Documents without links and units still spread, laid end to end and cut where the shards are full."""
    bucket = buckets_for(rows)
    items = singles.groupBy("own").agg(F.sum("size").alias("bytes")).select(F.lit(False).alias("is_unit"), F.col("own").alias("item"), "bytes")
    items = items.unionByName(units.select(F.lit(True).alias("is_unit"), F.col("unit").alias("item"), "bytes"))
    items = items.withColumn("all", F.lit(0)).withColumn("bucket", F.pmod("item", F.lit(bucket)))
    items = running_total(items, ["all"], "bucket", [F.col("item"), F.col("is_unit")], F.col("bytes"), "before", bucket)
    cut, at = 0.0, F.lit(n_shards - 1)
    cuts = []
    for s in range(n_shards):
        cut += max(0.0, capacity - (loads.get(s) or 0))
        cuts.append(cut)
    for s in reversed(range(n_shards - 1)):
        at = F.when(F.col("before") + F.col("bytes") / 2 < cuts[s], F.lit(s)).otherwise(at)
    return items.select("is_unit", "item", at.cast("int").alias("shard"))


def cut_links(placed: DataFrame, link: str = "text_crc32") -> DataFrame:
    """Linked groups and how many of them lie in more than one shard."""
    by = placed.groupBy(link).agg(F.count("*").alias("members"), F.countDistinct("shard").alias("shards")).where("members > 1")
    return by.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("cut"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
