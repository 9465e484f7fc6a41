"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt into blocks. A block has several islands, each a row of its own with its packings, and an epoch of
generations maps over these rows, so islands of a block evolve in different tasks. In a generation a child copies one
parent, takes over some of the other's best-filled bins whole, drops its own bins that share a piece with them and
best-fits the displaced pieces, longest first; or it mutates, breaking its emptiest bins and some others. Between epochs a shuffle brings each island's elite to the next one in
the ring. Islands stop early only where nothing is left to gain: as few bins as the sizes allow, all but one full to
the last token. The best packing of all islands counts. Its well-filled bins are final, the pieces of its other bins
move on into fewer blocks, until one block holds what is left. A task has a block's sizes at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress
from operator import mul, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, read, tidy
from .tokens import END_ID, encoder, slices, tokenizer_path

CAPACITY = 4096
BLOCK = 4096
ISLANDS, PACKINGS, EPOCHS, GENERATIONS = 2, 8, 4, 48
#: The share of its emptiest bins, and of any bins, that a mutation breaks.
BROKEN = 0.02
#: A bin with less than this share of its capacity free is final.
WASTE = 1 / 256
#: Where more than this share of the pieces would move on, the blocks' pieces do not fit together, and their bins are final.
STUCK = 0.75
BLOCK_BITS, LEVEL_BITS = 20, 56
SEED = 5


class Bins:
    """Bins of items and their free space. Packings share the lists of items in a bin, which are never changed in place."""

    def __init__(self, sizes: list[int], capacity: int, items: list[list[int]] | None = None, free: list[int] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.items, self.free = items or [], free or []
        self.known: tuple[int, int] | None = None

    @classmethod
    def of(cls, sizes: list[int], capacity: int, packing: np.ndarray) -> Bins:
        """From the bin of each item."""
        packing = packing.astype(np.int64)
        order = np.argsort(packing, kind="stable").tolist()
        ends = np.cumsum(np.bincount(packing)).tolist()
        filled = np.bincount(packing, sizes).astype(np.int64)  # whole numbers far below 2^53
        return cls(sizes, capacity, [order[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], (capacity - filled).tolist())

    def packing(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.uint32)
        out[np.fromiter(chain.from_iterable(self.items), np.int64, len(out))] = np.repeat(np.arange(len(self.items)), list(map(len, self.items)))
        return out

    def perfect(self) -> bool:
        """As few bins as the sizes allow, and all but one of them full."""
        return sum(self.free) < self.capacity and len(self.free) - self.free.count(0) <= 1

    def best_fit(self, order: list[int]) -> None:
        """Each item to the bin with the least free space that holds it, of equal ones to the last to get that space."""
        sizes, items, free_of, self.known = self.sizes, self.items, self.free, None
        by_free: defaultdict[int, list[int]] = defaultdict(list)
        for b, free in enumerate(free_of):
            by_free[free].append(b)
        spaces = sorted(by_free)
        shared = len(items)
        for i in order:
            size = sizes[i]
            at = bisect_left(spaces, size)
            if at < len(spaces):
                free = spaces[at]
                same = by_free[free]
                b = same.pop()
                if not same:
                    del spaces[at]
                left = free_of[b] = free - size
                if b < shared:
                    items[b] = [*items[b], i]
                else:
                    items[b].append(i)
            else:
                b, left = len(items), self.capacity - size
                items.append([i])
                free_of.append(left)
            same = by_free[left]
            if not same:
                insort(spaces, left)
            same.append(b)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then the sum of squares of the fill: uneven fill leaves space together."""
        if self.known is None:
            filled = [self.capacity - f for f in self.free]
            self.known = -len(filled), sum(map(mul, filled, filled))
        return self.known


def cross(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """a with some of b's best-filled bins, and the pieces of the bins these break best-fitted again."""
    ranked = sorted(range(len(b.items)), key=b.free.__getitem__)
    take = ranked[: max(1, int(len(ranked) * rng.uniform(0.1, 0.6)))]
    items = [b.items[j] for j in take]
    new = set(chain.from_iterable(items))
    whole = list(map(new.isdisjoint, a.items))
    displaced = [i for i in chain.from_iterable(compress(a.items, map(not_, whole))) if i not in new]
    child = Bins(a.sizes, a.capacity, [*items, *compress(a.items, whole)], [*(b.free[j] for j in take), *compress(a.free, whole)])
    child.best_fit(sorted(displaced, key=a.sizes.__getitem__, reverse=True))
    return child


def mutate(a: Bins, rng: np.random.Generator) -> Bins:
    """a with its emptiest bins and as many others broken, and their pieces best-fitted again in order of blurred sizes."""
    count = max(2, int(len(a.items) * BROKEN))
    whole = [True] * len(a.items)
    for j in (*sorted(range(len(a.items)), key=a.free.__getitem__, reverse=True)[:count], *rng.integers(0, len(a.items), count).tolist()):
        whole[j] = False
    loose = list(chain.from_iterable(compress(a.items, map(not_, whole))))
    child = Bins(a.sizes, a.capacity, list(compress(a.items, whole)), list(compress(a.free, whole)))
    blurred = {i: a.sizes[i] * x for i, x in zip(loose, rng.uniform(0.8, 1.2, len(loose)).tolist(), strict=True)}
    child.best_fit(sorted(loose, key=blurred.__getitem__, reverse=True))
    return child


def settle(sizes: list[int], capacity: int, island: int, rng: np.random.Generator) -> list[Bins]:
    """An island's first packings: best fit of the falling sizes, which the first island has as they are, others blurred."""
    out = []
    for j in range(PACKINGS):
        blur = rng.uniform(0.8, 1.2, len(sizes)) if island or j else np.ones(len(sizes))
        one = Bins(sizes, capacity)
        one.best_fit(np.argsort(-np.asarray(sizes) * blur, kind="stable").tolist())
        out.append(one)
    return out


def generation(island: list[Bins], rng: np.random.Generator) -> None:
    """One child, crossed or mutated by turns of a coin, in place of the worst packing if it is better and none is its equal.

    A parent is the better of two packings drawn. Children as fit as a packing at hand are refused, or copies of one packing
    would soon fill the island, and crossing them brings nothing new.
    """
    island.sort(key=Bins.fitness, reverse=True)
    first = int(rng.integers(0, len(island), 2).min())
    if rng.random() < 0.5:
        child = mutate(island[first], rng)
    else:
        others = [x for j, x in enumerate(island) if j != first]
        child = cross(island[first], others[int(rng.integers(0, len(others), 2).min())], rng)
    if child.fitness() > island[-1].fitness() and all(child.fitness() != x.fitness() for x in island):
        island[-1] = child


_ISLAND = pa.schema([
    ("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("packings", pa.binary()), ("elite", pa.binary()),
    ("bins", pa.int64()), ("squares", pa.int64()), ("crossed", pa.int64()), ("moved", pa.int64()), ("perfect", pa.bool_()),
])
_ISLAND_DDL = "block long, island int, sizes binary, packings binary, elite binary, bins long, squares long, crossed long, moved long, perfect boolean"


def _island_row(block: int, number: int, island: list[Bins], crossed: int, moved: int) -> pa.RecordBatch:
    best = max(island, key=Bins.fitness)
    bins, squares = best.fitness()
    packings = b"".join(x.packing().tobytes() for x in island)
    row = [block, number, np.array(best.sizes, np.uint32).tobytes(), packings, best.packing().tobytes(), -bins, squares, crossed, moved, best.perfect()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ISLAND, strict=True)], schema=_ISLAND)


def _settled(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """(block, index, length) sorted by block and index to the block's islands; to one where best fit is perfect."""

    def rows(block: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
        for number in range(ISLANDS):
            island = settle(sizes, capacity, number, np.random.default_rng([SEED, block, number]))
            yield _island_row(block, number, island, 0, 0)
            if number == 0 and island[0].perfect():
                return

    run, sizes = None, []
    for batch in batches:
        for block, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if block != run:
                if sizes:
                    yield from rows(run, sizes)
                run, sizes = block, []
            sizes.append(length)
    if sizes:
        yield from rows(run, sizes)


def _evolved(batches: Iterator[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    """Islands (block, island, sizes, packings, crossed, moved, guest) after an epoch, in which the guest takes the worst one's place."""
    for batch in batches:
        for block, number, sizes, packings, crossed, moved, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes = np.frombuffer(sizes, np.uint32).tolist()
            island = [Bins.of(sizes, capacity, p) for p in np.frombuffer(packings, np.uint32).reshape(PACKINGS, len(sizes))]
            if guest is not None:
                island.sort(key=Bins.fitness, reverse=True)
                island[-1] = Bins.of(sizes, capacity, np.frombuffer(guest, np.uint32))
                moved += 1
            rng = np.random.default_rng([SEED, block, number, epoch])
            for _ in range(GENERATIONS):
                if max(island, key=Bins.fitness).perfect():
                    break
                generation(island, rng)
                crossed += 1
            yield _island_row(block, number, island, crossed, moved)


_PLAN = pa.schema([("block", pa.int64()), ("index", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("pending", pa.bool_())])


def _plan_rows(batches: Iterator[pa.RecordBatch], capacity: int, level: int) -> Iterator[pa.RecordBatch]:
    """(block, sizes, elite) to a row a piece."""
    for batch in batches:
        for block, sizes, elite in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            best = Bins.of(np.frombuffer(sizes, np.uint32).tolist(), capacity, np.frombuffer(elite, np.uint32))
            at, ids, offsets, pending = [], [], [], []
            for b, (items, free) in enumerate(zip(best.items, best.free, strict=True)):
                offset = 0
                for i in items:
                    at.append(i)
                    ids.append(level << LEVEL_BITS | block << BLOCK_BITS | b)
                    offsets.append(offset)
                    pending.append(free >= WASTE * capacity)
                    offset += best.sizes[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([block] * len(at), at, ids, offsets, pending), _PLAN, strict=True)], schema=_PLAN)


def search(order: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """(block, sizes, elite, bins, crossed, moved): the best packing of each block of order (block, index, length).

    crossed counts the block's children and moved the elites that came from another island.
    """
    tasks = partitions_for(blocks * ISLANDS, 4)
    dealt = order.select("block", "index", "length").repartition(partitions_for(blocks, 4), "block").sortWithinPartitions("block", "index")
    now = materialize(dealt.mapInArrow(lambda it: _settled(it, capacity), _ISLAND_DDL), "pack-islands")
    done = [now.where("perfect")]
    for epoch in range(EPOCHS):
        live = now.where("NOT perfect")
        ring = live.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elite").alias("guest")) if epoch else None
        rows = live.join(ring, ["block", "island"], "left") if epoch else live.withColumn("guest", F.lit(None).cast("binary"))
        rows = rows.select("block", "island", "sizes", "packings", "crossed", "moved", "guest").repartition(tasks, "block", "island")
        now = materialize(rows.mapInArrow(lambda it, epoch=epoch: _evolved(it, capacity, epoch), _ISLAND_DDL), "pack-islands")
        done.append(now if epoch == EPOCHS - 1 else now.where("perfect"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    best = F.max_by(F.struct("sizes", "elite", "bins"), F.struct(-F.col("bins"), "squares", -F.col("island"))).alias("best")
    return found.groupBy("block").agg(best, F.sum("crossed").alias("crossed"), F.sum("moved").alias("moved")).select("block", "best.*", "crossed", "moved")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """(at, sequence_id, offset) for pieces (at, length), at unique."""
    todo, done, level = pieces.select("at", "length"), None, 0
    while True:
        rows = todo.count()
        blocks = max(1, -(-rows // BLOCK))
        order = todo.withColumn("block", F.pmod(F.xxhash64("at", F.lit(level)), F.lit(blocks)))
        falling = Window.partitionBy("block").orderBy(F.desc("length"), "at")  # about BLOCK rows
        order = materialize(order.withColumn("index", F.row_number().over(falling) - 1), "pack-order")
        best = search(order, blocks, capacity).select("block", "sizes", "elite")
        plan = best.mapInArrow(lambda it, level=level: _plan_rows(it, capacity, level), "block long, index int, sequence_id long, offset long, pending boolean")
        placed = materialize(order.join(plan, ["block", "index"]).select("at", "length", "sequence_id", "offset", "pending"), "pack-level")
        moving = placed.where("pending").count()
        last = blocks == 1 or moving == 0 or moving > STUCK * rows
        final = (placed if last else placed.where("NOT pending")).select("at", "sequence_id", "offset")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        todo, level = placed.where("pending").select("at", "length"), level + 1


def _piece_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = enc._pack([end_id])
    for batch in batches:
        for part in slices(batch, 1):
            out: list[tuple] = []
            for doc_id, data in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data + end, f"<u{enc.width}").astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack every document's token ids, with the end id, into sequences of at most capacity tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if with_ids. Documents longer
    than capacity are cut into pieces of capacity tokens and a rest; all others are one piece. Null texts are empty: their
    end id alone. Rows that repeat are packed each; null ids are kept; an empty table gives no rows; other columns are not
    read. Sequence ids are unique, not dense; the offsets in a sequence are gapless from 0.
    """
    tokenizer = tokenizer or tokenizer_path()
    extra = with_ids * [("ids", pa.list_(pa.int64()))]
    base = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *extra]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + with_ids * ", ids array<bigint>"
    schema = pa.schema(base)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(lambda it: tidy(_piece_rows(it, schema, tokenizer, end_id, capacity, with_ids)), ddl)
    pieces = materialize(pieces.withColumn("at", F.monotonically_increasing_id()), "pack-pieces")
    return pieces.join(place(pieces, capacity), "at").drop("at")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
