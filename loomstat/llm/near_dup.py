"""Near-duplicates by SetSketch registers.

A document's set of word shingles becomes M registers. Every shingle is the seed of a Poisson process
that throws points onto registers at exponential distances; a register keeps the earliest time t that hit
it, stored as floor(1 - log_b t), so registers of a union are the maxima of the registers and equal
registers are about as frequent as the Jaccard similarity J. Texts with equal sets are one class from
the start. Bands of R registers put classes into buckets; a pair of classes with J = 0.75 misses all B bands
with probability (1 - 0.75^R)^B = 9e-8.

Buckets are not turned into pairs.
1. Every class is paired with the center that it shares most buckets with (one pair a class). The maximum-likelihood
   estimate of J, from the two set sizes and the order of the registers, tells which of these pairs can reach the
   threshold (six standard deviations of slack): they are open and make families.
2. Only buckets with several families are looked at again: those of the first EARLY bands, and, under the families
   that these leave, those of all others, so a hot group is one family before most of its buckets come up. Tiles
   of a bucket compare registers across families, stop where all are connected, and hand on a tree of families.
3. Full sets are worked out for the members of families alone. The pairs of step 1 are verified on them, which gives
   components; tiles of a family then compare full sets across components and hand on a tree of components.
Every step hands on fewer rows than classes times bands; within a tile two classes that are already connected are not
compared. A group of c classes has c / OPEN_TILE or c / SET_TILE tiles, each of which meets the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fresh, marked, materialize, partitions_for, read, small, tidy
from .graph import components
from .shingles import mix64, shingle_set, word_hashes

K = 5
#: Similarity in percent: 100 * intersection >= PERCENT * union.
PERCENT = 75
R, B = 5, 60
M = R * B
BASE = 1.001
SHIFT = 1 << 15
#: Bands whose buckets are compared first. A band's value holds its number in its low BAND_BITS bits.
EARLY, BAND_BITS = 8, 6
#: Classes of a tile, when registers are compared and when sets are; a tile of sets holds so many shingles, too, or one set.
OPEN_TILE, SET_TILE, SET_SHINGLES = 4096, 1024, 1 << 20
#: A bucket of about HOT_EVERY * HOT_LEAST rows and more is hot.
HOT_EVERY, HOT_LEAST = 256, 64
SLACK = 6 * (0.75 * 0.25 / M) ** 0.5
SKETCH_DOCS, SKETCH_SHINGLES, DRAWS = 2048, 1 << 18, 1 << 15
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16, len(sets) x M) of non-empty sets of 64-bit elements."""
    n = len(sets)
    earliest = np.full(n * M, np.inf)
    seed = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    time = np.zeros(len(seed))
    while len(seed):
        points = min(64, max(1, DRAWS // len(seed)))  # of each process at a time; what comes too late changes nothing
        at = seed[:, None] + GOLDEN * np.arange(1, points + 1, dtype=np.uint64)
        draw = mix64(at)
        gaps = -np.log(((draw >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)
        times = np.cumsum(np.concatenate([time[:, None], gaps], 1), 1)[:, 1:]
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(M)) >> np.uint64(32)
        np.minimum.at(earliest, ((doc * M)[:, None] + register.astype(np.int64)).ravel(), times.ravel())
        live = times[:, -1] < earliest.reshape(n, M).max(1)[doc]  # later points of the others can't be the earliest anywhere
        seed, doc, time = at[live, -1], doc[live], times[live, -1]
    level = np.floor(1 - np.log(earliest / M) / np.log(BASE)) + SHIFT
    return np.clip(level, 0, 65535).astype(np.uint16).reshape(n, M)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketch_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text key, text) to (doc_id, text key, n, fp, sketch)."""
    for batch in batches:
        sets: list[np.ndarray] = []
        done = 0

        def flush(batch=batch) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            registers = iter(sketches([sets[i] for i in full]))
            prints = [_signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else None for s in sets]
            arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array([next(registers).tobytes() if len(s) else None for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sets)), batch.column(1).slice(done, len(sets)), *arrays], schema=schema)

        size = 0
        for words in word_hashes(batch.column(2)):
            sets.append(shingle_set(words, k))
            size += len(sets[-1])
            if len(sets) >= SKETCH_DOCS or size >= SKETCH_SHINGLES:
                yield flush()
                done, sets, size = done + len(sets), [], 0
        if sets:
            yield flush()


def _band_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(fp, sketch) to (band, fp), B rows each."""
    weight = mix64(np.arange(1, R + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix64(np.arange(101, B + 101, dtype=np.uint64))
    low, number = np.uint64(BAND_BITS), np.arange(B, dtype=np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            registers = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(part), B, R).astype(np.uint64)
            bands = mix64(mix64((registers * weight).sum(2, dtype=np.uint64)) + salt) >> low << low | number
            yield pa.RecordBatch.from_arrays([pa.array(bands.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), B))], schema=schema)


def _set_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """(fp, text) to (fp, set)."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(w, k).tobytes() for w in word_hashes(part.column(1))], pa.binary())], schema=schema)


def _confirmed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) to the (a, b) that are similar on full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            least, most = sorted((len(x), len(y)))
            same = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= percent * most else 0
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=schema)


def estimate(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J from the set sizes and how many registers of a are larger and smaller than b's.

    A register of a exceeds b's with probability p(u - vJ) and falls short of it with p(v - uJ), where u and v are the sizes'
    shares and p(x) = -log_b(1 - x (b-1)/b). The likelihood is concave in J, so its slope is bisected.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = M - larger - smaller
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * scale) / log_b, -np.log1p(-y * scale) / log_b
        dp, dq = -v * scale / (1 - x * scale) / log_b, -u * scale / (1 - y * scale) / log_b
        slope = larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def _open(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows x and y (y may be one row for all) can be as similar as percent by the estimate."""
    bar = percent / 100 - SLACK
    open_ = 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
    # equal registers are J and a little more; the estimate is only worked out where they come near the bar
    open_ &= (x == y).sum(1) >= (bar - 0.05) * M
    at = np.flatnonzero(open_)
    if len(at):
        y = y[at] if y.ndim == 2 else y
        open_[at] = estimate(n_x[at], np.broadcast_to(n_y, n_x.shape)[at], (x[at] > y).sum(1), (x[at] < y).sum(1)) >= bar
    return open_


def _likely(batches: Iterator[pa.RecordBatch], schema: pa.Schema, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, registers of a, registers of b) to the open pairs (a, b)."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            n_a, n_b = (part.column(i).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(len(part), M) for i in (4, 5))
            keep = pa.array(_open(x, y, n_a, n_b, percent))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in part.columns[:2]], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows alike in the first two columns, as rows of the others."""
    run, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in columns), strict=True):
            if run != row[:2] and held:
                yield held
                held = []
            run = row[:2]
            held.append(row[2:])
    if held:
        yield held


class _Trees:
    """Labels of a cell's rows, and the edges between labels that were joined."""

    def __init__(self, labels: list[int]):
        self.names, self.of = np.unique(np.array(labels, np.int64), return_inverse=True)
        self.left = len(self.names)
        self.edges: list[tuple[int, int]] = []

    def others(self, i: int, outer: np.ndarray) -> np.ndarray:
        """Rows that outer row i is still to be compared with: of another tree, outer ones after i only."""
        todo = self.of != self.of[i]
        todo[: i + 1] &= ~outer[: i + 1]
        return np.flatnonzero(todo)

    def join(self, i: int, js: np.ndarray) -> None:
        own = self.of[i]
        for other in np.unique(self.of[js]):
            self.edges.append((int(self.names[own]), int(self.names[other])))
            self.of[self.of == other] = own
            self.left -= 1

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.edges, strict=True)], schema=schema)


def _open_trees(batches: Iterator[pa.RecordBatch], schema: pa.Schema, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, cell): a spanning forest of the cell's families by the pairs that the registers leave open."""
    for rows in _groups(batches, ["band", "cell", "label", "n", "outer", "sketch"]):
        trees, n, outer = _Trees([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)
        registers = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), M)
        for i in np.flatnonzero(outer):
            if trees.left == 1:
                break
            js = trees.others(i, outer)
            if len(js):
                trees.join(i, js[_open(registers[js], registers[i], n[js], n[i], percent)])
        yield from trees.batches(schema)


def _link_trees(batches: Iterator[pa.RecordBatch], schema: pa.Schema, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, cell): a spanning forest of the cell's components by links on full sets."""
    for rows in _groups(batches, ["family", "cell", "label", "n", "outer", "shingles"]):
        trees, n, outer = _Trees([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)
        first = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(rows)), n)
        values, element = np.unique(np.frombuffer(b"".join(r[3] for r in rows), np.uint64), return_inverse=True)
        has = np.zeros(len(values), bool)
        for i in np.flatnonzero(outer):
            if trees.left == 1:
                break
            js = trees.others(i, outer)
            js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
            if len(js):
                own = element[first[i] : first[i + 1]]
                has[own] = True
                same = np.bincount(row[has[element]], minlength=len(rows))[js]
                has[own] = False
                trees.join(i, js[100 * same >= percent * (n[i] + n[js] - same)])
        yield from trees.batches(schema)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar on full sets."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return materialize(both.select("a", "b", "x", "y").mapInArrow(lambda it: tidy(_confirmed(it, schema, percent)), "a long, b long"), "near-links")


def _cells(rows: DataFrame, by: str, tile_rows: int, tile_weight: int | None = None) -> DataFrame:
    """Rows (by, fp, label, n) with outer and cell: every pair across labels of one value of by is in a cell of two tiles.

    The most frequent label's rows need no comparison with each other: a cell holds two tiles of the outer rows, or
    one of these and one of that label's. A tile has about tile_rows rows and, if given, tile_weight of n.
    """
    main = rows.groupBy(by, "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    main = main.groupBy(by).agg(F.max_by(F.struct("label", "c", "w"), F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    weight = lambda w: w / tile_weight if tile_weight else F.lit(1.0)
    tiles = lambda c, w: F.greatest(F.lit(1), F.least(c, F.greatest(F.ceil(c / tile_rows), F.ceil(weight(w))))).cast("int")
    inner_tiles, outer_tiles = tiles(F.col("main.c"), F.col("main.w")), tiles(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w"))
    main = main.select(by, F.col("main.label").alias("main"), inner_tiles.alias("inner_tiles"), outer_tiles.alias("outer_tiles"))
    rows = rows.join(main, by).withColumn("outer", F.col("label") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("outer"), F.col("outer_tiles")).otherwise(F.col("inner_tiles"))).cast("int"))
    with_outer = F.transform(F.sequence(F.lit(0), F.col("outer_tiles") - 1), lambda i: F.concat_ws("o", F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    with_inner = F.transform(F.sequence(F.lit(0), F.col("inner_tiles") - 1), lambda i: F.concat_ws("m", F.col("own"), i))
    inner = F.transform(F.sequence(F.lit(0), F.col("outer_tiles") - 1), lambda i: F.concat_ws("m", i, F.col("own")))
    return rows.select(by, "fp", "label", "n", "outer", F.explode(F.when(F.col("outer"), F.concat(with_outer, with_inner)).otherwise(inner)).alias("cell"))


def _across(rows: DataFrame, by: str) -> DataFrame:
    """The rows (by, fp, label, n) of those values of by that have several labels."""
    mixed = rows.groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(by)
    return rows.join(mixed, by)


def _bands(classes: DataFrame) -> DataFrame:
    narrow = pa.schema([("band", pa.int64()), ("fp", pa.int64())])
    return classes.select("fp", "sketch").mapInArrow(lambda it: tidy(_band_rows(it, narrow)), "band long, fp long")


def _members(classes: DataFrame) -> DataFrame:
    """(band, fp, center) of the classes in buckets of two and more; the center is one of the bucket's classes.

    One class of HOT_EVERY is looked at first: of a bucket that holds HOT_LEAST of these, the smallest is the center of all its
    rows, which are then dealt out one by one. All other buckets are together where their rows land and get their smallest.
    The rows of all bands are the most that is moved here, so they are moved once.
    """
    n = classes.count()
    some = classes.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_EVERY)) == 0)
    hot = _bands(some).groupBy("band").agg(F.count("*").alias("c"), F.min("fp").alias("hot")).where(F.col("c") >= HOT_LEAST)
    hot = materialize(hot.select("band", "hot"), "near-hot")
    bands = _bands(classes).join(small(hot, hot.count()), "band", "left")
    bands = bands.select("band", F.when(F.col("hot").isNotNull(), F.xxhash64("fp")).alias("own"), "fp", "hot")
    bands = bands.repartition(partitions_for(n * B, 300_000), "band", "own")
    cell = Window.partitionBy("band", "own")
    cells = bands.select("band", "fp", "hot", F.min("fp").over(cell).alias("least"), F.count("*").over(cell).alias("c"))
    members = materialize(cells.where("c > 1 OR hot IS NOT NULL").select("band", "fp", F.coalesce("hot", "least").alias("center")), "near-members")
    discard(hot)
    return members


def _families(members: DataFrame, stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, label): the family of every class that has an open pair."""
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    found = components(stars)
    number = F.col("band").bitwiseAND(F.lit((1 << BAND_BITS) - 1))
    sizes = classes.select("fp", "n")
    for bands in (number < EARLY, number >= EARLY):
        rows = members.where(bands).join(found, members["fp"] == found["node"], "left").select("band", "fp", F.coalesce("label", "fp").alias("label"))
        rows = materialize(_across(rows, "band").join(sizes, "fp").select("band", "fp", "label", "n"), "near-open")
        wanted = rows.select("fp").distinct()
        registers = marked(classes.select("fp", "sketch"), "fp", wanted, wanted.count(), "wanted").where("wanted").select("fp", "sketch")
        cells = _cells(rows, "band", OPEN_TILE).join(registers, "fp").repartition("band", "cell").sortWithinPartitions("band", "cell", "fp")
        more = cells.select("band", "cell", "label", "n", "outer", "sketch").mapInArrow(lambda it: tidy(_open_trees(it, edge, percent)), "a long, b long")
        more = materialize(more.distinct(), "near-open-pairs")
        discard(rows)
        if not more.isEmpty():
            known = found
            found = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
            discard(known, more)
    return found


def _more_links(family: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one family: enough of them to connect what is connected."""
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = family.select(F.col("node").alias("fp"), F.col("label").alias("family")).join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    rows = rows.join(classes.select("fp", "n"), "fp").select("family", "fp", F.coalesce("label", "fp").alias("label"), "n")
    cells = _cells(materialize(_across(rows, "family"), "near-families"), "family", SET_TILE, SET_SHINGLES).join(sets, "fp")
    cells = cells.repartition("family", "cell").sortWithinPartitions("family", "cell", "fp")
    return materialize(cells.select("family", "cell", "label", "n", "outer", "shingles").mapInArrow(lambda it: tidy(_link_trees(it, edge, percent)), "a long, b long"), "near-more-links")


def _connected(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, fp) of docs, and (fp, least, label): the class's least (no id, doc_id, key) and its component.

    Texts are only moved for the members of families; all others are told from them where they are read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    wide = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary())])
    sketched = materialize(source.mapInArrow(lambda it: tidy(_sketch_rows(it, wide, k)), "doc_id long, key long, n long, fp long, sketch binary"), "near-sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    classes = materialize(sketched.where("n > 0").groupBy("fp").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("fp", "least", "n", "sketch"), "near-classes")
    rows = materialize(sketched.select("doc_id", "key", "n", "fp"), "near-rows")
    discard(sketched)

    members = _members(classes)
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    stars = members.where("fp <> center").groupBy(F.col("fp").alias("a")).agg(F.mode("center", True).alias("b"))
    side = lambda x: classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    stars = materialize(stars.mapInArrow(lambda it: tidy(_likely(it, edge, percent)), "a long, b long"), "near-stars")
    family = _families(members, stars, classes, percent)
    discard(members)

    wanted = materialize(family.select(F.col("node").alias("fp")).join(classes, "fp").select("fp", F.col("least.key").alias("key")), "near-wanted")
    texts = marked(source, "key", wanted, wanted.count(), "wanted").where("wanted").join(wanted, "key").dropDuplicates(["key", "fp"]).select("fp", "text")
    set_schema = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])
    sets = materialize(texts.mapInArrow(lambda it: tidy(_set_rows(it, set_schema, k)), "fp long, shingles binary"), "near-sets")

    labels = components(_verify(stars, sets, percent))
    more = _more_links(family, labels, classes, sets, percent)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.select("fp", "least").join(labels, F.col("fp") == F.col("node"), "left")
    named = materialize(named.select("fp", "least", F.coalesce("label", "fp").alias("label")), "near-named")
    discard(stars, family, wanted, sets, more, labels, classes)
    return rows, named


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A-Z count as a-z; words are runs without white space; a document's set holds its distinct k-word shingles, or its whole
    word sequence where there are fewer words. Documents are linked where 100 * intersection >= percent * union, links are
    confirmed on full sets (of 64-bit shingle hashes), and component_id is the smallest doc_id of a connected component.
    kept marks doc_id = component_id. Texts that are null or without words have no shingles and no links: they are their own
    component. Rows that repeat are linked like equal texts and are all kept where theirs is the smallest doc_id. A null
    doc_id never is a component_id unless its component has no other (then null, kept false; null and kept for texts
    without words). Any percent of 60 and more can be asked for; the bands are laid out for 75. Other columns are not read.
    """
    rows, named = _connected(docs, doc_id, text, k, percent)
    smallest = named.groupBy("label").agg(F.min("least.doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("fp", "component_id")
    out = rows.select("doc_id", "n", "fp").join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest doc_id, null ids last.

    Texts without words are in no component and all stay. Of rows alike in doc_id and text one stays.
    """
    rows, named = _connected(docs, doc_id, text, k, percent)
    mark, moved = fresh(docs, "key"), fresh(docs, "moved")
    chosen = materialize(named.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.key").alias(mark)), "near-chosen")
    seen = rows.where("n > 0").groupBy(F.col("key").alias(mark)).agg(F.count("*").alias("c"))
    others = seen.join(chosen.withColumn("chosen", F.lit(True)), mark, "left").where("chosen IS NULL OR c > 1").select(mark)
    others = materialize(others, "near-others")  # keys that don't stay, or occur more than once
    discard(rows, named)
    keyed = marked(docs.withColumn(mark, row_key(F.col(doc_id), F.col(text))), mark, others, others.count(), moved)
    moves = F.coalesce(F.col(text).rlike(WORD), F.lit(False)) & F.col(moved)
    one = keyed.where(moves).join(chosen, mark, "left_semi").dropDuplicates([mark])
    return one.unionByName(keyed.where(~moves)).drop(mark, moved)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: All pairs that share a shingle, compared in full; the closure follows links to and fro.
OP3_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM cut),
sizes AS MATERIALIZED (SELECT doc_id, len(shingles) AS n FROM sets),
shingles AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS s FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""
