from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomstat.llm import common, near_dup, shingles

from .helpers import docs, edge_rows, prose, words


def brute(rows):
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), len(s), str(d) if not s else str(min(least[find(i)], default=None))) for i, ((d, _, _), s) in enumerate(zip(rows, sets)))


def family(seed, base_words, copies, edits, first_id):
    rng = np.random.default_rng(seed)
    base = prose(seed, base_words).split()
    out = []
    for c in range(copies):
        own = list(base)
        for at in rng.choice(len(own), rng.integers(0, edits + 1), replace=False):
            own[at] = f"edit{seed}x{c}x{at}"
        out.append((first_id + c, " ".join(own), "s"))
    return out


def test_matches_brute_force(spark):
    rows = edge_rows() + family(5, 120, 60, 9, 1000) + family(6, 40, 40, 4, 2000) + family(7, 200, 30, 2, 3000)
    rows += [(4000, "The Quick brown FOX jumps over it", "s"), (4001, "the quick  BROWN fox\tjumps over it", "s"), (4002, "a b", "s"), (4003, "A  b", "s")]
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near_dup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = family(8, 120, 90, 14, 0)
    whole = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    for name, rows_ in (("OPEN_TILE", 4), ("SET_TILE", 3), ("SET_SHINGLES", 500), ("EARLY", 1), ("HOT_EVERY", 2), ("HOT_LEAST", 2)):
        monkeypatch.setattr(near_dup, name, rows_)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == whole
    assert sorted((str(d), str(c)) for d, c in whole.items()) == [(d, c) for d, _, c in brute(rows)]


def test_sql_gives_the_same(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] not in (None, 105)] + family(5, 60, 20, 6, 1000)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(near_dup.OP3_SQL).fetchall()
    got = near_dup.op3_near_dup(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted(theirs)


def test_keep_one(spark):
    rows = edge_rows() + family(9, 100, 20, 3, 5000)
    table = docs(spark, rows).withColumn("__key", F.lit(1))
    kept = near_dup.keep_one(table)
    assert kept.columns == table.columns
    groups = {c for d, n, c in brute(rows) if n}
    blank = sum(1 for d, n, c in brute(rows) if not n)
    assert kept.count() == len(groups) + blank


def shuffled(spark, work):
    """Bytes that the stages of work write for shuffles."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    work()
    return sum(n for at, n in stages().items() if at not in before)


def test_texts_that_are_like_no_other_stay_where_they_are(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 2500)), "s") for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " one more", "s") for i in range(6)] + rows[10:13] + [(2000, None, "s"), (2000, None, "s")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    table, size, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), sum(len(t or "") for _, t, _ in rows), []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: kept.extend(near_dup.keep_one(table).collect())) < size / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.doc_id for r in kept) == [*range(200), 2000, 2000]


def registers_of(spark, n):
    """n classes that are like no other, but for the first 300, which share a band, and pairs of others, which share another."""
    rng = np.random.default_rng(13)
    registers = rng.integers(0, 1 << 16, (n, near_dup.M), dtype=np.uint16)
    registers[:300, :5] = 7
    registers[301:900:2, 5:10] = registers[300:900:2, 5:10]
    return [(int(f), 9, registers[i].tobytes()) for i, f in enumerate(rng.integers(-(1 << 63), 1 << 63, n))]


def test_bands_are_moved_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_EVERY", 4)
    monkeypatch.setattr(near_dup, "HOT_LEAST", 30)
    rows = registers_of(spark, 3000)
    spark.createDataFrame(rows, "fp long, n long, sketch binary").write.parquet(str(tmp_path / "classes"))
    classes, got = spark.read.parquet(str(tmp_path / "classes")), []
    moved = shuffled(spark, lambda: got.extend(near_dup._members(classes).collect()))
    buckets = defaultdict(set)
    for r in got:
        buckets[r.band, r.center].add(r.fp)
    fps = [r[0] for r in rows]
    assert sorted(map(sorted, buckets.values())) == sorted([sorted(fps[:300])] + [sorted(fps[i : i + 2]) for i in range(300, 900, 2)])
    assert len(got) == 900 and all(center in b and (len(b) > 2 or center == min(b)) for (_, center), b in buckets.items())
    assert moved < 32 * near_dup.B * len(rows)  # a row has 24 bytes


def test_registers_move_for_open_buckets_alone(spark, tmp_path):
    rows = registers_of(spark, 3000)
    rows[1] = (rows[1][0], 9, rows[0][2])
    spark.createDataFrame(rows, "fp long, n long, sketch binary").write.parquet(str(tmp_path / "classes"))
    classes, (a, b), got = spark.read.parquet(str(tmp_path / "classes")), sorted(r[0] for r in rows[:2]), []
    members = spark.createDataFrame([(64, a, a), (64, b, a), (63, a, a), (63, b, a)], "band long, fp long, center long")
    stars = spark.createDataFrame([], "a long, b long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(spark, lambda: got.extend(near_dup._families(members, stars, classes, 75).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(tuple(r) for r in got) == [(a, a), (b, a)]
    assert moved < 600 * len(rows) / 2


def test_marked_misses_no_key(spark, monkeypatch):
    table = spark.range(20_000).selectExpr("id - 10000 AS key", "id % 2 AS part")
    keys = table.where("key % 7 = 0").select("key")
    for most in (common.MOST_SLICES, 1):
        monkeypatch.setattr(common, "MOST_SLICES", most)
        got = common.marked(table, "key", keys, keys.count(), "hit")
        assert got.columns == ["key", "part", "hit"] and got.count() == 20_000
        assert got.where("key % 7 = 0 AND NOT hit").isEmpty() and got.where("key % 7 <> 0 AND hit").count() < (1700 if most > 1 else 2000)
    assert common.marked(table, "key", keys.limit(0), 0, "hit").where("hit").isEmpty()


def test_word_hashes_of_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = list(shingles.word_hashes(pa.array([text, None, "", "w1 w2"])))
    monkeypatch.setattr(shingles, "PIECE", 64)
    parts = list(shingles.word_hashes(pa.array([text, None, "", "w1 w2"])))
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[1]) == len(whole[2]) == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        common = int(2 * share / (1 + share) * 1000)
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:common], pool[1000 : 2000 - common]]))
        s = near_dup.sketches([a, b])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = near_dup.estimate(np.array([len(a)]), np.array([len(b)]), np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()]))[0]
        assert abs(got - j) < 0.12
