"""The plain topic model over packed documents: tokens come back whole, sums are those of all parts, and little is written."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomstat.operators import packed_lda, sparse_lda, topics
from loomstat.scratch import _base, dealt


def written(spark):
    top = _base(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(top) for f in files)


def test_a_sweep_writes_few_bytes_a_token(spark):
    t = spark.range(60_000).select(F.floor(F.col("id") / 100).cast("string").alias("doc"), (F.col("id") % 100).alias("pos"), F.concat(F.lit("word"), F.expr("pmod(xxhash64(id), 5000)")).alias("word"))
    before = written(spark)
    got = topics.lda(t, topics.TopicConfig(topics=4, sweeps=2))
    assert written(spark) - before < 60_000 * 15  # rows of tokens took over 60 bytes each, three times
    assert got.count() == 60_000


def test_tokens_come_back_whole_from_small_parts(spark, monkeypatch):
    monkeypatch.setattr(sparse_lda, "PART_TOKENS", 40)
    monkeypatch.setattr(packed_lda, "BUCKET_PARTS", 1)
    rng = np.random.default_rng(0)
    words = ["", None, "a\nb", "ß", *map(str, range(30))]
    rows = [(f"d{d}" if d else None, int(p) - 3, words[w]) for d in range(25) for p, w in enumerate(rng.integers(0, len(words), 150 if d == 7 else 9))]
    t = spark.createDataFrame(rows, "doc string, pos long, word string")
    key = lambda r: tuple(map(str, r))
    for table, grouped in ((t.repartition(5), False), (t.coalesce(1), True)):
        got = topics.lda(table, topics.TopicConfig(topics=3, sweeps=3), grouped=grouped).collect()
        assert sorted(((r["doc"], r["pos"], r["word"]) for r in got), key=key) == sorted(rows, key=key)
        assert {r["topic"] for r in got} == {1, 2, 3}


def test_a_bucket_gives_each_part_the_sums_in_its_own_order():
    rng, k, buckets, parts, all_ = np.random.default_rng(1), 3, 2, [], Counter()
    for part in range(3):
        words, z = [str(x) for x in rng.integers(0, 12, 50)], rng.integers(0, k, 50)
        all_.update(zip(words, z.tolist(), strict=True))
        data, sizes = packed_lda.squeeze_strings(pa.array(words))
        parts.append((words, pa.RecordBatch.from_pydict({"part": [part], "words": [data], "word_sizes": [sizes], "topics": [packed_lda.squeeze_ints(z)]})))
    sent = pa.Table.from_batches([b for _, p in parts for b in packed_lda._sent(iter([p]), k, buckets)]).sort_by([("bucket", "ascending"), ("part", "ascending")])
    back = pa.Table.from_batches(list(packed_lda._added(iter(sent.to_batches()), k))).to_pylist()
    assert sum(r["vocabulary"] for r in back) == len({w for w, _ in all_})
    for part, (words, _) in enumerate(parts):
        _, own, _ = packed_lda._vocabulary(pa.array(words), buckets)
        got = np.vstack([packed_lda.unsqueeze_ints(r["counts"]).reshape(k, -1).T for r in sorted((r for r in back if r["part"] == part), key=lambda r: r["bucket"])])
        assert got.tolist() == [[all_[w, t] for t in range(k)] for w in own.to_pylist()]


def test_a_dealt_table_is_not_moved_by_a_join(spark):
    held = dealt(spark.range(1000).withColumn("x", F.col("id") * 2), 5, "id")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    other = spark.range(0, 1000, 3).repartition(5, "id").groupBy("id").agg(F.count("*").alias("n"))
    plan = held.select("id", "x").hint("merge").join(other.hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
