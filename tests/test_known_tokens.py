"""Numbering lines and tokens without one task that takes most of them."""

import pytest

from loomstat.functions import order, scalar
from loomstat.operators import embed
from loomstat.plans import catalog
from loomstat.sources import text


@pytest.fixture
def large_tables(spark):
    """Joins as Spark plans them where no table is known to be small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def numbered(monkeypatch):
    """What order.running is asked to number, with small buckets."""
    seen, real = [], order.running
    monkeypatch.setattr(order, "BUCKET_ROWS", 50)
    monkeypatch.setattr(order, "running", lambda df, *args, **named: seen.append(df) or real(df, *args, **named))
    return seen


def spoken(spark, words):
    return spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "doc_id long, pos int, token string")


def test_lines_stay_where_they_are_read(spark, tmp_path, large_tables):
    for i in range(3):
        (tmp_path / f"part-{i}").write_text("".join(f"{i}.{k}\n\n" for k in range(5)))
    lines = text.numbered_lines(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.row_id, r.value) for r in lines.collect()) == [(5 * i + k, f"{i}.{k}") for i in range(3) for k in range(5)]


def test_equal_counts_lie_in_several_buckets(spark, numbered):
    words = ["all", "all", "all"] + [f"w{i:04d}" for i in range(1000)]
    vocab = embed.vocabulary(spoken(spark, words))
    sizes = [r["count"] for r in numbered[0].groupBy("__bucket").count().collect()]
    assert sum(sizes) == 1001 and max(sizes) < 300
    assert [r.token for r in vocab.orderBy("id").collect()] == words[2:]
    assert [r.id for r in vocab.orderBy("id").collect()] == list(range(1001))


def test_a_vocabulary_of_the_most_frequent_tokens_numbers_these_alone(spark, numbered):
    tokens = spoken(spark, "b b b z z y y x x x x a c d e".split())
    for most in (1, 3, 4, 6, 100):
        some, whole = embed.vocabulary(tokens, most=most), embed.vocabulary(tokens).where(f"id < {most}")
        assert sorted(some.collect()) == sorted(whole.collect())
        assert numbered[-2].count() == min(most, 8)


def test_token_files_of_odd_texts(spark, tmp_path):
    texts = {5: "  two\t\n words \x0b", 3: None, 4: " \t\r\n", 1: "", 2: "a\u0085b c|d", 9: "one", 7: "\x0cx  x\r\nx"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["scan_tokens"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, "a\u0085b"), (0, 1, "c|d"), (1, 0, "two"), (1, 1, "words"), (2, 0, "x"), (2, 1, "x"), (2, 2, "x"), (3, 0, "one")]
    assert sorted(tuple(r) for r in catalog.QUERIES["scan_known_tokens"](spark, str(tmp_path)).collect()) == [(0, 2), (1, 2), (2, 3), (3, 1)]


def test_parts_between_single_characters(spark):
    for c in "\t ,|.\\[](){}^$*+?-&:a":
        row = spark.createDataFrame([(f"{c}x{c}{c}y{c}",), ("z",), ("",)], "v string")
        assert [r[0] for r in row.select(scalar.split_keep_empty(row.v, c)).collect()] == [["", "x", "", "y", ""], ["z"], [""]]
