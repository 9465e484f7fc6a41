"""Collocations: phrases whose words stand together more often than their parts let expect.

Counting goes level by level. The phrases of k words that are frequent become bits of a filter, and the next pass over the texts
only counts a phrase of k + 1 words where the bits of both its overlapping parts are set. The filter is of bounded size, so it
can be broadcast at any number of frequent phrases; a bit set by another phrase lets more phrases be counted, which their
own count then drops. Every Arrow batch counts its own phrases before anything is shuffled. Cuts are scored by joins with the
level tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY_BITS, MOST_SLICES, SLICE_BITS, batches_of, fresh, materialize, read, small, tidy
from .shingles import ODD, mix64
from .spans import Words, kinds, words_of

#: A phrase's length in words, its least frequency, the share in percent of it that a longer phrase may not reach, and rows a language.
LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 500
#: Parts of a language in which the best phrases are found first.
PARTS = 64
KIND = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_COUNTS = "lang string, phrase string, c long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


def _hash(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))


def _place(lang: np.ndarray, words: list[np.ndarray], slices: int) -> np.ndarray:
    """The bit of phrases, from the hashes of their language and words."""
    h = lang.copy()
    for i, w in enumerate(words):
        h += w * ODD[i % 64]
    return mix64(h) % np.uint64(slices * SLICE_BITS)


class Filter:
    """Bits of frequent phrases."""

    def __init__(self, slices: int, parts: dict[int, bytes]):
        self.slices = slices
        bits = np.zeros(slices * SLICE_BITS // 8, np.uint8)
        for at, data in parts.items():
            bits[at * (SLICE_BITS // 8) :][: len(data)] = np.frombuffer(data, np.uint8)
        self.bits = bits

    def has(self, lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        at = _place(lang, words, self.slices)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bit_rows(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) to (part, inside): where their bits are."""
    for batch in batches:
        words = [p.split(" ") for p in batch.column(1).to_pylist()]
        columns = [_hash(list(w)) for w in zip(*words, strict=True)]
        at = _place(_hash(batch.column(0).to_pylist()), columns, slices) if words else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((at // SLICE_BITS).astype(np.int32)), pa.array((at % SLICE_BITS).astype(np.int64))], names=["part", "inside"])


def frequent(level: DataFrame) -> Filter:
    """The filter of the phrases of a level: at most MOST_SLICES rows of SLICE_BITS bits come to the driver."""
    slices = min(MOST_SLICES, max(1, -(-level.count() * KEY_BITS // SLICE_BITS)))
    bits = level.select("lang", "phrase").mapInArrow(lambda it: _bit_rows(it, slices), "part int, inside long")
    rows = bits.groupBy("part").agg(F.bitmap_construct_agg("inside").alias("bits")).collect()
    return Filter(slices, {r.part: bytes(r.bits) for r in rows})


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, the number of each key, and how often each occurs."""
    _, at, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return at, number.astype(np.int64), count


def _phrases(words: Words, langs: list[str], lang_of: np.ndarray, k: int, filters: list[Filter]) -> list[pa.RecordBatch]:
    """Counts of the phrases of k words of one part; filters[j - 2] tells which phrases of j - 1 words may grow to j words."""
    n = len(words.code)
    if not n:
        return []
    lang, known = lang_of[words.row], words.distinct.to_pylist()
    at, word, count = _unique(lang * len(known) + words.code)  # word: number of a word in its language
    word_hash, lang_hash = _hash(known)[words.code[at]], _hash(langs)[lang[at]]
    kinds_, number, valid = len(at), word, np.arange(n)  # number: of the phrase that begins at a word, where one of the level does
    for j in range(2, k + 1):
        passes = np.zeros(n, bool)
        passes[valid] = filters[j - 2].has(lang_hash[word[at]], [word_hash[word[at + i]] for i in range(j - 1)])[number[valid]]
        grows = passes[: n - j + 1] & passes[1 : n - j + 2] & (words.piece[: n - j + 1] == words.piece[j - 1 :])
        valid = np.flatnonzero(grows)
        if not len(valid):
            return []
        at, own, count = _unique(number[valid] * kinds_ + word[valid + j - 1])
        at, number = valid[at], np.zeros(n, np.int64)
        number[valid] = own
    spelled = [words.distinct.take(pa.array(words.code[at + i])) for i in range(k)]
    phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())) if k > 1 else spelled[0]
    out = [pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(lang[at])), phrase.cast(pa.string()), pa.array(count)], schema=_SCHEMA)]
    if k == 1:
        total = np.bincount(lang, minlength=len(langs))
        out.append(pa.RecordBatch.from_arrays([pa.array(langs), pa.nulls(len(langs), pa.string()), pa.array(total)], schema=_SCHEMA))
    return out


def _count_rows(batches: Iterator[pa.RecordBatch], k: int, filters) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, phrase, c); without a phrase c counts all words."""
    filters = filters.value
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        langs, lang_of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        for words, first in words_of(batch.column(1), KIND):
            yield from _phrases(words, langs, lang_of[first:], k, filters)


def levels(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the words of each language, and for 1 to longest words the phrases (lang, phrase, f) with f >= least."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    tables, filters, totals = [], [], None
    for k in range(1, longest + 1):
        sent = spark.sparkContext.broadcast(filters)  # MOST_SLICES * SLICE_BITS bits each at most
        counted = rows.mapInArrow(lambda it, k=k, sent=sent: tidy(_count_rows(it, k, sent)), _COUNTS)
        counted = counted.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        with batches_of(spark, BATCH_ROWS):
            level = materialize(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}")
        if k == 1:
            totals, level = level.where("phrase IS NULL").select("lang", F.col("f").alias("n")), level.where("phrase IS NOT NULL")
        tables.append(level)
        if k < longest:
            filters = [*filters, frequent(level)]
    return totals, tables


def _run(words: Column, first: int, n: int) -> Column:
    """n words from the first one on (from 1), space-joined."""
    return F.array_join(F.slice(words, first, n), " ")


def _scored(tables: list[DataFrame], k: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of k words by their lowest-scoring cut, the earliest of these."""
    out = tables[k - 1].select("lang", "phrase", F.col("f").alias("a")).withColumn("words", F.split("phrase", " "))
    exact = lambda c: F.col(c).cast("decimal(16,0)")  # noqa: E731  a * a * 1000000 has 38 digits then
    cuts = []
    for i in range(1, k):
        left = tables[i - 1].select("lang", F.col("phrase").alias(f"left{i}"), F.col("f").alias(f"l{i}"))
        right = tables[k - i - 1].select("lang", F.col("phrase").alias(f"right{i}"), F.col("f").alias(f"r{i}"))
        out = out.withColumn(f"left{i}", _run(F.col("words"), 1, i)).join(left, ["lang", f"left{i}"]).drop(f"left{i}")
        out = out.withColumn(f"right{i}", _run(F.col("words"), i + 1, k - i)).join(right, ["lang", f"right{i}"]).drop(f"right{i}")
        out = out.withColumn(f"over{i}", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn(f"under{i}", exact(f"l{i}") * exact(f"r{i}"))
        cuts.append(F.struct(F.expr(f"over{i} div under{i}").cast("long").alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _longer(tables: list[DataFrame], least_words: int = 2) -> DataFrame:
    """(lang, phrase, most): the frequency of the most frequent phrase that holds phrase (of two words and more) and is longer."""
    found = []
    for k in range(least_words + 1, len(tables) + 1):
        words = F.split("phrase", " ")
        parts = F.array(*[_run(words, at, n) for n in range(least_words, k) for at in range(1, k - n + 2)])
        found.append(tables[k - 1].select("lang", "f", F.explode(F.array_distinct(parts)).alias("phrase")))
    return reduce(DataFrame.unionByName, found).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of 2 to longest words.

    A-Z count as a-z. Texts are split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into words. a is a
    phrase's frequency (contiguous, overlaps included) and at least least; a cut into l and r scores floor(1000000 a a / (l r)), the
    lowest cut counts. A phrase goes that a longer one of at least share percent of its frequency holds. Ranks go by score, then a,
    both falling, then phrase. n is the number of words of the language. Null languages are und, null and empty texts have no
    words; repeated rows count each; an empty table gives no rows; other columns are not read. Frequencies may have 16 digits.
    """
    totals, tables = levels(docs, text=text, lang=lang, longest=longest, least=least)
    scored = reduce(DataFrame.unionByName, [_scored(tables, k) for k in range(2, longest + 1)])
    if longest > 2:
        scored = scored.join(_longer(tables), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = fresh(scored, "part")
    near = Window.partitionBy("lang", part).orderBy(*order)  # a language may hold most phrases: the first of its parts are found first
    scored = scored.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).drop(part)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(small(totals, totals.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words WHERE len(w) >= 3),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, i.i AS cut,
         array_to_string(string_split(c.phrase, ' ')[1 : i.i], ' ') AS lw, array_to_string(string_split(c.phrase, ' ')[i.i + 1 : c.k], ' ') AS rw
  FROM f c JOIN (VALUES (1), (2)) i(i) ON i.i < c.k),
priced AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lw JOIN f y ON y.lang = cuts.lang AND y.phrase = rw),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase FROM f WHERE k = 3),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY ALL),
stays AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
