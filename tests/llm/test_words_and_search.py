import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from loomstat.llm import byte_bpe, collocations, lexical, spans

from .helpers import docs, edge_rows, prose


def spread(rows):
    """Rows in four languages, one of them null."""
    return [(i, t, s, [None, "en", "fr", ""][k % 4]) for k, (i, t, s) in enumerate(rows)]


def with_langs(spark, rows):
    full = [(i, t, s, lang, 1, "p", 2, "w") for i, t, s, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, part int, phrase string, rank int, words string")


def plain_collocations(rows, longest=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest,least,share,top", [(3, 10, 50, 2000), (4, 3, 80, 25)])
def test_collocations_match_a_plain_version(spark, longest, least, share, top):
    rows = [(i, prose(i % 9, 60, 40) + (". New York City, a\tb c\n" if i % 2 else " new york CITY; Über das "), "s") for i in range(120)]
    rows = spread(rows + edge_rows() + [(900, "one line of words " * 300, "s"), (901, "x" * 5000 + " y " * 40, "s")])
    got = collocations.collocations(with_langs(spark, rows), longest=longest, least=least, share=share, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, longest, least, share, top)


def test_collocations_of_little(spark, monkeypatch):
    assert collocations.collocations(with_langs(spark, spread([(1, None, "s"), (2, "", "s"), (3, " . ", "s")]))).count() == 0
    assert collocations.collocations(with_langs(spark, spread([(1, "a", "s")])).limit(0)).count() == 0
    rows = spread([(i, prose(i % 5, 50, 30), "s") for i in range(100)])
    monkeypatch.setattr(collocations, "MOST_SLICES", 1)  # bits that others set only let more be counted
    monkeypatch.setattr(collocations, "SLICE_BITS", 1 << 15)
    assert sorted(tuple(r) for r in collocations.collocations(with_langs(spark, rows), least=4).collect()) == plain_collocations(rows, least=4)


def test_scores_are_exact_beyond_64_bits(spark):
    a, b = 3_000_000_000_001, 3_000_000_000_007
    tables = [spark.createDataFrame([("en", "x", b), ("en", "y", a + 1)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")]
    assert collocations._scored(tables, 2).first().score == 1000000 * a * a // (b * (a + 1))


def test_words_of_long_texts_in_parts(monkeypatch):
    text = pa.array(["One. two\tthree", None, "", "É b " * 50 + "." + "c" * 90 + " D", ".,;", "end"])
    whole = [(w.distinct[c].as_py(), r + first) for w, first in spans.words_of(text, collocations.KIND) for c, r in zip(w.code.tolist(), w.row.tolist())]
    monkeypatch.setattr(spans, "PIECE", 16)
    parts = [(w.distinct[c].as_py(), r + first) for w, first in spans.words_of(text, collocations.KIND) for c, r in zip(w.code.tolist(), w.row.tolist())]
    assert parts == whole and whole[:3] == [("one", 0), ("two", 0), ("three", 0)] and whole[-1] == ("end", 5)
    sliced = [w.distinct[c].as_py() for w, _ in spans.words_of(text.slice(4), collocations.KIND) for c in w.code.tolist()]
    assert sliced == ["end"]


def library():
    path, pattern = byte_bpe.default_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcab \n'sdé日 \x1c\x85  !?.12٣Ⅷ\x00") for _ in range(200)) for _ in range(60)]
    texts += ["a" * 3000, " " * 50, "ab" * 777, "", "\n\n \n x", "don't 'll 'RE <|endoftext|>", "x" * 40 + "\n" * 40]
    return texts + ["".join(chr(c) for c in range(lo, lo + 97)) for lo in range(0, 0x2000, 97)]


def test_byte_bpe_equals_the_library(spark):
    enc, rows = library(), [(5000 + i, t, "s") for i, t in enumerate(odd_texts())] + edge_rows()
    expected = sorted((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids) for d, t, _ in rows for ids in [enc.encode_ordinary(t or "")])
    table = docs(spark, rows).repartition(3)
    got = byte_bpe.encode(table, with_ids=True)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got.collect()) == expected
    texts = {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode_rows(got).select("doc_id", "decoded").collect()}
    assert texts == {(d, (t or "").encode()) for d, t, _ in rows}
    assert byte_bpe.encode(table.limit(0)).count() == 0
    assert got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").columns == byte_bpe.encode(table).columns


def test_byte_bpe_of_small_chunks_and_parts(monkeypatch):
    path, pattern = byte_bpe.default_ranks()
    compiled, texts = regex.compile(pattern), odd_texts() + [prose(3, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    whole = [b.to_pylist() for b in byte_bpe._encoded(iter([batch]), path, pattern, True)]
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 900)
    assert sum([b.to_pylist() for b in byte_bpe._encoded(iter([batch]), path, pattern, True)], []) == sum(whole, [])
    monkeypatch.setattr(byte_bpe, "LONG", 37)
    assert all([w for found in byte_bpe._matches(t, compiled) for w in found] == compiled.findall(t) for t in texts)


def test_replay_where_a_merge_makes_a_lower_pair():
    """Ranks that no training gives: ab + c comes before what it is made of."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = {bytes([b]): None for b in b"abc"}
        while len(tokens) < 14:
            tokens[bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6)))] = None
        order = list(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        words = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)})
        expected = [[ranks[w]] if w in ranks else byte_bpe.merge_word(w, ranks) for w in words]
        assert [x.tolist() for x in byte_bpe.replay(words, byte_bpe.Merges(ranks))] == expected


def plain_search(rows, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(cut(t))) for d, t, _ in rows]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            n = sum(b.values())
            score = 0
            for t in cut(text):
                if t in b:
                    m = 100 - 75 + 75 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(str(item), i + 1, str(None if none else d), -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


ITEM = "item_id long, text string, doc_id int, score int, number int, rank int, terms string"


def test_search_matches_a_plain_version(spark, monkeypatch):
    rows = edge_rows() + [(300 + i, prose(i, 20 + i % 50), "s") for i in range(150)] + [(600, "Ünïcode-words, 日本 x9", "s")]
    items = [(i, prose(i, 12)) for i in range(12)] + [(20, None), (21, ""), (22, "zzz nowhere"), (23, "ÜNÏCODE ünïcode x9 X9"), (24, "the the the twice"), (24, "the the the twice"), (None, prose(3, 4)), (25, prose(1, 3000))]
    asked = spark.createDataFrame([(i, t, 1, 2, 3, 4, "t") for i, t in items], ITEM)
    table = docs(spark, rows).repartition(9)
    for tiers, block in (((0.3, 0.1), 200_000), ((0.8, 0.5, 0.2), 300), ((), 200_000)):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        got = lexical.search(table, asked, tiers=tiers)
        assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got.collect()) == plain_search(rows, items)
    assert lexical.search(docs(spark, rows).limit(0), asked).count() == 0
    assert lexical.search(docs(spark, rows), asked.limit(0)).count() == 0


def test_search_stops_where_it_has_proof(spark):
    """Rare terms lie in the first tier: shards that can't reach the tenth document aren't read again."""
    common = "of and to in"
    rows = [(i, f"{common} rare{i // 20} filler{i % 7}", "s") for i in range(400)]
    table = docs(spark, rows).repartitionByRange(20, "doc_id")
    asked = [type("Item", (), {"number": 1, "terms": ["rare3", "of"], "counts": [1, 1]})]
    found, met = lexical._search(table, asked, 10, (0.3, 0.1))
    assert met[0] == 20 and len(met) > 1 and met[1] == 1
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(60, 70))
    assert np.all(np.diff([r.score for r in found.orderBy("rank").collect()]) <= 0)
