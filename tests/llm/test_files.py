import glob
import hashlib
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstat.llm import common, media, packing, token_files, tokens

from .helpers import docs, edge_rows, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ODD = ["a..b, c.", "don't. it's, we'll.'s", "<|endoftext|> x <|ENDOFTEXT|>.", "naïve … end. É. ×. 3.14, x", "tab\tA B", "İstanbul, ǅ.", "***%%%.,", "日本語。テスト、 x", "x\x1cy\x1dz \x00 q", "Σίσυφος ΣΑΣ. x"]


def test_words_encode_like_whole_texts(tokenizer, monkeypatch):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = [*ODD, *[t for _, t, _ in edge_rows()]]
    want = [ids_of(tokenizer, t)[:-1].astype("<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    monkeypatch.setattr(tokens, "LONG", 50)
    assert tokens.Encoder(tokens.tokenizer_path()).encode(texts) == want
    other = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_word and np.frombuffer(other.encode(["Hello  world."])[0], "<u2").size > 0


def test_punctuation_after_letters_makes_no_new_words(tokenizer, monkeypatch):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = ["Oneash oneash,!! oneash. oneash*** été&&& ÉTÉ!?", None, "", "été oneash"]
    whole = lambda texts: [ids_of(tokenizer, t)[:-1].astype("<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == whole(texts)
    assert {w for w in encoder.words if w[:1].isalpha() or w[0] > 127} == {"oneash".encode(), "été".encode(), "ÉtÉ".encode()}
    odd = ["don't.x we'll''s a'S O'Re \"q\"", "a=\u0338b é\u0301. ÿ.. ß, Þ-ð ×, a÷. x/y", "a.\u0301 b.日 c,9 9,c A-1-b", "ΟΔΟΣ. Σ, a_b [c] {d}~", "e\u0301, E\u0301! ŉ. ﬁ. K, Å."]
    assert encoder.encode(odd) == whole(odd)
    monkeypatch.setattr(tokens, "MOST_WORDS", 12)  # words are forgotten and learned again
    many = [*odd, *[prose(i, 40) for i in range(30)], *texts]
    small = tokens.Encoder(tokens.tokenizer_path())
    assert [small.encode([t])[0] for t in many * 2] == whole(many * 2)


def test_words_are_looked_up_once_a_batch(tokenizer):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = [prose(i, 200) for i in range(50)]
    first, looked = encoder.encode(texts), []

    class Counted(type(encoder.words)):
        def get(self, word, default=None):
            looked.append(word)
            return super().get(word, default)

        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    counted = Counted()
    counted.update(encoder.words)
    encoder.words = counted
    assert encoder.encode(texts) == first == [ids_of(tokenizer, t)[:-1].astype("<u2").tobytes() for t in texts]
    assert sorted(looked) == sorted({w for t in texts for w in t.encode().split()})


def test_frequent_long_words_are_not_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 40)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    learned, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(new), learn(new))[1])
    for i in range(40):
        text = f"extraordinarily {prose(i, 12, 2000)}"
        assert encoder.encode([text])[0] == ids_of(tokenizer, text)[:-1].astype("<u2").tobytes()
    assert len(encoder.words) < 60 < len(learned) and learned.count(b"extraordinarily") == 1


@pytest.mark.parametrize("long_", [1 << 22, 1000])
def test_batches_and_spaces_keep_texts_apart(tokenizer, monkeypatch, long_):
    monkeypatch.setattr(tokens, "LONG", long_)
    odd = [f"a{chr(i)}b" for i in range(128)] + ["", None, " \x0b\x0c\t", " a ", ".", " .", ". ", "\x1c", "\x85", "\xa0x\u2003y\u3000"]
    texts = [x for i, t in enumerate(odd) for x in (t, prose(i, i * 7 % 50))]
    want = [ids_of(tokenizer, t)[:-1].astype("<u2").tobytes() for t in texts]
    assert tokens.Encoder(tokens.tokenizer_path()).encode(texts) == want
    assert tokens.Encoder(tokens.tokenizer_path()).encode([None, ""]) == [b"", b""] and not tokens.Encoder(tokens.tokenizer_path()).encode([])


def test_slices_hold_all_rows_and_bounded_texts(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 100)
    texts = [None, "", "é" * 300, *["x" * (i % 40) for i in range(200)], None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    got = list(tokens.slices(batch, 1))
    assert [x for part in got for x in part.column(0).to_pylist()] == list(range(len(texts))) and len(got) > 20
    assert all(sum(len((t or "").encode()) for t in part.column(1).to_pylist()[1:]) <= 100 for part in got)
    assert not list(tokens.slices(batch.slice(0, 0), 1)) and len(list(tokens.slices(batch.slice(0, 2), 1))) == 1


@pytest.mark.parametrize("shard_bytes", [1 << 24, 20_000])
def test_token_files_round_trip(spark, tokenizer, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard_bytes)
    rows = edge_rows() + [(2000 + i, t, "s") for i, t in enumerate(ODD)]
    path = common.scratch_path(spark, "tokens")
    token_files.write_token_files(docs(spark, rows), path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    assert len(got) == len(rows)
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append(ids_of(tokenizer, t))
    last = -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        want = by_id[r.doc_id][0]
        assert r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) and r.ids == want.tolist()
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id
    for f in token_files.shard_files(spark, path).collect():
        shard = token_files.TokenFile(f.path)
        known = shard.index[shard.index["null"] == 0]
        if len(known):
            assert shard.find(int(known["doc_id"][-1])).tolist() == by_id[int(known["doc_id"][-1])][0].tolist()
        with pytest.raises(KeyError):
            shard.find(999_999)


def test_token_files_of_nothing(spark):
    path = common.scratch_path(spark, "tokens")
    token_files.write_token_files(docs(spark, edge_rows()).limit(0), path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_media_round_trip(spark):
    rows = edge_rows() + [(3000 + i, "x" * n, "s") for i, n in enumerate((63, 64, 65, 128, 4096))]
    path = common.scratch_path(spark, "media")
    media.write_media(docs(spark, rows).repartition(3), path)
    got = media.media_features(spark, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    texts = {i: (t or "").encode() for i, t, _ in rows}
    features = {}
    for r in got:
        data = texts[r.doc_id]
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bits) == (64, len(payload) // 64, 8)
        assert features.setdefault(data, (r.feature, r.media_sha256, r.length)) == (r.feature, r.media_sha256, r.length)
    heads = {(str(r.doc_id), r.digest, r.offset, r.height) for r in media.media_columns(spark, path).collect()}
    assert heads == {(str(r.doc_id), r.digest, r.offset, r.height) for r in got}
    for f in glob.glob(path.removeprefix("file://") + "/part-*"):
        with tarfile.open(f) as tar:
            names = tar.getnames()
            assert names[-2:] == ["rows.arrow", "trailer"] and len(set(names)) == len(names)
            for n in names[:-2]:
                assert hashlib.sha256(tar.extractfile(n).read()).hexdigest() + ".png" == n


def test_png_of_a_full_tar_block():
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        payload = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        png = media.to_png(payload)
        assert media.from_png(png) == payload and len(png) % media.BLOCK


def check_packing(rows, got, tokenizer):
    want = {}
    for i, t, _ in rows:
        ids = ids_of(tokenizer, t)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            key = (str(i), piece, start, len(own), zlib.crc32(own.tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    sequences = {}
    for r in got:
        key = (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), -(-sum(r.length for r in got) // 4096)


def test_packing_is_exact_and_tight(spark, tokenizer, monkeypatch):
    rows = edge_rows() + [(5000 + i, prose(i, 20 + i * 37 % 900), "s") for i in range(400)]
    used, fewest = check_packing(rows, packing.pack(docs(spark, rows)).collect(), tokenizer)
    assert used <= fewest + 1
    monkeypatch.setattr(packing, "BLOCK", 60)
    used, fewest = check_packing(rows, packing.pack(docs(spark, rows), with_ids=True).collect(), tokenizer)
    assert used <= fewest + 2
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def plain_best_fit(sizes):
    plain = packing.Bins(sizes, 4096)
    plain.best_fit(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True))
    return len(plain.items)


def test_islands_cross_migrate_and_beat_best_fit(spark):
    rng = np.random.default_rng(3)
    blocks = [rng.integers(700, 1700, 200).tolist() for _ in range(6)]
    order = spark.createDataFrame([(b, i, x) for b, sizes in enumerate(blocks) for i, x in enumerate(sorted(sizes, reverse=True))], "block long, index int, length long")
    found = {r.block: r for r in packing.search(order, len(blocks), 4096).collect()}
    for b, sizes in enumerate(blocks):
        r = found[b]
        best = packing.Bins.of(sorted(sizes, reverse=True), 4096, np.frombuffer(r.elite, np.uint32))
        assert len(best.items) == r.bins <= plain_best_fit(sizes) and min(best.free) >= 0
        assert sorted(i for own in best.items for i in own) == list(range(200))
        assert r.crossed == packing.ISLANDS * packing.EPOCHS * packing.GENERATIONS and r.moved == packing.ISLANDS * (packing.EPOCHS - 1)
    assert sum(r.bins for r in found.values()) < sum(map(plain_best_fit, blocks))


def test_generations_keep_an_island_varied():
    """A child is no copy in fitness of another packing, and later generations still save bins."""
    sizes = sorted(np.random.default_rng(7).integers(700, 1700, 1000).tolist(), reverse=True)
    rng = np.random.default_rng(1)
    island = packing.settle(sizes, 4096, 0, rng)
    bins = []
    for at in range(101):
        if at in (0, 12, 100):
            bins.append(min(len(x.items) for x in island))
        packing.generation(island, rng)
    assert bins[0] > bins[1] > bins[2] and bins[2] <= 301
    assert len(island) >= 8 and len({x.fitness() for x in island}) == len(island)
    for x in island:
        assert sorted(i for own in x.items for i in own) == list(range(1000))
        assert x.free == [4096 - sum(sizes[i] for i in own) for own in x.items] and min(x.free) >= 0


def test_children_share_whole_bins_and_leave_their_parents_alone():
    sizes = np.random.default_rng(2).integers(1, 1500, 600).tolist()
    rng = np.random.default_rng(4)
    parents = packing.settle(sizes, 4096, 1, rng)[:2]
    before = [([list(x) for x in p.items], list(p.free)) for p in parents]
    for _ in range(20):
        for child in (packing.mutate(parents[0], rng), packing.cross(*parents, rng)):
            theirs = {id(x) for p in parents for x in p.items}
            assert sum(id(x) in theirs for x in child.items) > len(child.items) // 10
            assert sorted(i for x in child.items for i in x) == list(range(600))
            assert child.free == [4096 - sum(sizes[i] for i in x) for x in child.items] and min(child.free) >= 0
    assert before == [(p.items, p.free) for p in parents]


@pytest.mark.parametrize("high", [3, 40, 1500, 4097])
def test_best_fit_takes_the_tightest_bin(high):
    sizes = np.random.default_rng(high).integers(1, high, 900).tolist()
    free = []
    for x in sizes:
        fits = [j for j, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits, key=free.__getitem__)] -= x
        else:
            free.append(4096 - x)
    got = packing.Bins(sizes, 4096)
    got.best_fit(list(range(900)))
    assert sorted(got.free) == sorted(free) and sorted(i for x in got.items for i in x) == list(range(900))
    again = packing.Bins.of(sizes, 4096, got.packing())
    assert again.free == got.free and again.items == got.items and again.fitness() == got.fitness()
    assert got.perfect() == (len(free) <= -(-sum(sizes) // 4096) and sum(f > 0 for f in free) <= 1)


def test_generations_are_enough_to_save_bins(spark):
    sizes = sorted(np.random.default_rng(7).integers(700, 1700, 1000).tolist(), reverse=True)
    order = spark.createDataFrame([(0, i, x) for i, x in enumerate(sizes)], "block long, index int, length long")
    r = packing.search(order, 1, 4096).first()
    best = packing.Bins.of(sizes, 4096, np.frombuffer(r.elite, np.uint32))
    assert r.crossed >= 300 and min(best.free) >= 0 and len(best.items) == r.bins
    assert r.bins <= 300 < plain_best_fit(sizes)


def test_islands_work_on_the_registered_table(spark):
    """Blocks of real lengths are not perfect after best fit: children are born and elites move."""
    lengths = common.read(spark, "/root/testdata/sf0.001", "documents").selectExpr("0L AS block", "CAST(least(4096, 1 + length(text) div 5) AS BIGINT) AS length")
    order = lengths.withColumn("index", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("length"))) - 1)
    r = packing.search(order, 1, 4096).first()
    assert r.crossed > 0 and r.moved > 0


def test_pieces_that_do_not_fit_together_come_to_an_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    placed = packing.place(spark.range(100).selectExpr("id AS at", "2100L AS length"), 4096).collect()
    assert len({r.sequence_id for r in placed}) == 100 and all(r.offset == 0 for r in placed)


def test_one_long_text_does_not_switch_the_dictionary_off(spark, tmp_path):
    long_ = prose(5, 40_000)  # more than is trained on, in any order of hashes
    rows = [(i, long_ if i % 2 else prose(i, 300), "s") for i in range(40)]
    token_files.write_token_files(docs(spark, rows), f"file://{tmp_path}/ids")
    files = [p for p in (tmp_path / "ids").iterdir() if p.name.startswith("part-")]
    assert files and all(token_files.HEAD.unpack(p.read_bytes()[: token_files.HEAD.size])[3] > 1000 for p in files)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/ids", with_ids=False).count() == 40
