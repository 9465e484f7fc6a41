import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomstat.llm import ann, common, toxicity

from .helpers import docs, edge_rows, prose


def labelled(n=600):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        text = prose(i, 60).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["moron", "zarqul" + rng.choice(["a", "en", "ist"]), "idiot"]))
        rows.append((1000 + i, " ".join(text), "s"))
        marks.append((1000 + i, 1, int(bad)))
    return rows, marks


def test_learns_words_and_stems_and_holds_out(spark):
    rows, marks = labelled()
    table, labels = docs(spark, rows + edge_rows()), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.learn(table, toxicity.training_labels(labels))
    assert any(s.startswith("zarq") for s in model.stems)
    scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert len(toxicity.score(table, model).collect()) == len(rows + edge_rows())
    wrong = [i for i, _, y in marks if (scores[i] >= 0.5) != y]
    assert len(wrong) <= 4
    assert all(0 <= s <= 1 for s in scores.values()) and scores[101] == scores[100] < 0.5
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.score < 0.5 for r in toxicity.score(table, model).collect())


def test_without_labels_the_lexicon_stands(spark):
    table, labels = docs(spark, edge_rows()), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(table, labels) == toxicity.Model()
    assert toxicity.score(table.limit(0), toxicity.Model()).count() == 0


def test_clauses_not_words():
    s = toxicity.Scorer(toxicity.Model())
    plain, aimed, denied, said = (s.total(t) for t in ("the idiot walked home", "you idiot", "you are not an idiot", "he said the idiot walked home"))
    assert aimed > plain > denied > 0 and plain > said > 0
    assert s.total("they kill you") > 5 * s.total("they. kill time") and s.total("kill you") > s.total("kill time")
    assert s.total("not. idiot") == s.total("idiot")  # negation ends with its clause


def test_long_texts_are_scored_whole(monkeypatch):
    s = toxicity.Scorer(toxicity.Model())
    text = "all is well here, you know. " * 50 + "You idiot! " + "more words, and more. " * 50 + "they will hurt you"
    whole = s.total(text)
    monkeypatch.setattr(toxicity, "PART", 40)
    assert whole == pytest.approx(s.total(text)) and whole > 0


def test_query_scores_in_short_batches(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "s") for i in range(3000)]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def lengths(batches, model, schema):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(len(batch))] * len(batch))], schema=schema)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(toxicity, "_score_rows", lengths)
    got = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and max(r.score for r in got) <= 500
    assert spark.conf.get(name) == before


def test_composition_multiplies():
    assert len(toxicity.GRAMMAR.step) == 1 * 2 * 3 * 4 * 2
    ((_, factor),) = toxicity.GRAMMAR.step[0][toxicity.INSULT]
    assert factor == 1.0


def plain_clause(symbols):
    """The grammar in plain words: what each insult and threat of a clause is worth."""
    total = 0.0
    for i, (x, weight) in enumerate(symbols):
        before, after = [y for y, _ in symbols[:i]], [y for y, _ in symbols[i + 1 :]]
        denied, run = 0, 0  # what negation is left: three words from the last one on
        for y in before:
            run = 3 if y == toxicity.NEGATION else max(0, run - 1)
        denied = run > 0
        worth = weight * (0.25 if denied else 1.0) * (0.4 if toxicity.REPORT in before else 1.0)
        if x == toxicity.INSULT:
            total += worth * (1.5 if toxicity.TARGET in before else 1.0)
        elif x == toxicity.THREAT:
            total += worth * (1.0 if toxicity.TARGET in before + after else 0.1)
    return total


def test_grammar_is_what_its_plain_words_say():
    rng = random.Random(2)
    for _ in range(3000):
        symbols = [(x, rng.choice([1.0, 2.5, 4.0]) if x in (toxicity.INSULT, toxicity.THREAT) else 0.0) for x in rng.choices(range(6), [4, 2, 2, 1, 1, 1], k=rng.randrange(9))]
        assert toxicity.GRAMMAR.best(symbols) == pytest.approx(plain_clause(symbols))


def test_learns_phrases_and_takes_the_larger_of_two_labels(spark):
    rows = [(i, prose(i, 40) + (" go lost then. " if i % 4 == 0 else " then go. lost ") + prose(i + 9999, 20), "s") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "s") for i in range(0, 400, 4)]  # toxic texts once more, marked clean
    marks = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1000 + i, 1, 0) for i in range(0, 400, 4)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    assert ("go", "lost") in model.phrases and model == toxicity.learn(docs(spark, rows[::-1]), labels)
    s = toxicity.Scorer(model)
    assert s.score(s.total("well go lost now")) >= 0.5 > s.score(s.total("well go. lost now"))


def nearest(ids, x, every=5, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = ids[order].tolist()
    return out


def test_search_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 70)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24)) + rng.normal(size=(9, 24)).repeat(100, 0) * 2
    x[100:400] = x[0]  # a very common vector
    x = x.astype(np.float32).astype(float)
    bad = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0] * 3, []]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000 + 5 * i, v, "c") for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    got = ann.search(table, F.col("vec_id") % 5 == 0).collect()
    want = nearest(np.arange(900), x)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12)
    assert set(found) == set(want)
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.97 * 20 * len(want)
    assert found[105] == want[105] and found[0] == want[0]  # ties by vec_id among 301 copies
    assert ann.search(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, cell string")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2), (0, 3)]


def test_anisotropic_codes_keep_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    words = ann.train(x, 4.0)
    approx = lambda eta: words[np.arange(words.shape[0]), ann.encode(x, words, eta)].reshape(len(x), -1)
    along = lambda eta: np.abs(((x - approx(eta)) * x).sum(1)).mean()
    assert along(4.0) < along(1.0)


def test_pipeline_of_nothing(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows, marks = labelled(300)
    rows += [(10_000 + i, rows[1][1], "s") for i in range(5)] + [(20_000, rows[2][1] + " more", "t")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "mixing", "packing"]
    now = common.read(spark, sf, "documents")
    columns, counts = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialize(stage(spark, now, sf), name)
        counts.append(now.count())
        if name != "packing":
            assert now.columns == columns
        if name == "near_dup":
            ids = {r.doc_id for r in now.collect()}
            assert not ids & set(range(10_000, 20_001)) and len(ids) == counts[-1]
        if name == "mixing":
            taken = {r.doc_id for r in now.collect()}
    assert taken <= ids and {r.doc_id for r in now.collect()} == taken
    run = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, now.select(*key).collect()))


def test_pipeline_of_nulls_repeats_and_long_texts(spark, tmp_path):
    """Every kept document's taken copies lie whole in the sequences; copies and repeated rows are taken for one."""
    rows, sf = edge_rows(), str(tmp_path)
    spark.createDataFrame([(i, t, None if i == 3 else "en", s, len(t) if t else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = common.read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, sf), name)
        if name == "toxicity":
            assert now.count() == len(rows)
        if name == "near_dup":
            kept = [r.doc_id for r in now.collect()]
            assert 103 in kept and 104 not in kept and kept.count(105) == 1
    taken = Counter(r.doc_id for r in now.collect())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: sum(p == 0 for p, *_ in got) for i, got in pieces.items()} == taken
    for got in pieces.values():
        copies = sum(p == 0 for p, *_ in got)
        assert all(start == 4096 * p and 0 < n <= 4096 for p, start, n in got) and len(got) % copies == 0
    for got in places.values():
        got.sort()
        assert [o for o, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and sum(n for _, n in got) <= 4096


def test_query_rows_of_one_id_answer_alike_over_any_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(200)] + [(20, [float(x) for x in rng.normal(size=16)]) for _ in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    answers = [sorted(tuple(r) for r in ann.search(table.repartition(n), F.col("vec_id") % 20 == 0, k=3).collect()) for n in (1, 3, 7)]
    assert answers[0] == answers[1] == answers[2]
