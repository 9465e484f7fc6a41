"""Toxicity by a weighted finite-state grammar over clauses.

Words and two-word phrases become symbols (insult, threat, target, negation, report, other), and five small transducers
read the symbols of a clause side by side: insults and threats emit their weight, an address before or a target before
or after strengthens them, negation within three words and reported speech weaken them. A machine may guess what is
still to come (a threat that will find its target) in a state that no clause may end in. Their composition is one table;
a clause is worth its best accepted path, a document's score is a logistic function of its clauses' sum.

The lexicon starts from written-down words; labelled documents add words, stems and phrases that are found nearly only
in toxic ones, and set the weights and the logistic function. They are a bounded sample (MOST_LABELLED) of
labelled rows; every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialize, read, tidy

#: Labelled rows that the lexicon and the scale are learned from, at most, by hash of doc_id.
MOST_LABELLED = 20_000
#: A stem is a word's first letters, of these lengths.
STEMS = (4, 5, 6, 7)
#: Entries need this share of the toxic sample, this many documents, and this share of toxic ones among those with them. So
#: their number is at most the features of one document over SUPPORT, whatever the sample.
SUPPORT, LEAST, PURITY = 0.01, 4, 0.9
#: Harmless words that a scorer remembers; beyond that it starts anew.
MOST_SEEN = 200_000
SEED_WEIGHT, TOP_WEIGHT = 2.5, 6.0
#: Characters of a text that are in hand at a time.
PART = 1 << 20
#: Texts of an Arrow batch of the query.
BATCH_ROWS = 500

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
LEXICON = {
    INSULT: """idiot idiots moron morons stupid dumb trash scum loser losers pathetic disgusting worthless clown fool imbecile jerk bastard asshole
        dumbass scumbag filth vermin idiota imbecil estupido estúpido basura asqueroso payaso idiote imbécile stupide ordure connard minable dégoûtant
        trottel dummkopf abschaum versager ekelhaft erbärmlich arschloch""".split(),
    THREAT: "kill murder hurt destroy shoot stab beat strangle tuer frapper matar golpear töten umbringen schlagen".split(),
    TARGET: "you your yours yourself u they them their he she him her his people vous tu te toi tus usted ustedes du dich dir ihr euch".split(),
    NEGATION: "not no never neither nor isn't aren't don't doesn't wasn't won't can't pas jamais nunca jamás nicht kein keine nie niemals".split(),
    REPORT: "said says told reported quoted wrote called claimed alleged dijo dit sagte schrieb nannte".split(),
}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol] holds the arcs (next state, factor on the symbol's weight); final[state]: a clause may end here."""

    step: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    final: tuple[bool, ...]

    def best(self, symbols: list[tuple[int, float]]) -> float:
        """The largest sum of weights times factors over the paths from state 0 that end in a final state."""
        paths = {0: 0.0}
        for symbol, weight in symbols:
            ahead: dict[int, float] = {}
            for state, total in paths.items():
                for to, factor in self.step[state][symbol]:
                    value = total + weight * factor
                    if value > ahead.get(to, -1.0):
                        ahead[to] = value
            paths = ahead
        return max(total for state, total in paths.items() if self.final[state])


def _machine(states: int, arcs: dict[tuple[int, int], tuple[tuple[int, float], ...]], stay=lambda s: s, owing: tuple[int, ...] = ()) -> Transducer:
    return Transducer(tuple(tuple(arcs.get((s, x), ((stay(s), 1.0),)) for x in range(6)) for s in range(states)), tuple(s not in owing for s in range(states)))


#: An address earlier in the clause strengthens an insult.
ADDRESS = _machine(2, {(0, TARGET): ((1, 1.0),), (1, INSULT): ((1, 1.5),)})
#: A threat counts in full with someone it is aimed at; alone a verb is weak. State 1: someone was named. State 2: a threat
#: was taken as aimed, and someone is still to be named; no clause ends here.
AIM = _machine(3, {(0, THREAT): ((0, 0.1), (2, 1.0)), (0, TARGET): ((1, 1.0),), (2, TARGET): ((1, 1.0),)}, owing=(2,))
#: Insults count as they are.
PLAIN = _machine(1, {})
#: Negation holds for the three words after it.
DENIAL = _machine(4, {(s, NEGATION): ((3, 1.0),) for s in range(4)} | {(s, x): ((s - 1, 0.25),) for s in (1, 2, 3) for x in (INSULT, THREAT)}, lambda s: max(0, s - 1))
#: What follows a verb of saying in its clause is somebody else's.
SPEECH = _machine(2, {(0, REPORT): ((1, 1.0),)} | {(1, x): ((1, 0.4),) for x in (INSULT, THREAT)})


def compose(*machines: Transducer) -> Transducer:
    """Machines side by side: product states, every choice of arcs, factors multiplied; final where all are."""
    states = list(product(*[range(len(m.step)) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for state in states:
        row = []
        for x in range(6):
            choices = product(*[m.step[s][x] for m, s in zip(machines, state, strict=True)])
            row.append(tuple((number[tuple(a[0] for a in arcs)], float(np.prod([a[1] for a in arcs]))) for arcs in choices))
        table.append(tuple(row))
    return Transducer(tuple(table), tuple(all(m.final[s] for m, s in zip(machines, state, strict=True)) for state in states))


GRAMMAR = compose(PLAIN, ADDRESS, AIM, DENIAL, SPEECH)


@dataclass
class Model:
    """words and stems give (symbol, weight), phrases of two words the weight of an insult; score = 1 / (1 + exp(-(slope * log(1 + sum) + intercept)))."""

    words: dict[str, tuple[int, float]] = field(default_factory=lambda: {w: (x, SEED_WEIGHT if x in (INSULT, THREAT) else 0.0) for x, ws in LEXICON.items() for w in ws})
    stems: dict[str, float] = field(default_factory=dict)
    phrases: dict[tuple[str, str], float] = field(default_factory=dict)
    slope: float = 4.0
    intercept: float = -3.0

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return self.words[word]
        best = max((self.stems.get(word[:n], 0.0) for n in STEMS), default=0.0) if self.stems else 0.0
        return (INSULT, best) if best > 0 else (OTHER, 0.0)


class Scorer:
    """Sums the clauses of texts; remembers words that are neither insult nor threat."""

    def __init__(self, model: Model):
        self.model, self.seen = model, set()

    def total(self, text: str | None) -> float:
        """The sum over all clauses; a very long text is gone through part by part, each cut at a clause's end."""
        total, at = 0.0, 0
        text = (text or "").lower()
        while at < len(text):
            end = CLAUSE.search(text, at + PART) if len(text) - at > PART else None
            stop = end.end() if end else len(text)
            total += self._part(text[at:stop])
            at = stop
        return total

    def _part(self, text: str) -> float:
        if len(self.seen) > MOST_SEEN:
            self.seen.clear()
        words = WORD.findall(text)
        hit = bool(self.model.phrases) and not self.model.phrases.keys().isdisjoint(zip(words, words[1:]))
        for w in set(words).difference(self.seen):
            if self.model.symbol(w)[0] in (INSULT, THREAT):
                hit = True
            else:
                self.seen.add(w)
        return sum(self.clause(c) for c in CLAUSE.split(text)) if hit else 0.0

    def clause(self, clause: str) -> float:
        """The best path's weights of one clause. A phrase stands before its second word, or in its place if that is nothing else."""
        symbols, before = [], ""
        for w in WORD.findall(clause):
            own = self.model.symbol(w)
            phrase = self.model.phrases.get((before, w))
            if phrase:
                symbols.append((INSULT, phrase))
            if not phrase or own[0] != OTHER:
                symbols.append(own)
            before = w
        return GRAMMAR.best(symbols) if any(x in (INSULT, THREAT) for x, _ in symbols) else 0.0

    def score(self, total: float) -> float:
        return float(1 / (1 + np.exp(-(self.model.slope * np.log1p(total) + self.model.intercept))))


def _features(text: str | None) -> set[str]:
    """Distinct words, as they are, their stems, with an asterisk, and the phrases of two words of a clause, with a blank."""
    text = (text or "").lower()
    words = set(WORD.findall(text))
    stems = {w[:n] + "*" for n in STEMS for w in words if len(w) >= n}
    clauses = (WORD.findall(c) for c in CLAUSE.split(text))
    return words | stems | {f"{a} {b}" for c in clauses for a, b in zip(c, c[1:])}


def _counts(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to how many documents of the partition have each feature."""
    counts: Counter = Counter()
    for batch in batches:
        for _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _features(text)
            counts.update(found if only is None else found & only)
    names = list(counts)
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[x] for x in part], pa.int64())], names=["feature", "n"])


def _totals(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([scorer.total(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["toxic", "total"])


def _count_features(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    return rows.mapInArrow(lambda it: _counts(it, only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most_labelled: int = MOST_LABELLED) -> Model:
    """The model from labels (doc_id, toxic 0/1; other values are left out, of several for one id, or
    for equal texts, the largest counts).

    Without any toxic, or any other, labelled document the written-down lexicon stands as it is.
    """
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
    chosen = docs.sparkSession.createDataFrame(marks.collect(), "__id long, toxic int")  # most_labelled rows of two numbers
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    rows = materialize(rows, "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not bad or not good:
        return model
    least = max(LEAST, SUPPORT * bad)
    in_bad = _count_features(rows.where("toxic = 1"), None).where(F.col("n") >= least).collect()  # bounded, see SUPPORT
    names = frozenset(r["feature"] for r in in_bad) | {w for x in (INSULT, THREAT) for w in LEXICON[x]}
    in_good = {r["feature"]: r["n"] for r in _count_features(rows.where("toxic = 0"), names).collect()}
    entries = []
    for r in in_bad:
        a, b = r["n"], in_good.get(r["feature"], 0)
        if a >= PURITY * (a + b):
            entries.append((r["feature"], min(TOP_WEIGHT, float(np.log((a + 0.5) / (b + 0.5) * (good + 1) / (bad + 1))))))
    for name, weight in sorted(entries, key=lambda e: (" " in e[0], e[0])):  # phrases last
        if weight <= 0:
            continue
        if " " in name:
            first, second = name.split(" ")
            if model.symbol(first)[0] not in (INSULT, THREAT) and model.symbol(second)[0] not in (INSULT, THREAT):
                model.phrases[first, second] = weight
        elif name.endswith("*"):
            model.stems[name[:-1]] = weight
        elif name not in model.words or model.words[name][0] in (INSULT, THREAT):
            model.words[name] = (model.words.get(name, (INSULT, 0.0))[0], weight)
    toxic_names = {r["feature"]: r["n"] for r in in_bad}
    for x in (INSULT, THREAT):
        for w in LEXICON[x]:
            if in_good.get(w, 0) > toxic_names.get(w, 0):  # a word that clean documents use more often says nothing
                model.words[w] = (x, 0.0)
    found = rows.mapInArrow(lambda it: _totals(it, model), "toxic int, total double").groupBy("toxic", F.round(F.log1p("total"), 1).alias("x")).agg(F.count("*").alias("n")).collect()
    y, x, n = (np.array([r[c] for r in found], float) for c in ("toxic", "x", "n"))
    model.slope, model.intercept = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton steps, the slope with a ridge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        g = design.T @ (n * (p - y)) + ridge * np.array([w[0], 0.01 * w[1]])
        h = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.diag([1.0, 0.01])
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        text = batch.column(len(batch.columns) - 1)
        scores = [scorer.score(scorer.total(t.as_py())) for t in text]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=schema)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for every row of docs: 0 to 1, higher for likelier toxic; null and empty texts have the score of no match.

    Nothing but the text enters a score. Rows that repeat are scored each; null ids are kept; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: tidy(_score_rows(it, model, schema)), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows of docs that score below bar, with all their columns.

    Null and empty texts match nothing and stay, rows that repeat are judged alike, an empty table stays empty.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array([scorer.score(scorer.total(t.as_py())) < bar for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lambda it: tidy(rows(it)), docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labelled rows outside the held-out fifth."""
    return labels.where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with batches_of(spark, BATCH_ROWS):
        model = learn(docs, training_labels(read(spark, sf_dir, "labels")))
        out = materialize(score(docs, model), "toxic-scores")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
