import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat import cli
from loomstat.operators import encode, series, trees


class Plain:
    """A dictionary with a stack of freed ids."""

    def __init__(self):
        self.ids, self.freed, self.next = {}, [], 0

    def add(self, name):
        if name not in self.ids:
            if self.freed:
                self.ids[name] = self.freed.pop()
            else:
                self.ids[name], self.next = self.next, self.next + 1

    def free(self, name):
        if name in self.ids:
            self.freed.append(self.ids.pop(name))


def test_names_come_and_go(spark):
    plain, rng = Plain(), np.random.default_rng(2)
    table = lambda names: spark.createDataFrame(list(enumerate(names)), "at long, name string")
    first = [f"w{i}" for i in rng.integers(0, 15, 30)]
    held = encode.first_appearance(table(first), "name", "at")
    for name in first:
        plain.add(name)
    gone = ["w3", "w9", "unknown", "w1", "w3", "w7"]
    held, freed = encode.free(held, table(gone), "name", "at")
    for name in gone:
        plain.free(name)
    for wave in (["x1", "w9", "x1", "w2"], ["y1", "y2", "x1", "y3", "y4", "y5"]):
        held, freed = encode.grow(held, table([*wave, None]), "name", "at", freed)
        for name in wave:
            plain.add(name)
        assert {r["name"]: r["id"] for r in held.collect()} == plain.ids
        assert [r["id"] for r in freed.orderBy("at").collect()] == plain.freed
    assert held.where("name = 'x1'").first()["n"] == 3


def test_growth_from_nothing_and_by_nothing(spark):
    empty = spark.createDataFrame([], "name string, id long, n long")
    tokens = spark.createDataFrame([(5, "b"), (2, "a"), (7, "a")], "at long, name string")
    held, freed = encode.grow(empty, tokens, "name", "at")
    assert sorted(map(tuple, held.collect())) == [("a", 0, 2), ("b", 1, 1)] and freed.isEmpty()
    same, _ = encode.grow(held, tokens.limit(0), "name", "at")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, held.collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 131])
def test_medians_of_all_intervals(n):
    rng = np.random.default_rng(n)
    for y in (rng.normal(size=n), rng.integers(0, 3, n).astype(float)):
        a, b = np.triu_indices(n + 1, 1)
        m = series.IntervalMedians(y)
        assert m.low(a, b).tolist() == [sorted(y[i:j])[(j - i - 1) // 2] for i, j in zip(a, b)]
        k = rng.integers(0, b - a)
        assert m.ranked(a, b, k).tolist() == [sorted(y[i:j])[r] for i, j, r in zip(a, b, k)]


def test_rank_labels_have_no_gaps(spark):
    features = spark.createDataFrame([(i, 0, "f", float(i)) for i in range(4)], "row_id long, pos int, name string, value double")
    for labels in ([0.0, 2.0, 0.0, 2.0], [1.0, 2.0, 1.0, 2.0], [0.0, 0.5, 1.0, 1.0], [0.0, 1.0, None, 1.0]):
        rows = spark.createDataFrame(list(enumerate(labels)), "row_id long, label double")
        with pytest.raises(ValueError, match="without gaps"):
            trees.boost_rank(rows, features, trees.BoostConfig(rate=0.1))


def test_programs_have_their_own_defaults():
    given = lambda program, *more: cli.arguments([program, "--train", "x", "--out", "y", *more])
    a = given("rnn")
    assert (a.rate, a.k, a.window, a.iterations) == (0.001, 50, 3, 1)
    a = given("rnn", "--k", "7", "--rate", "0.5")
    assert (a.rate, a.k, a.window) == (0.5, 7, 3)
    a = given("w2v")
    assert (a.rate, a.k, a.window, a.iterations) == (None, 2, 5, 10)


def test_latent_reports_and_saves_each_epoch(spark, tmp_path, capsys):
    (tmp_path / "in").write_text("\n".join(["1\tA\t1"] * 10 + ["0\tB\t1"] * 8) + "\n")
    for mode in ("exact", "distributed"):
        out = tmp_path / mode
        cli.main(["latent", "--train", str(tmp_path / "in"), "--test", str(tmp_path / "in"), "--out", str(out), *f"--rate 0.1 --norm 2 --k 2 --iterations 2 --save-every 1 --mode {mode}".split()], spark)
        said = capsys.readouterr().out
        assert "1 train: loss" in said and "2 test: loss" in said and list((out / "coe_2").glob("part-*"))
        assert spark.read.text(str(out / "coe")).where(F.col("value").startswith("output weights")).count() == 1
