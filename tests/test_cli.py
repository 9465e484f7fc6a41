import pytest

from loomstat import cli
from loomstat.sources import models

THREE = "\n".join(["2\tC"] * 5 + ["1\tA"] * 5 + ["0\tB"] * 10) + "\n"
TWO = "\n".join(["1\tA\t1"] * 10 + ["1\tB\t1\tC\t1"] + ["0\tB\t1\tC\t1"] + ["0\tB\t1"] * 8) + "\n"
WORDS = "A\tB\tC\nA\tB\tC\nA\tB\tD\nF\tG\tH\nF\tG\tI\n"


@pytest.mark.parametrize(
    ("program", "content", "options", "made"),
    [
        ("lr", TWO, "--rate 0.1 --mode exact --iterations 2", "coe"), ("batch", TWO, "--lam 0.5 --norm 2", "coe"), ("latent", TWO, "--rate 0.1 --norm 2 --iterations 2", "coe"),
        ("gbm", THREE, "--rate 0.5 --iterations 1 --leaves 3 --depth 2 --binary", "class_0"), ("gblr", TWO, "--rate 0.5 --iterations 2", "trees"), ("gbrank", TWO, "--rate 0.5 --iterations 1", "trees"),
        ("kmeans", "1 0\n0.9 0.1\n0 1\n0.1 0.9\n", "--k 2 --width 2 --min-potential 0.1", "cents"), ("gauss2d", "1\t2\n2\t1\n1\t1\n9\t9\n8\t9\n9\t8\n", "--k 2", "centers"),
        ("louvain", "a\tb\t1\nb\tc\t1\na\tc\t1\nx\ty\t2\n", "--mode exact", "communities"), ("lda", "d\tw\nd\tv\ne\tw\n", "--k 2 --iterations 2", "doc_topic"),
        ("local-lda", "d\tq\tw\nd\tq\tv\n", "--k 2 --iterations 2", "token_topic"), ("region-lda", "d\tw\t1\t2\nd\tv\t2\t1\ne\tw\t3\t3\n", "--k 2 --regions 2 --iterations 2", "token_topic"),
        ("w2v", WORDS, "--k 3 --iterations 1", "vector"), ("d2v", WORDS, "--k 3 --iterations 1", "dvector"), ("rnn", WORDS, "--k 3 --iterations 1", "network"),
    ],
)
def test_programs(spark, tmp_path, program, content, options, made):
    (tmp_path / "in").write_text(content)
    cli.main([program, "--train", str(tmp_path / "in"), "--out", str(tmp_path / "out"), *options.split()], spark)
    assert list((tmp_path / "out" / made).glob("part-*"))


def test_score_uses_saved_trees(spark, tmp_path):
    (tmp_path / "in").write_text(TWO)
    cli.main(["gblr", "--train", str(tmp_path / "in"), "--test", str(tmp_path / "in"), "--out", str(tmp_path / "m"), "--rate", "0.5", "--iterations", "2"], spark)
    cli.main(["score", "--train", str(tmp_path / "in"), "--init", str(tmp_path / "m/trees"), "--out", str(tmp_path / "s"), "--rate", "0.5"], spark)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20 and len(models.load_trees(spark, str(tmp_path / "m/trees"))) == 2
    with pytest.raises(SystemExit):
        cli.arguments(["lr", "--train", "x", "--out", "y"])


def test_gbm_scores_a_test_file_and_starts_from_scores(spark, tmp_path, capsys):
    (tmp_path / "in").write_text(THREE)
    (tmp_path / "start").write_text("0\t0.5\t1\n" * 20)
    files = ["--train", str(tmp_path / "in"), "--test", str(tmp_path / "in"), "--init", str(tmp_path / "start"), "--test-init", str(tmp_path / "start")]
    cli.main(["gbm", *files, "--out", str(tmp_path / "m"), *"--rate 0.5 --iterations 2 --leaves 3 --depth 2 --binary".split()], spark)
    assert spark.read.parquet(str(tmp_path / "m/test_scores")).count() == 60
    said = capsys.readouterr().out
    assert all(f"{n} {name}: loss" in said for n in (1, 2) for name in ("train", "test"))


def test_lr_reports_and_saves_each_epoch(spark, tmp_path, capsys):
    (tmp_path / "in").write_text(TWO)
    cli.main(["batch", "--train", str(tmp_path / "in"), "--test", str(tmp_path / "in"), "--out", str(tmp_path / "m"), *"--lam 0.5 --norm 2 --iterations 2 --save-every 1".split()], spark)
    assert list((tmp_path / "m/coe_1").glob("part-*")) and "1 test: loss" in capsys.readouterr().out


def test_vectors_continue_from_a_saved_model(spark, tmp_path):
    (tmp_path / "in").write_text(WORDS)
    for program, made in (("w2v", "vector"), ("d2v", "dvector"), ("rnn", "network")):
        one, two = str(tmp_path / program / "1"), str(tmp_path / program / "2")
        common = [program, "--train", str(tmp_path / "in"), "--k", "3", "--iterations", "1", "--rate", "0.5"]
        cli.main([*common, "--out", one], spark)
        cli.main([*common, "--out", two, "--init", one], spark)
        assert list((tmp_path / program / "2" / made).glob("part-*"))
        if program != "rnn":
            assert (models.load_matrix(spark, f"{one}/inner") != models.load_matrix(spark, f"{two}/inner")).any()
