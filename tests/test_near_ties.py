import numpy as np
import pandas as pd
import pytest

from loomstat.operators import metrics


def plain_ranks(x: np.ndarray) -> np.ndarray:
    at, rank, group = np.argsort(x, kind="stable"), np.empty(len(x)), []
    for place, i in enumerate(at):
        if group and not x[i] - 1e-9 <= x[at[group[0]]]:
            rank[at[group]] = np.mean(group) + 1
            group = []
        group.append(place)
    rank[at[group]] = np.mean(group) + 1
    return rank


@pytest.mark.parametrize("step", [3e-11, 7e-10, 1e-3])
def test_groups_go_on_over_buckets(spark, step):
    """With the first two steps nearly all scores lie within the tolerance of the next: groups run over the borders of all buckets."""
    rng = np.random.default_rng(1)
    x = 0.5 + np.cumsum(rng.random(700)) * step
    x = np.r_[x, x[:50], np.inf, -np.inf, np.nan]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").repartition(5)
    got = metrics.tied_ranks(df, "v", buckets=9).toPandas().set_index("i")["rank"].sort_index().to_numpy()
    assert np.array_equal(got, plain_ranks(x))


def test_area_counts_near_ties_half_and_nulls_lowest(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5 + 8e-10, 0), (0.5 + 1.6e-9, 1), (0.7, 1), (0.1, 0), (None, 0)], "s double, y int")
    for buckets in (1, 3):
        assert metrics.auc(df, "s", "y", buckets).first()["auc"] == pytest.approx((2.5 + 3 + 3) / 9)
    assert metrics.auc(df, "s", "y", tolerance=0).first()["auc"] == pytest.approx((2 + 3 + 3) / 9)
    assert metrics.auc(df.limit(0), "s", "y").first()["auc"] is None


def test_anchors_from_an_open_group():
    x = np.array([1.0, 1 + 5e-10, 1 + 1.2e-9, 1 + 1.9e-9, 2])
    assert metrics._anchored(x, None, 1e-9).tolist() == [1, 1, x[2], x[2], 2]
    assert metrics._anchored(x, 1 - 7e-10, 1e-9).tolist() == [1 - 7e-10, x[1], x[1], x[3], 2]
    assert metrics._anchored(x, 0.5, 1e-9).tolist() == [1, 1, x[2], x[2], 2]
    assert pd.isna(metrics._anchored(np.array([1.0, np.nan]), None, 1e-9)[1])
