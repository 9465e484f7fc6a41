"""Spherical k-means with outliers and two-dimensional Gaussian clusters with hard assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions import scalar
from loomstat.scratch import cut

OUTLIER = 0.8


def _centers(centers: list[list[float]]) -> Column:
    """k centers as one literal; k and the width are parameters, not data."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])


def nearest(points: DataFrame, v: str, centers: list[list[float]]) -> DataFrame:
    """Add cls and dist, the first of the centers with the smallest squared distance."""
    d = F.transform(_centers(centers), lambda c: scalar.squared_distance(F.col(v), c))
    best = F.array_min("__d")
    return points.withColumn("__d", d).withColumn("dist", best).withColumn("cls", (F.array_position("__d", best) - 1).cast("int")).drop("__d")


def assign(points: DataFrame, v: str, centers: list[list[float]], outlier: float = OUTLIER) -> DataFrame:
    """nearest() with cls -1 where the distance is above outlier."""
    return nearest(points, v, centers).withColumn("cls", F.when(F.col("dist") > outlier, -1).otherwise(F.col("cls")))


def unit_means(assigned: DataFrame, v: str, cls: str = "cls") -> DataFrame:
    """cls, center: the mean of each cluster's points, scaled to length 1. Outliers (-1) have none."""
    parts = assigned.where(F.col(cls) >= 0).select(cls, F.posexplode(v).alias("at", "x")).groupBy(cls, "at").agg(F.avg("x").alias("m"))
    by = parts.groupBy(cls).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("p"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return by.select(cls, F.transform("p", lambda p: F.when(F.col("norm") > 0, p["m"] / F.col("norm")).otherwise(0.0)).alias("center"))


def grow_centers(points: DataFrame, v: str, centers: list[list[float]], k: int, *, min_distance: float = 0.0, min_potential: float = 1000.0, seed: int = 0, key: str = "row_id") -> list[list[float]]:
    """More centers, drawn from the points with chance in proportion to squared distance, while the sum stays above min_potential.

    The draw is a weighted race (smallest -ln(u) / weight, u from a hash of the key), one aggregation a center.
    """
    centers = [list(map(float, c)) for c in centers]
    if not centers:
        first = points.where(F.col(key).isNotNull()).select(v).orderBy(F.xxhash64(F.col(key), F.lit(seed))).first()
        centers = [list(map(float, first[0]))] if first else []
    while centers and len(centers) < k:
        d = nearest(points, v, centers).withColumn("w", F.when(F.col("dist") >= min_distance, F.col("dist")).otherwise(0.0))
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(len(centers))), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        got = d.agg(F.sum("w").alias("s"), F.min_by(v, F.when(F.col("w") > 0, -F.log(u) / F.col("w"))).alias("v")).first()
        if got["s"] is None or got["s"] <= min_potential or got["v"] is None:
            break
        centers.append(list(map(float, got["v"])))
    return centers


def kmeans(points: DataFrame, v: str, k: int, *, centers: list[list[float]] | None = None, key: str = "row_id", outlier: float = OUTLIER, max_iterations: int = 20, min_distance: float = 0.0, min_potential: float = 1000.0, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """(key, cls, dist) and the centers after assignments and unit means in turn, until at most n/256 rows change cluster.

    At max_iterations the centers are one step newer than the assignment. An empty cluster keeps its center.
    """
    points = points.select(key, F.col(v).cast("array<double>").alias(v))
    centers = grow_centers(points, v, centers or [], k, min_distance=min_distance, min_potential=min_potential, seed=seed, key=key)
    n = points.count()
    before = None
    for _ in range(max_iterations):
        now = cut(assign(points, v, centers, outlier))
        moved = n if before is None else now.select(key, "cls").join(before.select(key, F.col("cls").alias("was")), key).where("cls <> was").count()
        before = now
        if moved <= n // 256:
            break
        for r in unit_means(now, v).collect():  # a row a cluster
            centers[r["cls"]] = list(r["center"])
    return before.select(key, "cls", "dist"), centers


def gaussian_stats(points: DataFrame, cls: str, x: str, y: str) -> DataFrame:
    """cls, n, mx, my, vx, vy, cov, det of each cluster, population moments."""
    t = points.groupBy(cls).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cov"))
    return t.withColumn("det", F.col("vx") * F.col("vy") - F.col("cov") * F.col("cov"))


def gaussian_assign(points: DataFrame, x: str, y: str, stats: list, old: str | None = None) -> DataFrame:
    """Add cls of the largest density, the first of equals; singular clusters take nobody, and a point without any keeps old."""
    dens = [F.coalesce(scalar.gaussian_2d(F.col(x), F.col(y), *[F.lit(float(s[n])) for n in ("mx", "my", "vx", "vy", "cov")]), F.lit(-1.0)) for s in stats]
    best = F.array_max("__d")
    names = F.array(*[F.lit(int(s["cls"])) for s in stats])
    keep = F.col(old) if old else F.lit(-1)
    out = points.withColumn("__d", F.array(*dens)).withColumn("__b", best)
    pick = F.when(F.col("__b") >= 0, F.element_at(names, F.array_position("__d", F.col("__b")).cast("int"))).otherwise(keep)
    return out.withColumn("cls", pick.cast("int")).drop("__d", "__b")


def gaussian_clusters(points: DataFrame, k: int, *, key: str = "row_id", x: str = "x", y: str = "y", max_iterations: int = 20, seed: int = 0) -> tuple[DataFrame, list]:
    """(key, x, y, cls) and the clusters' statistics; ends when at most n/1000 rows change. Starts from centers drawn by plain distance."""
    pts = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("v"))
    first = pts.orderBy(F.xxhash64(F.col(key), F.lit(seed))).first()
    centers = [list(first["v"])]
    while len(centers) < k:
        d = nearest(pts, "v", centers).withColumn("w", F.sqrt("dist"))
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(len(centers))), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        got = d.agg(F.min_by("v", F.when(F.col("w") > 0, -F.log(u) / F.col("w"))).alias("v")).first()
        if got["v"] is None:
            break
        centers.append(list(got["v"]))
    now, n = cut(nearest(pts, "v", centers).select(key, "x", "y", "cls")), pts.count()
    for _ in range(max_iterations):
        stats = sorted(gaussian_stats(now, "cls", "x", "y").collect(), key=lambda s: s["cls"])
        new = cut(gaussian_assign(now.withColumnRenamed("cls", "was"), "x", "y", stats, "was"))
        moved = new.where("cls <> was").count()
        now = new.drop("was")
        if moved <= n // 1000:
            break
    return now, gaussian_stats(now, "cls", "x", "y").orderBy("cls").collect()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x)
