"""Distances of sequences as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dtw(x: Column, y: Column) -> Column:
    """Dynamic time warping with squared costs, root of the total; a diagonal step pays its cell twice. -1 for an empty input."""
    big = F.lit(float("inf"))

    def row(above: Column, a: Column) -> Column:
        """The next row of the table; above holds the row before with a cell at its front."""
        start = F.struct(F.array(big).alias("cells"), F.lit(0).alias("j"))

        def cell(acc: Column, b: Column) -> Column:
            c = (a - b) * (a - b)
            diagonal, up, left = above[acc["j"]], above[acc["j"] + 1], F.element_at(acc["cells"], -1)
            return F.struct(F.concat(acc["cells"], F.array(c + F.least(diagonal + c, up, left))).alias("cells"), (acc["j"] + 1).alias("j"))

        return F.aggregate(y, start, cell)["cells"]

    # before the first row: the corner costs nothing, so that the first cell pays itself once, by way of "up"
    def first(acc: Column, b: Column) -> Column:
        c = (x[0] - b) * (x[0] - b)
        last = F.when(F.size(acc) == 1, F.lit(0.0)).otherwise(F.element_at(acc, -1))
        return F.concat(acc, F.array(c + last))

    top = F.aggregate(y, F.array(big), first)
    table = F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), top, row)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.sqrt(F.element_at(table, -1))).otherwise(F.lit(-1.0))


def edit_distance(x: Column, y: Column) -> Column:
    """Levenshtein distance with unit costs; 0 where either is empty."""
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0)).otherwise(F.levenshtein(x, y))


def lcss(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence; 0 where either has fewer than two elements."""

    def row(above: Column, a: Column) -> Column:
        def cell(acc: Column, b: Column) -> Column:
            j = F.size(acc)
            best = F.when(a == b, above[j - 1] + 1).otherwise(F.greatest(above[j], F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(y, F.array(F.lit(0)), cell)

    table = F.aggregate(x, F.transform(F.concat(F.array(F.lit(None).cast("long")), y.cast("array<bigint>")), lambda _: F.lit(0)), row)
    return F.when((F.size(x) < 2) | (F.size(y) < 2), F.lit(0)).otherwise(F.element_at(table, -1))
