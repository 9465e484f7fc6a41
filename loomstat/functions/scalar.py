"""Scalar functions as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \n\r\t\u000b\u0000"


def trim(text: Column, left: bool = True, right: bool = True) -> Column:
    """Without blanks (space, LF, CR, TAB, VT, NUL) at the chosen ends."""
    if left and right:
        return F.btrim(text, F.lit(BLANKS))
    return F.ltrim(text, F.lit(BLANKS)) if left else F.rtrim(text, F.lit(BLANKS)) if right else text


def split_keep_empty(text: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters; empty parts count."""
    if len(delimiters) == 1 and delimiters not in r"\.[{()*+?^$|":
        return F.split(text, delimiters, -1)  # a plain character is found without a regular expression
    quoted = "".join("\\" + c if c in r"\]^-[&" else c for c in delimiters)
    return F.split(text, f"[{quoted}]", -1)


def to_double(text: Column) -> Column:
    """The number that text begins with, 0 where it doesn't begin with one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def to_long(text: Column) -> Column:
    """The integer that text begins with, 0 where it doesn't begin with one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def sigmoid(z: Column, cut: float = 30.0, low: float = 0.0, high: float = 1.0) -> Column:
    """1 / (1 + e^-z), low below -cut and high above cut."""
    return F.when(z > cut, F.lit(high)).when(z < -cut, F.lit(low)).otherwise(1.0 / (1.0 + F.exp(-z)))


def boosted_sigmoid(z: Column) -> Column:
    """The sigmoid of binary boosting: kept within 1e-5 and 0.99999 beyond 12."""
    return sigmoid(z, 12.0, 1e-5, 0.99999)


def softplus(z: Column, cut: float = 30.0) -> Column:
    """log(1 + e^z), z above cut and 0 below -cut."""
    return F.when(z > cut, z).when(z < -cut, F.lit(0.0)).otherwise(F.log1p(F.exp(z)))


def l1_subgradient(w: Column, g: Column, lam: float, zero_inside: bool = False) -> Column:
    """Gradient g with lam * |w| added. At w = 0 it shrinks towards 0 by lam where |g| > lam; inside it stays as it is, or is 0 with zero_inside."""
    inside = F.lit(0.0) if zero_inside else g
    at_zero = F.when(g > lam, g - lam).when(g < -lam, g + lam).otherwise(inside)
    return F.when(w > 0, g + lam).when(w < 0, g - lam).otherwise(at_zero)


def clip_crossing(old: Column, new: Column) -> Column:
    """new, or 0 where the sign turned."""
    return F.when(old * new < 0, F.lit(0.0)).otherwise(new)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, d: acc + d)


def gaussian_2d(x: Column, y: Column, mx: Column, my: Column, vx: Column, vy: Column, cov: Column) -> Column:
    """exp(-d/2) / sqrt(det) for the Mahalanobis distance d, without the constant; null where the covariance is singular."""
    det = vx * vy - cov * cov
    dx, dy = x - mx, y - my
    maha = (vy * dx * dx - 2 * cov * dx * dy + vx * dy * dy) / F.when(det > 0, det)
    return F.exp(-maha / 2) / F.sqrt(F.when(det > 0, det))


def tricube(distance: Column, longest: Column) -> Column:
    u = F.abs(distance) / longest
    v = 1 - u * u * u
    return v * v * v


def bisquare(residual: Column, median: Column) -> Column:
    """(1 - (r/6m)^2)^2 within six medians, 0 beyond."""
    u = residual / (6 * median)
    return F.when(F.abs(residual) < 6 * median, (1 - u * u) * (1 - u * u)).otherwise(F.lit(0.0))


def growth_penalty(x: Column, degree: int) -> Column:
    """What one more breakpoint costs after x of them: 1 (degree 0 gives 0), by degree 1 linear, 2 quadratic."""
    return {0: F.lit(0.0), 1: F.lit(1.0)}.get(degree, 2 * x + 1)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: Products of z-normed windows up to this are 0 but for rounding.
ZERO = 1e-9


def sign_hash(window: Column, base: Column) -> Column:
    """A bit for each row of base, the first row's highest: set where window's product with it is positive, which what rounding leaves of a 0 isn't."""

    def bits(w: Column) -> Column:
        bit = lambda acc, row: F.shiftleft(acc, 1).bitwiseOR(F.when(dot(w, row) > ZERO, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        return F.aggregate(base, F.lit(0).cast("long"), bit)

    return let(window, bits)
