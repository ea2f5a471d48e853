"""Array expressions for the subvector algebra.

Positions are zero-based. ``x`` = odd positions, ``y`` = even positions, and the sign
matrix Q negates the even positions, so  w.Q.w' = x.x' - y.y'  and  w.w' = x.x' + y.y'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: squared norms are floored at this value before the square root, so a
# zero vector stays zero after normalisation.
NORM_EPS = 1e-12


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return F.transform(_c(v), lambda e: e.cast("double"))


def x_part(v: Column | str) -> Column:
    """Odd positions (the subvector the reference calls +1)."""
    return F.filter(_c(v), lambda e, i: i % 2 == 1)


def y_part(v: Column | str) -> Column:
    """Even positions (the subvector the reference calls -1)."""
    return F.filter(_c(v), lambda e, i: i % 2 == 0)


def sign_flip(v: Column | str) -> Column:
    """Q v: negate even positions."""
    return F.transform(_c(v), lambda e, i: F.when(i % 2 == 0, -e).otherwise(e))


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, t: acc + t)


def sq_norm(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, t: acc + t.cast("double") * t.cast("double"))


def safe_norm(sq: Column) -> Column:
    return F.sqrt(F.greatest(sq, F.lit(NORM_EPS)))


def l2_normalize(a: Column | str) -> Column:
    n = safe_norm(sq_norm(a))
    return F.transform(_c(a), lambda e: e.cast("double") / n)
