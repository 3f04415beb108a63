"""Column functions on ``ARRAY<FLOAT>`` vectors (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: added to the L2 norm before dividing (zero vectors score 0).
NORM_EPS = 1e-9


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """``v / (||v|| + 1e-9)`` as ARRAY<DOUBLE>."""
    n = l2_norm(v) + F.lit(NORM_EPS)
    return F.transform(_col(v), lambda x: x.cast("double") / n)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Inner product of the two normalised vectors."""
    return dot(l2_normalize(a), l2_normalize(b))


def checked_vector(v: Column | str, dim: int) -> Column:
    """The vector itself when it has ``dim`` entries; fails the task otherwise.
    (The check is part of the output value, so column pruning cannot drop it.)"""
    c = _col(v)
    return F.when(c.isNotNull() & (F.size(c) == dim), c).otherwise(
        F.raise_error(F.lit(f"vector dimension mismatch: expected {dim}")))
