"""Dense-vector scoring expressions over ARRAY<FLOAT|DOUBLE> columns.

Arithmetic is done in DOUBLE whatever the stored element type.  Zero
vectors give a NULL cosine (``try_divide``) rather than an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_squared(a, b) -> Column:
    diff2 = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(diff2, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b, a_norm=None, b_norm=None) -> Column:
    na = norm(a) if a_norm is None else _c(a_norm)
    nb = norm(b) if b_norm is None else _c(b_norm)
    return F.try_divide(dot(a, b), na * nb)


def similarity(a, b, metric: str = "cosine", squared: bool = True, a_norm=None, b_norm=None) -> Column:
    """Score where higher is better.

    cosine / cosine_distance: cosine similarity (the latter is reported by
    distance stores as 1 - distance, which is the same number);
    l2: 1 / (1 + squared L2 distance), or of the plain distance when
    ``squared`` is False; dot: inner product.
    """
    if metric not in config.METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {config.METRICS}")
    if metric in ("cosine", "cosine_distance"):
        return cosine(a, b, a_norm, b_norm)
    if metric == "l2":
        d2 = l2_squared(a, b)
        return F.lit(1.0) / (F.lit(1.0) + (d2 if squared else F.sqrt(d2)))
    return dot(a, b)
