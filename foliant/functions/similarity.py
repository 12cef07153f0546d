"""Sentence similarity signals as column expressions; sums are in double whatever the vectors hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Gaussian of sigma 1 cut at radius 4, from the centre outwards, and the least length that is smoothed.
KERNEL = (0.3989434693560978, 0.24197144565660072, 0.05399112742070441, 0.004431861620031266, 0.00013383062461474175)
SMOOTH_OVER = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(columns: list[Column]) -> Column:
    """The vector of these components divided by its length, zeros if it has none."""
    squares = [c * c for c in columns]
    while len(squares) > 1:
        squares = [x + y for x, y in zip(squares[::2], squares[1::2], strict=False)] + squares[len(squares) // 2 * 2 :]
    return F.array(*[F.coalesce(F.try_divide(c, F.sqrt(squares[0])), F.lit(0.0)) for c in columns])


def rescaled(cos: Column) -> Column:
    return (cos + 1) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as lower-case sets; 0 if either is empty."""
    low = lambda t: F.transform(t, F.lower)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(low(a), low(b))) / F.size(F.array_union(low(a), low(b))))


def hybrid(cos: Column, jac_norm: Column, weight: float | Column) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * cos + (1 - w) * jac_norm
