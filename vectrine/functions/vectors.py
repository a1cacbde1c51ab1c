"""Vector expressions in the JVM, for small sides: re-ranking, centers, radii.

Pair-heavy work (nearest neighbours) is done in blocks, see operators.knn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the product of the norms held above 1e-12; null if a side is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.greatest(n, F.lit(1e-12)))


def angle(c: Column) -> Column:
    """Angle of a cosine, clipped to [-1, 1]; rounded so that it doesn't hang on the order of a sum."""
    return F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(c, 12)))), 9)


def theta(a: Column, b: Column) -> Column:
    """Angular distance of two vectors."""
    return angle(cosine(a, b))


def squared_l2(a: Column, b: Column) -> Column:
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, d), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), squared_l2(a, b)))


def normalize(a: Column, floor: float = 1e-12) -> Column:
    """The vector over its norm, which counts as ``floor`` at least; an all-zero vector stays as it is."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def normalize_strict(a: Column, least: float = 1e-12) -> Column:
    """The vector over its norm; a norm below ``least`` is an error."""
    n = norm(a)
    return F.when(n >= least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("a vector has hardly any length")).cast("array<double>"))


def quantize_byte(a: Column) -> Column:
    """[-1, 1] to 0..255: rint((x + 1) * 127.5), clipped."""
    return F.transform(a, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((x.cast("double") + 1) * 127.5).cast("int"))))


def fixed_point(a: Column, scale: float) -> Column:
    """rint(x * scale) as integers."""
    return F.transform(a, lambda x: F.rint(x.cast("double") * scale).cast("long"))


def mean_vector(v: Column, dim: int) -> Column:
    """Aggregate: the mean of vectors of ``dim`` elements, as ``dim`` partial averages and no exploded rows."""
    return F.array(*(F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)))
