"""Dot products, norms and similarities of array columns, real or complex (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def mac(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    """|<a, b>|^2 / (|a|^2 |b|^2); 0 when either is zero."""
    re, im = dot(ar, br) + dot(ai, bi), dot(ar, bi) - dot(ai, br)
    den = (norm2(ar) + norm2(ai)) * (norm2(br) + norm2(bi))
    return F.when(den > 0, (re * re + im * im) / den).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    den = F.sqrt(norm2(a)) * F.sqrt(norm2(b))
    return F.when(den > 0, dot(a, b) / den).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def gaussian(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * sigma * sigma))


def peak_normalised(re: Column, im: Column) -> tuple[Column, Column]:
    """A complex vector over its greatest magnitude."""
    top = F.array_max(F.zip_with(re, im, lambda x, y: F.sqrt(x.cast("double") * x + y.cast("double") * y)))
    return F.transform(re, lambda x: F.try_divide(x, top)), F.transform(im, lambda x: F.try_divide(x, top))


def scalar_fit(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """The complex c (re, im) of least |a - c b|: <b, a> / <b, b>, 0 for a zero b."""
    den = norm2(br) + norm2(bi)
    over = lambda x: F.when(den > 0, x / den).otherwise(0.0)
    return over(dot(br, ar) + dot(bi, ai)), over(dot(br, ai) - dot(bi, ar))
