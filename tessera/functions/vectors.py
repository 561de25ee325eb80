"""Column functions over dense vectors. All of them stay in the engine's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest denominator of the cosine, the machine epsilon of 32-bit floats (fixed value).
EPSILON = 1.1920928955078125e-07


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in doubles."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm_squared(a: Column) -> Column:
    return total(F.transform(doubles(a), lambda x: x * x))


def distance(metric: str, a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Distance of two vectors: ``L2sq``, ``IP`` (1 - dot) or ``Cos``; any other metric is infinitely far.

    The cosine of a vector of no length is 1. Squared norms can be given where they are stored.
    """
    if metric == "L2sq":
        return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))
    if metric == "IP":
        return F.lit(1.0) - dot(a, b)
    if metric == "Cos":
        size = F.sqrt((norm_squared(a) if norm_a is None else norm_a) * (norm_squared(b) if norm_b is None else norm_b))
        return F.when(size <= EPSILON, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot(a, b), size))
    return F.lit(float("inf"))


def l2_normalize(v: Column) -> Column:
    """Divided by the length; null components for a vector of zeros, whose direction is undefined."""
    size = F.sqrt(norm_squared(v))
    return F.transform(doubles(v), lambda x: F.try_divide(x, size))


def p_normalize(v: Column, p: int) -> Column:
    """The family of normalisations: -1 none, 0 by the largest absolute value over 32760, 2 Euclidean, other p the p-norm.

    Where the divisor isn't positive, all components are zero.
    """
    d = doubles(v)
    if p == -1:
        size = F.lit(1.0)
    elif p == 0:
        size = F.aggregate(d, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))) / F.lit(32760.0)
    elif p == 2:
        size = F.sqrt(norm_squared(v))
    else:
        size = F.pow(total(F.transform(d, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))
    return F.transform(d, lambda x: F.when(size > 0, F.try_divide(x, size)).otherwise(F.lit(0.0)))


def round_significant(x: Column, bits: int, least_exponent: int) -> Column:
    """x rounded half to even to so many significant bits; below 2**least_exponent the spacing stays."""
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(least_exponent))
    scale = F.pow(F.lit(2.0), F.lit(bits - 1) - exponent)
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.bround(x * scale) / scale)


def to_f16(v: Column) -> Column:
    """Rounded to half precision: 11 significant bits, gradual underflow, infinite from 65520 on."""
    big = lambda x: F.when(F.abs(x) >= 65520.0, F.signum(x) * float("inf")).otherwise(round_significant(x, 11, -14))
    return F.transform(doubles(v), big)


def to_bf16(v: Column) -> Column:
    """Rounded to 8 significant bits."""
    return F.transform(doubles(v), lambda x: round_significant(x, 8, -126))


def quantize(v: Column, kind: str) -> Column:
    """A vector as an index of the scalar kind holds it; I8 scales unit vectors to -127..127, B1 keeps signs."""
    if kind == "F64":
        return doubles(v)
    if kind == "F32":
        return doubles(v.cast("array<float>"))
    if kind == "F16":
        return to_f16(v)
    if kind == "BF16":
        return to_bf16(v)
    if kind == "I8":
        return F.transform(doubles(l2_normalize(v)), lambda x: F.bround(x * 127.0))
    if kind == "B1":
        return F.transform(doubles(v), lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    raise ValueError(f"unknown scalar kind {kind}")


def check_width(v: Column, width: int) -> Column:
    """The vector, or an error where its width isn't ``width``."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected a vector of width {width}, got "), F.size(v).cast("string"))).cast("array<float>"))


def min_or_infinity(d: Column) -> Column:
    """Smallest distance of a group; infinite for an empty one."""
    return F.coalesce(F.min(d), F.lit(float("inf")))
