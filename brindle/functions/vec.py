"""Array algebra as Column expressions; vectors are ARRAY<DOUBLE>. A null vector or element gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    """Sum from the first element to the last, so that every engine adds in the same order."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def sub(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def hadamard(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def scale(x: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(x, lambda v: v * k)


def fma(x: Column, y: Column, k: float) -> Column:
    """x + k y"""
    return F.zip_with(x, y, lambda a, b: a + b * F.lit(float(k)))


def dot(x: Column, y: Column) -> Column:
    return total(hadamard(x, y))


def l2_norm_sq(x: Column) -> Column:
    """The square of the Euclidean norm."""
    return total(F.transform(x, lambda v: v * v))


def l1_sum(x: Column) -> Column:
    """The plain sum, without absolute values."""
    return total(x)


def l2_distance_sq(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def sqrt_abs(x: Column) -> Column:
    return F.transform(x, lambda v: F.sqrt(F.abs(v)))


def reciprocal(x: Column) -> Column:
    """Elementwise 1 / v; null where v is 0."""
    return F.transform(x, lambda v: F.try_divide(F.lit(1.0), v))


def divide(x: Column, y: Column) -> Column:
    """Elementwise quotient; null where the divisor is 0."""
    return F.zip_with(x, y, lambda a, b: F.try_divide(a, b))


def transpose(x: Column, rows: int, cols: int) -> Column:
    """A row-major rows x cols matrix, transposed."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.get(x, (i % rows) * cols + F.floor(i / rows).cast("int")))


def rot180(x: Column) -> Column:
    return F.reverse(x)


def argmax(x: Column) -> Column:
    """Zero-based position of the first largest element."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def logsumexp(x: Column) -> Column:
    m = F.array_max(x)
    return m + F.log(total(F.transform(x, lambda v: F.exp(v - m))))


def softmax(x: Column, temperature: float = 1.0, floor: float = 1e-7) -> Column:
    """Max-subtracted softmax, clamped to [floor, 1 - floor]."""
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - m) / F.lit(temperature)))
    s = total(e)
    return F.transform(e, lambda v: F.least(F.greatest(v / s, F.lit(floor)), F.lit(1 - floor)))


def rounded(x: Column, digits: int = 4) -> Column:
    return F.transform(x, lambda v: F.round(v, digits))


def matmul(x: Column, y: Column, rows: int, inner: int, cols: int) -> Column:
    """Product of two matrices that lie row by row."""
    cell = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(inner - 1)), F.lit(0.0), lambda s, k: s + F.get(x, (F.floor(c / cols) * inner).cast("int") + k) * F.get(y, (k * cols + c % cols).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), cell)
