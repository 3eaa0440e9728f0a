"""Activations, losses, normal statistics and codecs as Column expressions. Nulls give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant of the closed-form erf approximation (fixed value).
ERF_A = 0.140012


def lit(x: float) -> Column:
    return F.lit(float(x))


def sigmoid(x: Column) -> Column:
    """Logistic function, 1e-7 below -16 and 1 - 1e-7 above 16."""
    return F.when(x < -16, lit(1e-7)).when(x > 16, lit(1 - 1e-7)).otherwise(lit(1) / (lit(1) + F.exp(-x)))


def relu(x: Column) -> Column:
    return F.greatest(x, lit(0))


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(F.least(x, lit(30)))))


def binary_sigmoid(x: Column) -> Column:
    return F.greatest(lit(0), F.least(lit(1), (x + 1) / 2))


def d_sigmoid(y: Column) -> Column:
    return y * (lit(1) - y)


def d_tanh(y: Column) -> Column:
    return lit(1) - y * y


def d_relu(y: Column) -> Column:
    return F.when(y > 0, lit(1)).otherwise(F.when(y.isNotNull(), lit(0)))


def d_softplus(y: Column) -> Column:
    """From the forward value y = ln(1 + e^x): 1 - e^-y."""
    return lit(1) - F.exp(-y)


def square_loss(p: Column, label: Column) -> Column:
    return (p - label) * (p - label) / 2


def logistic_nll(logit: Column, label: Column) -> Column:
    """Negative log-likelihood of a 0/1 label under a logit, in the overflow-free form."""
    return F.greatest(logit, lit(0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, lit(1e-7)), lit(1 - 1e-7))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(lit(1) - q))


def erf(x: Column) -> Column:
    s = x * x
    return F.signum(x) * F.sqrt(lit(1) - F.exp(-s * (lit(4 / math.pi) + lit(ERF_A) * s) / (lit(1) + lit(ERF_A) * s)))


def normal_cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return (lit(1) + erf((x - lit(mu)) / lit(sigma * math.sqrt(2)))) / 2


def log_cdf(x: Column) -> Column:
    return F.log(normal_cdf(x))


def significance(x: Column) -> Column:
    """Two-sided mass within x standard deviations."""
    return lit(2) * normal_cdf(x) - 1


def inverse_cdf(p: Column, steps: int = 40) -> Column:
    """Standard normal quantile within [-5, 5] by bisection."""
    start = F.struct(lit(-5).alias("lo"), lit(5).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = normal_cdf(mid) < p
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.when(p.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))


def soft_threshold(g: Column, k: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - lit(k), lit(0))


def clip(g: Column, limit: float = 15.0) -> Column:
    return F.greatest(F.least(g, lit(limit)), lit(-limit))


def uniform_code(x: Column, low: float, high: float, bits: int) -> Column:
    """Bucket of x among 2^bits equal ones over [low, high], clamped."""
    n = 1 << bits
    return F.least(F.greatest(F.floor((x - lit(low)) / lit((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def uniform_value(code: Column, low: float, high: float, bits: int) -> Column:
    """Middle of a bucket."""
    return lit(low) + (code.cast("double") + lit(0.5)) * lit((high - low) / (1 << bits))


def log_code(x: Column, low: float, high: float, bits: int) -> Column:
    """Bucket of |x| by its logarithm, sign kept as the sign of the code plus one; 0 where x is 0."""
    n = 1 << (bits - 1)
    span = (math.log(high) - math.log(low)) / (n - 1)
    k = F.least(F.greatest(F.floor((F.log(F.abs(x)) - lit(math.log(low))) / lit(span)), F.lit(0)), F.lit(n - 2)) + 1
    return F.when(x == 0, 0).otherwise((F.signum(x) * k).cast("int"))


def normal_code(x: Column, mu: float, sigma: float, bits: int) -> Column:
    """Bucket of x among 2^bits equally likely ones under a normal law."""
    n = 1 << bits
    return F.least(F.floor(normal_cdf(x, mu, sigma) * n), F.lit(n - 1)).cast("int")


def log_value(code: Column, low: float, high: float, bits: int) -> Column:
    """Middle of a logarithmic bucket, with its sign; 0 for code 0."""
    span = (math.log(high) - math.log(low)) / ((1 << (bits - 1)) - 1)
    size = F.exp(lit(math.log(low)) + (F.abs(code).cast("double") - lit(0.5)) * lit(span))
    return F.when(code == 0, lit(0)).otherwise(F.signum(code.cast("double")) * size)


def normal_value(code: Column, mu: float, sigma: float, bits: int) -> Column:
    """Quantile at the middle of an equally likely bucket."""
    return lit(mu) + lit(sigma) * inverse_cdf((code.cast("double") + lit(0.5)) / lit(1 << bits))


def lowbit(x: Column, bits: int) -> Column:
    """1 bit: the sign, as a third; 2 bits: the sign with a quarter or three quarters."""
    if bits == 1:
        return F.when(x >= 0, lit(1 / 3)).otherwise(lit(-1 / 3))
    return F.signum(x) * F.when(F.abs(x) < 0.5, lit(0.25)).otherwise(lit(0.75))


def varuint_length(x: Column) -> Column:
    """Bytes of an unsigned integer in base 128, seven bits a byte."""
    out = None
    for k in range(8, 0, -1):
        cond = x >= F.lit(1 << (7 * k))
        out = F.when(cond, k + 1) if out is None else out.when(cond, k + 1)
    return out.otherwise(1).cast("int")


def varuint_encode(x: Column) -> Column:
    """An unsigned integer in base 128 as hexadecimal bytes, lowest seven bits first, the high bit set on all but the last."""
    n = varuint_length(x)
    group = lambda i: F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127))
    bytes_ = [F.when(F.lit(i) < n, F.lpad(F.hex(group(i) + F.when(F.lit(i) < n - 1, 128).otherwise(0)), 2, "0")).otherwise("") for i in range(9)]
    return F.concat(*bytes_)


def varuint_decode(text: Column) -> Column:
    """The inverse of varuint_encode."""
    n = (F.length(text) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(127))
    return sum((F.when(F.lit(i) < n, F.shiftleft(byte(i), 7 * i)).otherwise(F.lit(0).cast("bigint")) for i in range(9)), F.lit(0).cast("bigint"))


def draw_normal(x: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers of an integer id, by radius and angle."""
    u, v = (hash_mix(x * 2) * lit(2147483646 / 2147483647) + lit(1 / 4294967294)), hash_mix(x * 2 + 1)
    radius = F.sqrt(lit(-2) * F.log(u))
    return radius * F.cos(lit(2 * math.pi) * v), radius * F.sin(lit(2 * math.pi) * v)


def hash_unit(x: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) of an integer id, for initial parameters."""
    return (x * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648) / lit(2147483648)


def hash_mix(x: Column) -> Column:
    """A well-mixed pseudo-random number in [0, 1) of an integer id, for sampling."""
    y = (x * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)
    return (y * y + F.lit(7) * y) % F.lit(2147483647) / lit(2147483647)
