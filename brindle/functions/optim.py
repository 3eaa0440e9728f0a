"""Optimizer steps as Column expressions: from weight, state and gradient to the new weight and state.

Every step takes the summed gradient g of a batch and the batch size, and leaves a weight
and its state alone where the mean gradient is 0 (or null: no gradient came).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.scalar import lit


def _mean(g: Column, batch: int) -> Column:
    return F.coalesce(g, lit(0)) / lit(batch)


def sgd(w: Column, g: Column, lr: float, batch: int = 1) -> dict[str, Column]:
    return {"w": w - lit(lr) * _mean(g, batch)}


def adagrad(w: Column, acc: Column, g: Column, lr: float, batch: int = 1) -> dict[str, Column]:
    m = _mean(g, batch)
    a = acc + m * m
    return {"w": F.when(m == 0, w).otherwise(w - lit(lr) * m / F.sqrt(a + lit(1e-7))), "acc": a}


def rmsprop(w: Column, acc: Column, g: Column, lr: float, batch: int = 1, rho: float = 0.99) -> dict[str, Column]:
    m = _mean(g, batch)
    a = F.when(m == 0, acc).otherwise(lit(rho) * acc + lit(1 - rho) * m * m)
    return {"w": F.when(m == 0, w).otherwise(w - lit(lr) * m / F.sqrt(a + lit(1e-7))), "acc": a}


def adadelta(w: Column, acc: Column, delta: Column, g: Column, batch: int = 1, rho: float = 0.8, eps: float = 1e-7) -> dict[str, Column]:
    m = _mean(g, batch)
    a = lit(rho) * acc + lit(1 - rho) * m * m
    step = m * F.sqrt((delta + lit(eps)) / (a + lit(eps)))
    return {
        "w": F.when(m == 0, w).otherwise(w - step),
        "acc": F.when(m == 0, acc).otherwise(a),
        "delta": F.when(m == 0, delta).otherwise(lit(rho) * delta + lit(1 - rho) * step * step),
    }


def adam(w: Column, m1: Column, m2: Column, g: Column, lr: float, step: int, batch: int = 1, b1: float = 0.8, b2: float = 0.999) -> dict[str, Column]:
    m = _mean(g, batch)
    first, second = lit(b1) * m1 + lit(1 - b1) * m, lit(b2) * m2 + lit(1 - b2) * m * m
    move = lit(lr) * (first / lit(1 - b1**step)) / (F.sqrt(second / lit(1 - b2**step)) + lit(1e-8))
    keep = m == 0
    return {"w": F.when(keep, w).otherwise(w - move), "m": F.when(keep, m1).otherwise(first), "v": F.when(keep, m2).otherwise(second)}


def ftrl(w: Column, n: Column, z: Column, g: Column, batch: int = 1, alpha: float = 0.15, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0) -> dict[str, Column]:
    """Follow the regularised leader, per coordinate."""
    m = _mean(g, batch)
    sigma = (F.sqrt(n + m * m) - F.sqrt(n)) / lit(alpha)
    nz, nn = z + m - sigma * w, n + m * m
    nw = F.when(F.abs(nz) <= lit(l1), lit(0)).otherwise(-(nz - F.signum(nz) * lit(l1)) / ((lit(beta) + F.sqrt(nn)) / lit(alpha) + lit(l2)))
    return {"w": nw, "n": nn, "z": nz}


def dcasgd(w: Column, shadow: Column, g: Column, lr: float, batch: int = 1, lam: float = 0.1) -> dict[str, Column]:
    """Delay-compensated gradient: the worker saw shadow, the server holds w."""
    m = _mean(g, batch)
    nw = w - lit(lr) * (m + lit(lam) * m * m * (w - shadow))
    return {"w": nw, "shadow": nw}


def dcasgd_adaptive(w: Column, shadow: Column, acc: Column, g: Column, lr: float, batch: int = 1, lam: float = 0.1) -> dict[str, Column]:
    m = _mean(g, batch)
    a = lit(0.95) * acc + lit(0.05) * m * m
    nw = w - lit(lr) * (m + lit(lam) / F.sqrt(a + lit(1e-7)) * m * m * (w - shadow))
    return {"w": nw, "shadow": nw, "acc": a}


def decay(w: Column, l2: float, l1: float) -> Column:
    """Gradient of both penalties."""
    return lit(l2) * w + lit(l1) * F.signum(w)
