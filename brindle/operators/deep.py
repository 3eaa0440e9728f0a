"""Networks over feature embeddings: neural factorization machines, and wide and deep models.

The logit of a row is its linear sum plus a dense net over an input made of its features'
vectors. Each step runs the net where the rows are: it returns the gradient of every row's
logit and input, and sums of its own gradients. Rows' gradients are joined to their features
and summed by feature, so weights, vectors and the net all learn from one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import factorization, nets
from brindle.session import written


@dataclass
class Input:
    """x: the input as aggregates over a row's features, with their factors s; back: the gradient of a feature's factor f,
    from the row's input gradient gx, its factor sums s, and the feature's v, val and field."""

    width: int
    x: Callable[[], list[Column]]
    back: Callable[[int], Column]


def nfm(k: int) -> Input:
    """Half of squared sums less sums of squares, by factor."""
    v, val = F.col("v"), F.col("val")
    x = lambda: [(F.pow(F.sum(v[f] * val), 2) - F.sum(F.pow(v[f] * val, 2))) / 2 for f in range(k)]
    return Input(k, x, lambda f: F.col("gx")[f] * val * (F.col("s")[f] - v[f] * val))


def wide_deep(k: int, fields: list[int]) -> Input:
    """The fields' vectors side by side; several features of a field are summed, a field without features gives zeros."""
    v, val = F.col("v"), F.col("val")
    x = lambda: [F.sum(F.when(F.col("field") == j, v[f] * val).otherwise(0.0)) for j in fields for f in range(k)]
    place = F.array_position(F.array(*[F.lit(j) for j in fields]), F.col("field")).cast("int") - 1
    return Input(k * len(fields), x, lambda f: F.when(place >= 0, F.get("gx", place * k + f) * val).otherwise(0.0))


def inputs(rows: DataFrame, params: DataFrame, k: int, shape: Input) -> DataFrame:
    """(row_id, label, wx, s, x) of every row."""
    j = rows.join(params.select("fid", "w", "v"), "fid")
    s = F.array(*[F.sum(F.col("v")[f] * F.col("val")) for f in range(k)])
    return j.groupBy("row_id", "label").agg(F.sum(F.col("w") * F.col("val")).alias("wx"), s.alias("s"), F.array(*shape.x()).alias("x"))


def _run(scored: DataFrame, net: list, batch: int = 1024) -> DataFrame:
    """Rows' (row_id, e, s, gx, loss), and with a block the sums of the net's gradients as blocks."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                x, wx, label = np.stack(part["x"].to_numpy()).astype(np.float64), part["wx"].to_numpy(), part["label"].to_numpy()
                held: list[np.ndarray] = []

                def loss(y: np.ndarray, t: np.ndarray, wx=wx, held=held) -> tuple[float, np.ndarray]:
                    z = y[:, 0] + wx
                    held.append(np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z))))
                    held.append(nets.sigmoid(z) - t)
                    return float(held[0].sum()), held[1][:, None]

                _, g, gx = nets.backward(net, x, label, loss)
                sums = g if sums is None else [a + b for a, b in zip(sums, g, strict=True)]
                yield pd.DataFrame({"row_id": part["row_id"], "e": held[1], "s": part["s"], "gx": list(gx), "loss": held[0], "block": -1, "g": b""})
        if sums is not None:
            blocks = nets.blocks(sums)
            none: list[list[float]] = [[]] * len(blocks)
            yield pd.DataFrame({"row_id": -1, "e": 0.0, "s": none, "gx": none, "loss": 0.0, "block": range(len(blocks)), "g": blocks})

    return scored.mapInPandas(work, "row_id bigint, e double, s array<double>, gx array<double>, loss double, block int, g binary")


def step(rows: DataFrame, params: DataFrame, k: int, shape: Input, net: list, l2: float = 1e-3) -> tuple[DataFrame, list[np.ndarray], float, int]:
    """(feature gradients (fid, gw, gv), the net's summed gradients, summed loss, rows) under the present parameters."""
    out = written(_run(inputs(rows, params, k, shape), net), "deep")
    by_row = out.filter("block < 0").select("row_id", "e", "s", "gx")
    x = rows.join(by_row, "row_id").join(params.select("fid", "w", "v"), "fid")
    gw = F.sum(F.col("e") * F.col("val") + F.lit(l2) * F.col("w"))
    gv = F.array(*[F.sum(shape.back(f) + F.lit(l2) * F.col("v")[f]) for f in range(k)])
    total = out.agg(F.sum("loss").alias("loss"), F.count_if(F.col("block") < 0).alias("n")).first()
    return x.groupBy("fid").agg(gw.alias("gw"), gv.alias("gv")), nets.summed(out.filter("block >= 0").select("block", "g"), net), total["loss"] or 0.0, total["n"]


def train(rows: DataFrame, k: int, shape: Input, net: list, epochs: int, lr: float = 0.1, l2: float = 1e-3) -> tuple[DataFrame, list, list[float]]:
    """(parameters (fid, w, v, ...), the net, mean loss before each epoch) after full passes of Adagrad over rows
    (row_id, label, field, fid, val). An empty table gives no parameters and no losses."""
    params, losses = written(factorization.initial(rows, k), "params"), []
    state = [np.zeros_like(p) for p in nets.params(net)]
    for _ in range(epochs):
        grads, g, loss, n = step(rows, params, k, shape, net, l2)
        if not n:
            break
        losses.append(loss / n)
        params = written(factorization.step(params, grads, k, lr, n), "params")
        nets.adagrad(net, state, [a / n for a in g], lr)
    return params, net, losses


def predict(rows: DataFrame, params: DataFrame, k: int, shape: Input, net: list) -> DataFrame:
    """(row_id, label, p)."""
    scored = inputs(rows, params, k, shape)
    y = nets.predict(scored, net).select("row_id", F.col("y")[0].alias("deep"))
    return scored.join(y, "row_id").select("row_id", "label", (1 / (1 + F.exp(-(F.col("wx") + F.col("deep"))))).alias("p"))
