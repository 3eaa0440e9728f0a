"""Dense networks in NumPy, trained data-parallel: tasks return summed gradients, the driver updates the weights.

A network is a list of layers; each layer turns a batch into a batch and, on the way back,
an output gradient into an input gradient and parameter gradients. Weights are small beside
the data and travel with each pass's functions; tasks' gradients are summed on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import written

CLIP = 15.0


def _init(shape: tuple[int, ...], seed: int) -> np.ndarray:
    fan = int(np.prod(shape[:-1])) or 1
    return np.random.default_rng(seed).normal(0, 1 / np.sqrt(fan), shape)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Dense:
    """Fully connected layer with an activation: linear, sigmoid, tanh or relu."""

    def __init__(self, n: int, m: int, act: str = "linear", seed: int = 1):
        self.p, self.act = [_init((n, m), seed), np.zeros(m)], act

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        z = x @ self.p[0] + self.p[1]
        self.y = {"linear": lambda: z, "sigmoid": lambda: sigmoid(z), "tanh": lambda: np.tanh(z), "relu": lambda: np.maximum(z, 0)}[self.act]()
        return self.y

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        y = self.y
        g = g * {"linear": lambda: 1.0, "sigmoid": lambda: y * (1 - y), "tanh": lambda: 1 - y * y, "relu": lambda: y > 0}[self.act]()
        return g @ self.p[0].T, [self.x.T @ g, g.sum(axis=0)]


class Conv:
    """Valid convolution of (n, channels, h, w) with stride, relu after; links may leave channels out of a filter."""

    def __init__(self, inside: int, outside: int, size: int, stride: int = 1, links: np.ndarray | None = None, seed: int = 2):
        self.p, self.size, self.stride = [_init((inside, size, size, outside), seed).transpose(3, 0, 1, 2).copy(), np.zeros(outside)], size, stride
        self.links = np.ones((outside, inside), bool) if links is None else links

    def _windows(self, x: np.ndarray) -> np.ndarray:
        w = np.lib.stride_tricks.sliding_window_view(x, (self.size, self.size), axis=(2, 3))
        return w[:, :, :: self.stride, :: self.stride]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        f = self.p[0] * self.links[:, :, None, None]
        self.y = np.maximum(np.einsum("nchwij,ocij->nohw", self._windows(x), f, optimize=True) + self.p[1][None, :, None, None], 0)
        return self.y

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        g = g * (self.y > 0)
        f = self.p[0] * self.links[:, :, None, None]
        gf = np.einsum("nohw,nchwij->ocij", g, self._windows(self.x), optimize=True) * self.links[:, :, None, None]
        gx = np.zeros_like(self.x, dtype=np.float64)
        h, w, s = g.shape[2], g.shape[3], self.stride
        for i in range(self.size):
            for j in range(self.size):
                gx[:, :, i : i + s * h : s, j : j + s * w : s] += np.einsum("nohw,oc->nchw", g, f[:, :, i, j], optimize=True)
        return gx, [gf, g.sum(axis=(0, 2, 3))]


class Dropout:
    """Leaves out a share of the values while learning, by a mask fixed by seed and place, and scales the others up."""

    def __init__(self, rate: float):
        self.rate, self.training, self.seed, self.p = rate, False, 0, []

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.mask = np.ones(x.shape) if not self.training else (np.random.default_rng(self.seed).random(x.shape) >= self.rate) / (1 - self.rate)
        return x * self.mask

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return g * self.mask, []


class MaxPool:
    def __init__(self, k: int):
        self.k, self.p = k, []

    def forward(self, x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        k = self.k
        self.shape, h, w = x.shape, h // k, w // k
        t = x[:, :, : h * k, : w * k].reshape(n, c, h, k, w, k)
        y = t.max(axis=(3, 5))
        first = (t == y[:, :, :, None, :, None]).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h, w, k * k)
        self.mask = np.eye(k * k, dtype=bool)[first.argmax(axis=-1)].reshape(n, c, h, w, k, k).transpose(0, 1, 2, 4, 3, 5)
        return y

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n, c, h, w = g.shape
        gx = np.zeros(self.shape)
        gx[:, :, : h * self.k, : w * self.k] = (self.mask * g[:, :, :, None, :, None]).reshape(n, c, h * self.k, w * self.k)
        return gx, []


class Flatten:
    p: list[np.ndarray] = []

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return g.reshape(self.shape), []


class Reshape:
    def __init__(self, *shape: int):
        self.shape, self.p = shape, []

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.before = x.shape
        return x.reshape(len(x), *self.shape)

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return g.reshape(self.before), []


class LSTM:
    """(n, steps, d) to the hidden states (n, steps, h); back-propagation through time."""

    def __init__(self, d: int, h: int, seed: int = 3):
        self.h, self.p = h, [_init((d, 4 * h), seed), _init((h, 4 * h), seed + 1), np.zeros(4 * h)]
        self.p[2][:h] = 1.0

    def forward(self, x: np.ndarray) -> np.ndarray:
        n, t, _ = x.shape
        h, c = np.zeros((n, self.h)), np.zeros((n, self.h))
        self.x, self.tape, out = x, [], []
        for s in range(t):
            z = x[:, s] @ self.p[0] + h @ self.p[1] + self.p[2]
            f, i, o = (sigmoid(z[:, k * self.h : (k + 1) * self.h]) for k in range(3))
            u = np.tanh(z[:, 3 * self.h :])
            c2 = f * c + i * u
            self.tape.append((h, c, f, i, o, u, c2))
            h, c = o * np.tanh(c2), c2
            out.append(h)
        return np.stack(out, axis=1)

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        gx, gp = np.zeros_like(self.x, dtype=np.float64), [np.zeros_like(p) for p in self.p]
        gh, gc = np.zeros((len(g), self.h)), np.zeros((len(g), self.h))
        for s in reversed(range(g.shape[1])):
            h, c, f, i, o, u, c2 = self.tape[s]
            gh = gh + g[:, s]
            t = np.tanh(c2)
            gc = gc + gh * o * (1 - t * t)
            z = np.concatenate([gc * c * f * (1 - f), gc * u * i * (1 - i), gh * t * o * (1 - o), gc * i * (1 - u * u)], axis=1)
            gp[0] += self.x[:, s].T @ z
            gp[1] += h.T @ z
            gp[2] += z.sum(axis=0)
            gx[:, s], gh, gc = z @ self.p[0].T, z @ self.p[1].T, gc * f
        return gx, gp


class Attention:
    """Additive attention over steps: a score of each state, softmax over the steps, weighted sum."""

    def __init__(self, h: int, inner: int, seed: int = 5):
        self.p = [_init((h, inner), seed), np.zeros(inner), _init((inner, 1), seed + 1)]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        self.e = sigmoid(x @ self.p[0] + self.p[1])
        s = (self.e @ self.p[2])[..., 0]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        self.a = s / s.sum(axis=1, keepdims=True)
        return (self.a[:, :, None] * x).sum(axis=1)

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        ga = (self.x * g[:, None]).sum(axis=2)
        gs = self.a * (ga - (ga * self.a).sum(axis=1, keepdims=True))
        ge = gs[:, :, None] * self.p[2][:, 0]
        gz = ge * self.e * (1 - self.e)
        gx = self.a[:, :, None] * g[:, None] + gz @ self.p[0].T
        return gx, [np.einsum("ntd,nte->de", self.x, gz), gz.sum(axis=(0, 1)), np.einsum("nte,nt->e", self.e, gs)[:, None]]


class Sample:
    """Mean and log variance to a sample with noise fixed by the row, and the pull towards the standard normal."""

    p: list[np.ndarray] = []

    def forward(self, x: np.ndarray) -> np.ndarray:
        k = x.shape[1] // 2
        self.mu, self.lv = x[:, :k], np.clip(x[:, k:], -10, 10)
        rows = np.floor(np.abs(x.sum(axis=1)) * 1e6).astype(np.int64) % (1 << 31)
        u = ((rows[:, None] * 1103515245 + 12345 + np.arange(2 * k) * 7919) % (1 << 31) + 1) / ((1 << 31) + 1)
        self.eps = np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])
        self.kl = 0.5 * (np.exp(self.lv) - 1 - self.lv + self.mu**2).sum()
        return self.mu + np.exp(self.lv / 2) * self.eps

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.concatenate([g + self.mu, g * self.eps * np.exp(self.lv / 2) / 2 + (np.exp(self.lv) - 1) / 2], axis=1), []


def softmax_loss(y: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    e = np.exp(y - y.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), label] -= 1
    return float(-np.log(np.maximum(p[np.arange(len(y)), label], 1e-12)).sum()), g


def logistic_loss(y: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    z = y[:, 0]
    return float((np.maximum(z, 0) - z * label + np.log1p(np.exp(-np.abs(z)))).sum()), (sigmoid(z) - label)[:, None]


def rebuild_loss(y: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    return float(((y - x) ** 2).sum() / 2), y - x


def backward(net: list, x: np.ndarray, target: np.ndarray, loss) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Summed loss of a batch, parameter gradients, and the gradient of its input."""
    y = x
    for layer in net:
        y = layer.forward(y)
    value, g = loss(y, target)
    value += sum(layer.kl for layer in net if isinstance(layer, Sample))
    grads: list[list[np.ndarray]] = []
    for layer in reversed(net):
        g, gp = layer.backward(g)
        grads.append(gp)
    return value, [p for gp in reversed(grads) for p in gp], g


def gradients(net: list, x: np.ndarray, target: np.ndarray, loss) -> tuple[float, list[np.ndarray]]:
    """Summed loss and parameter gradients of a batch."""
    return backward(net, x, target, loss)[:2]


def params(net: list) -> list[np.ndarray]:
    return [p for layer in net for p in layer.p]


#: Numbers in a block of gradients, which is what tasks send and sums are taken over.
BLOCK = 65_536


def blocks(grads: list[np.ndarray]) -> list[bytes]:
    flat = np.concatenate([g.ravel() for g in grads])
    return [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]


def summed(parts: DataFrame, net: list) -> list[np.ndarray]:
    """Sums of tasks' gradients (block, g), taken on the executors by block; one copy reaches the driver."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(f["g"].iloc[0]).copy()
        for g in f["g"].iloc[1:]:
            total += np.frombuffer(g)
        return pd.DataFrame({"block": f["block"].iloc[:1], "g": [total.tobytes()]})

    got = parts.groupBy("block").applyInPandas(work, "block int, g binary").collect()
    if not got:
        return [np.zeros_like(p) for p in params(net)]
    flat = np.concatenate([np.frombuffer(r["g"]) for r in sorted(got, key=lambda r: r["block"])])
    out, at = [], 0
    for p in params(net):
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def adagrad(net: list, state: list[np.ndarray], grads: list[np.ndarray], lr: float) -> None:
    """Mean gradients, clipped, into the net's weights."""
    for p, acc, g in zip(params(net), state, grads, strict=True):
        g = np.clip(g, -CLIP, CLIP)
        acc += g * g
        p -= lr * g / np.sqrt(acc + 1e-7)


def _mode(net: list, training: bool, seed: int = 0) -> None:
    for i, layer in enumerate(net):
        if isinstance(layer, Dropout):
            layer.training, layer.seed = training, seed * 1000 + i


def _pass(rows: DataFrame, net: list, loss, target: str, batch: int, learn: bool) -> tuple[float, int, list[np.ndarray]]:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, sums = 0.0, 0, None
        for f in frames:
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                value, g = gradients(net, x, x if target == "x" else part[target].to_numpy(), loss)
                total, n, sums = total + value, n + len(part), g if sums is None else [a + b for a, b in zip(sums, g, strict=True)]
        if n:
            out = blocks(sums) if learn else []
            yield pd.DataFrame({"block": [-1, *range(len(out))], "loss": [total] + [0.0] * len(out), "n": [n] + [0] * len(out), "g": [b"", *out]})

    out = written(rows.select("row_id", "label", "x").mapInPandas(work, "block int, loss double, n bigint, g binary"), "gradients")
    one = out.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    n = one["n"] or 0
    return one["loss"] or 0.0, n, summed(out.filter("block >= 0").select("block", "g"), net) if learn and n else []


def train(rows: DataFrame, net: list, loss, steps: int, lr: float = 0.1, target: str = "label", batch: int = 256, parts: int = 1, held_out: float = 0.0) -> list[float]:
    """Adagrad over (row_id, label, x), steps epochs; returns a mean loss an epoch. target: label, or x to rebuild the input.

    An epoch is a full pass, or parts mini-batches into which a hash of row_id and epoch
    shuffles the rows, with an update after each. The loss is that of the epoch's rows before
    their updates; with held_out, the share of rows (by hash) that is never learnt from, it is
    the loss of those after the epoch. Dropout layers drop only while learning. The net keeps
    its weights and may be given to ``predict``. No rows, no losses.
    """
    state, losses = [np.zeros_like(p) for p in params(net)], []
    place = lambda epoch: F.pmod(F.xxhash64("row_id", F.lit(epoch)), F.lit(1_000_000))
    learnt = rows.filter(place(-1) >= int(held_out * 1_000_000)) if held_out else rows
    for epoch in range(steps):
        total = count = 0
        for part in range(parts):
            _mode(net, True, epoch * parts + part)
            here = learnt.filter(place(epoch) % parts == part) if parts > 1 else learnt
            value, n, grads = _pass(here, net, loss, target, batch, True)
            if n:
                adagrad(net, state, [g / n for g in grads], lr)
            total, count = total + value, count + n
        _mode(net, False)
        if held_out:
            total, count, _ = _pass(rows.filter(place(-1) < int(held_out * 1_000_000)), net, loss, target, batch, False)
        if not count:
            return losses
        losses.append(total / count)
    return losses


def predict(rows: DataFrame, net: list, batch: int = 1024) -> DataFrame:
    """(row_id, y ARRAY<DOUBLE>): the net's output for (row_id, x). The first layers alone give an encoding."""
    _mode(net, False)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                y = np.stack(part["x"].to_numpy()).astype(np.float64)
                for layer in net:
                    y = layer.forward(y)
                yield pd.DataFrame({"row_id": part["row_id"], "y": list(y.reshape(len(part), -1))})

    return rows.select("row_id", "x").mapInPandas(work, "row_id bigint, y array<double>")


#: Which of 6 maps feed which of 16 filters (fixed values): a row an input map, a column a filter.
LINKS = (
    "1000111001111011",
    "1100011100111101",
    "1110001110010111",
    "0111001111001011",
    "0011100111101101",
    "0001110011110111",
)


def cnn(side: int, classes: int, hidden: int = 32, size: int = 2) -> list:
    """Three convolutions of 6, 16 and 20 filters, the second over the link table, pooling after the first, two dense layers.
    Images of 28 take size 5 with stride 2 and then 3; smaller ones smaller filters."""
    links = np.array([[c == "1" for c in row] for row in LINKS]).T
    first, stride, rest = (5, 2, 3) if side >= 28 else (size, 1, size)
    a = ((side - first) // stride + 1) // 2
    b = a - 2 * (rest - 1)
    return [Reshape(1, side, side), Conv(1, 6, first, stride), MaxPool(2), Conv(6, 16, rest, links=links), Conv(16, 20, rest, seed=4), Flatten(), Dense(20 * b * b, hidden, "sigmoid"), Dense(hidden, classes)]


def rnn(steps: int, width: int, hidden: int, classes: int) -> list:
    return [Reshape(steps, width), LSTM(width, hidden), Attention(hidden, hidden), Dense(hidden, 24, "sigmoid"), Dense(24, classes)]


def vae(width: int, hidden: int, latent: int) -> list:
    return [Dense(width, hidden, "tanh"), Dense(hidden, 2 * latent), Sample(), Dense(latent, hidden, "tanh"), Dense(hidden, width)]
