"""Word embeddings: Huffman codes of a vocabulary and the continuous bag-of-words trainer; hyperplane forests; Hebbian components."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import default_parallelism


def huffman(freq: list[int]) -> tuple[list[str], list[list[int]]]:
    """Code and path of inner nodes from the root of each word; a vocabulary has a fixed size. One word gets the code 0."""
    n = len(freq)
    if n == 1:
        return ["0"], [[0]]
    heap = [(f, i) for i, f in enumerate(freq)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, str]] = {}
    node = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]], up[b[1]] = (node, "0"), (node, "1")
        heapq.heappush(heap, (a[0] + b[0], node))
        node += 1
    codes, paths = [], []
    for i in range(n):
        code, path, at = "", [], i
        while at in up:
            at, bit = up[at]
            code, path = bit + code, [at - n, *path]
        codes.append(code)
        paths.append(path)
    return codes, paths


#: Parameters in a block of those that tasks send; copies are averaged on the executors by block.
PARAMETERS = 65_536
#: Places of a document that are learnt from together.
PLACES = 16


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cbow_train(docs: DataFrame, freq: list[int], dim: int = 16, epochs: int = 3, window: int = 6, negatives: int = 12, lr: float = 0.05) -> tuple[np.ndarray, list[float]]:
    """Unit vectors of the words of (doc_id, wids ARRAY<INT>), and the mean loss of each epoch.

    Hierarchical softmax along the Huffman path and negative samples by frequency^0.75. Each
    task trains its own copy over its documents; copies are averaged by their words after
    every epoch. Documents of at most 2 * window + 1 words are left out.
    """
    v = len(freq)
    codes, paths = huffman(freq)
    rng = np.random.default_rng(7)
    emb, inner, out = rng.uniform(-0.5, 0.5, (v, dim)) / dim, np.zeros((max(1, v - 1), dim)), np.zeros((v, dim))
    cum = np.cumsum(np.asarray(freq, float) ** 0.75)
    deep = max(1, max((len(p) for p in paths), default=1))
    path, bits, on = np.zeros((v, deep), np.int64), np.zeros((v, deep)), np.zeros((v, deep))
    for i, (p, code) in enumerate(zip(paths, codes, strict=True)):
        path[i, : len(p)], bits[i, : len(p)], on[i, : len(p)] = p, [1.0 - int(c) for c in code[: len(p)]], 1.0
    spread = docs.select("doc_id", "wids").repartition(default_parallelism(docs.sparkSession))  # texts of few bytes would be coalesced into one task
    around = np.array([o for o in range(-window, window) if o])
    losses: list[float] = []
    for epoch in range(epochs):
        rate, start = max(1e-4, lr * 0.96**epoch), (emb, inner, out)

        def work(frames: Iterator[pd.DataFrame], start=start, rate=rate, epoch=epoch) -> Iterator[pd.DataFrame]:
            e, hs, ns = (a.copy() for a in start)
            total, n = 0.0, 0
            for f in frames:
                for doc, ids in zip(f["doc_id"], f["wids"], strict=True):
                    if ids is None or len(ids) <= 2 * window + 1:
                        continue
                    ids = np.asarray(ids)
                    r = np.random.default_rng(int(doc) * 1000 + epoch)
                    for at in range(0, len(ids), PLACES):
                        w = ids[at : at + PLACES]
                        near = np.arange(at, at + len(w))[:, None] + around
                        there = ((near >= 0) & (near < len(ids))).astype(float)
                        ctx = ids[np.clip(near, 0, len(ids) - 1)]
                        x, back = (e[ctx] * there[:, :, None]).sum(axis=1), np.zeros((len(w), dim))
                        drawn = np.searchsorted(cum, r.random((len(w), negatives)) * cum[-1])
                        hit = np.zeros((len(w), negatives + 1))
                        hit[:, 0] = 1.0
                        for rows, table, label, mask in ((path[w], hs, bits[w], on[w]), (np.concatenate([w[:, None], drawn], axis=1), ns, hit, np.ones(hit.shape))):
                            u = table[rows]
                            p = _sig((u * x[:, None]).sum(axis=2))
                            g = rate * (label - p) * mask
                            back += (g[:, :, None] * u).sum(axis=1)
                            np.add.at(table, rows, g[:, :, None] * x[:, None])
                            total -= float((mask * np.log(np.maximum(np.where(label > 0.5, p, 1 - p), 1e-12))).sum())
                        np.add.at(e, ctx, back[:, None] * there[:, :, None])
                        n += len(w)
            if n:
                flat = np.concatenate([a.ravel() for a in (e, hs, ns)]) * n
                cut = [flat[i : i + PARAMETERS].tobytes() for i in range(0, len(flat), PARAMETERS)]
                yield pd.DataFrame({"block": [-1, *range(len(cut))], "n": [n] + [0] * len(cut), "loss": [total] + [0.0] * len(cut), "p": [b"", *cut]})

        def weighed(f: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p) for p in f["p"])
            return pd.DataFrame({"block": f["block"].iloc[:1], "n": [f["n"].sum()], "loss": [f["loss"].sum()], "p": [np.asarray(total).tobytes()]})

        copies = spread.mapInPandas(work, "block int, n bigint, loss double, p binary")
        got = sorted(copies.groupBy("block").applyInPandas(weighed, "block int, n bigint, loss double, p binary").collect(), key=lambda r: r["block"])
        if not got:
            break
        n = got[0]["n"]
        losses.append(got[0]["loss"] / n)
        flat = np.concatenate([np.frombuffer(r["p"]) for r in got[1:]]) / n
        a, b = emb.size, emb.size + inner.size
        emb, inner, out = flat[:a].reshape(emb.shape), flat[a:b].reshape(inner.shape), flat[b:].reshape(out.shape)
    return emb / np.maximum(np.sqrt((emb * emb).sum(axis=1, keepdims=True)), 1e-12), losses


def build_forest(ids: np.ndarray, x: np.ndarray, trees: int, leaf: int = 10) -> list[list[dict]]:
    """Forest of hyperplanes between two means of each node's points, over a bounded sample given by the caller."""
    forest = []
    for t in range(trees):
        rng, nodes, todo = np.random.default_rng(100 + t), [], [(np.arange(len(ids)), -1, False)]
        while todo:
            at, father, right = todo.pop()
            n = len(nodes)
            if father >= 0:
                nodes[father]["right" if right else "left"] = n
            nodes.append({"points": ids[at], "left": -1, "right": -1, "h": None, "b": 0.0})
            if len(at) <= leaf:
                continue
            c = x[rng.choice(at, 2, replace=False)].copy()
            for s, p in enumerate(rng.choice(at, min(200, 4 * len(at)))):
                k = int(((c - x[p]) ** 2).sum(axis=1).argmin())
                c[k] += (x[p] - c[k]) / (s + 2)
            h = (c[0] - c[1]) / max(float(np.linalg.norm(c[0] - c[1])), 1e-12)
            b = float(-h @ (c[0] + c[1]) / 2)
            left = x[at] @ h + b > 0
            if left.all() or not left.any():
                continue
            nodes[n].update(h=h, b=b, points=ids[:0])
            todo += [(at[left], n, False), (at[~left], n, True)]
        forest.append(nodes)
    return forest


def query_forest(forest: list[list[dict]], q: np.ndarray, want: int) -> np.ndarray:
    """Candidate ids for one vector: nodes of all trees, nearest to their planes first, until enough are found."""
    heap = [(-np.inf, t, 0) for t in range(len(forest))]
    found: set[int] = set()
    while heap and len(found) < want:
        far, t, n = heapq.heappop(heap)
        node = forest[t][n]
        if node["h"] is None:
            found.update(node["points"].tolist())
            continue
        m = float(q @ node["h"] + node["b"])
        heapq.heappush(heap, (max(far, -m), t, node["left"]))
        heapq.heappush(heap, (max(far, m), t, node["right"]))
    return np.fromiter(found, np.int64)


def hebbian(cov: np.ndarray, k: int, steps: int = 4000, lr: float = 0.5) -> np.ndarray:
    """Leading components by the generalised Hebbian rule on a covariance, (k, dim), signs fixed by the largest entry."""
    w = np.random.default_rng(3).normal(0, 0.1, (k, len(cov)))
    rate = lr / max(1e-12, float(np.trace(cov)))
    for _ in range(steps):
        y = w @ cov
        w += rate * (y - np.tril(y @ w.T) @ w)
    big = np.abs(w).argmax(axis=1)
    return w * np.sign(w[np.arange(k), big])[:, None]


def word_lists(known: DataFrame) -> DataFrame:
    """(doc_id, wids) of (doc_id, pos, wid), in the order of the text."""
    return known.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "wid"))), lambda t: t["wid"]).alias("wids"))
