"""A forest of hyperplanes over dense vectors: fitted on a bounded sample, then every vector is put into a leaf of each tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.functions import vec as V
from brindle.operators.embedding import build_forest

#: Vectors that the planes are fitted on at most; those of lowest hash.
SAMPLE = 50_000
Forest = list[list[dict]]


def fit(rows: DataFrame, trees: int, per_leaf: int = 200) -> Forest:
    """Trees whose leaves hold about per_leaf of all vectors each, as far as the sample tells them apart; points are left out of the nodes."""
    total = rows.count()
    sample = rows.filter("x IS NOT NULL").orderBy(S.hash_mix(F.col("row_id")), "row_id").limit(SAMPLE).select("row_id", "x").toPandas()
    if not len(sample):
        return []
    leaf = max(5, round(per_leaf * len(sample) / max(1, total)))
    found = build_forest(sample["row_id"].to_numpy(), np.stack(sample["x"].to_numpy()), trees, leaf)
    return [[{k: node[k] for k in ("left", "right", "h", "b")} for node in tree] for tree in found]


def _leaves(tree: list[dict], x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaf of each vector, and those beyond planes no farther than spill from it."""
    at, node = [], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if not len(rows):
            continue
        if tree[n]["h"] is None:
            at.append(rows)
            node.append(np.full(len(rows), n))
            continue
        m = x[rows] @ tree[n]["h"] + tree[n]["b"]
        todo += [(tree[n]["left"], rows[m > -spill]), (tree[n]["right"], rows[m <= spill])]
    return (np.concatenate(at), np.concatenate(node)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def placed(rows: DataFrame, forest: Forest, spill: float = 0.0) -> DataFrame:
    """(tree, leaf, row_id, x) of every vector."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["x"].notna()]
            if len(f):
                x = np.stack(f["x"].to_numpy())
                for t, tree in enumerate(forest):
                    at, leaf = _leaves(tree, x, spill)
                    yield pd.DataFrame({"tree": t, "leaf": leaf, "row_id": f["row_id"].to_numpy()[at], "x": [x[i] for i in at]})

    return rows.select("row_id", "x").mapInPandas(work, "tree int, leaf int, row_id bigint, x array<double>")


def nearest(rows: DataFrame, queries: DataFrame, forest: Forest, k: int, spill: float = 0.1, digits: int = 6) -> DataFrame:
    """(query, row_id, score): for each query the k largest inner products among the vectors of the leaves that it visits.

    Every vector lies in a leaf of every tree; queries, a stated set, also visit leaves beyond
    planes no farther than spill. The join on (tree, leaf) meets leaves of bounded size; ties
    go to the smaller row_id. Without vectors there are no rows. Recall is measured in tests.
    """
    q = placed(queries, forest, spill).select("tree", "leaf", F.col("row_id").alias("query"), F.col("x").alias("qx"))
    pairs = placed(rows, forest).join(q, ["tree", "leaf"]).filter("row_id <> query").select("query", "row_id", F.round(V.dot(F.col("qx"), F.col("x")), digits).alias("score")).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
    return pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
