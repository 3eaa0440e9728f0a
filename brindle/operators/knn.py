"""Exact nearest neighbours of a stated query set: queries go out in blocks, data stays where it is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the executors at a time, and those compared with a batch at a time.
BLOCK, AT_ONCE = 65_536, 2048


def topk_scores(data: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, row_id, score): for each query the k rows of largest inner product with it, itself left out.

    data and queries are (row_id, x ARRAY<DOUBLE>). Scores are rounded to digits, ties go to
    the smaller row_id. Each task keeps k rows a query and the window merges those. Null or
    unequally long vectors match nothing; empty inputs give no rows.
    """
    out, block = None, []

    def search(rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_s, best_i = np.full((len(ids), 0), -np.inf), np.empty((len(ids), 0), np.int64)
            for b in batches:
                keep = [i for i, n in enumerate(b.column(1).value_lengths().to_pylist()) if n == q.shape[1]]
                rid = b.column(0).to_numpy(zero_copy_only=False)[keep]
                x = b.column(1).take(pa.array(keep, pa.int64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                merged = []
                for at in range(0, len(ids), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    s = np.round(q[part] @ x.T, digits)
                    s[ids[part, None] == rid[None]] = -np.inf
                    all_s, all_i = np.concatenate([best_s[part], s], axis=1), np.concatenate([best_i[part], np.tile(rid, (len(s), 1))], axis=1)
                    order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    merged.append((np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)))
                best_s, best_i = np.concatenate([m[0] for m in merged]), np.concatenate([m[1] for m in merged])
            r, c = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best_i[r, c].astype(np.int64)), pa.array(best_s[r, c])], names=["query", "row_id", "score"])

        return data.select("row_id", "x").mapInArrow(work, "query bigint, row_id bigint, score double")

    for row in queries.filter("x IS NOT NULL").select("row_id", "x").toLocalIterator():
        block.append((row["row_id"], row["x"]))
        if len(block) == BLOCK:
            out, block = (search(block) if out is None else out.unionByName(search(block))), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return data.sparkSession.createDataFrame([], "query bigint, row_id bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
    return out.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
