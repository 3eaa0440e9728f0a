"""The most frequent values of a column with very many distinct ones, in bounded memory.

Three-phase threshold top-k: every node holds the counts of its own rows; the nodes first
exchange their local leaders, whose sums give a lower bound for the k-th largest count;
then every value that has at least its node's share of that bound anywhere; then the exact
counts of the few values that can still be among the k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import written

#: Distinct values that a node holds before it closes its counts and goes on as a further node.
NODE_LIMIT = 4_000_000
#: With a share of the bound under FEW rows a node, nodes are merged into MERGED ones.
FEW, MERGED = 16, 64


def _local_counts(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, held, waiting = TaskContext.get().partitionId(), 0, None, []

        def merge() -> pa.Table | None:
            parts = [*([held] if held is not None else []), *waiting]
            if not parts:
                return None
            t = pa.concat_tables(parts).group_by("value").aggregate([("n", "sum")])
            return t.rename_columns(["value", "n"]) if t.column_names[0] == "value" else t.select(["value", "n_sum"]).rename_columns(["value", "n"])

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.sort_by([("n", "descending")])  # so that a threshold on n skips row groups of the written table
            ident = pa.array(np.full(t.num_rows, part * 1_000_000 + node, dtype=np.int64))
            yield from pa.table([ident, t["value"], t["n"].cast(pa.int64())], names=["node", "value", "n"]).combine_chunks().to_batches(max_chunksize=100_000)

        for b in batches:
            v = pc.drop_null(b.column(0))
            if not len(v):
                continue
            waiting.append(pa.table([v, pa.array(np.ones(len(v), dtype=np.int64))], names=["value", "n"]))
            if sum(len(w) for w in waiting) >= 500_000:
                held, waiting[:] = merge(), []
                if held.num_rows >= limit:
                    yield from close(held)
                    held, node = None, node + 1
        last = merge()
        if last is not None and last.num_rows:
            yield from close(last)

    return work


def top_values(df: DataFrame, value: str, k: int, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(value, n): the k most frequent values and their exact counts, largest first.

    Ties at the last place go to the smaller value. Nulls are left out; with fewer than k
    distinct values all are given. An empty table gives no rows; other columns are ignored.
    A node is a task's share of the input, or a part of it once node_limit distinct values
    are held, so memory is bounded; the local counts are written to the shared folder, sorted
    within each node, and no phase gathers more than leaders and candidates: at most k rows a
    node in the first, fewer than rows / threshold in the second. Where nodes are so many and so
    small that the threshold falls under FEW rows, their counts are merged into MERGED nodes
    first, by a shuffle of (node, value), so that the threshold doesn't sink with their number.
    """
    kind = df.schema[value].dataType.simpleString()
    local = written(df.select(F.col(value).alias("value")).mapInArrow(_local_counts(node_limit), f"node bigint, value {kind}, n bigint"), "local-counts")
    # phase 1: local leaders; their partial sums bound the k-th count from below
    nodes = local.select("node").distinct().count()
    leaders = _leaders(local, k).groupBy("value").agg(F.sum("n").alias("n"))
    bound = _kth(leaders, k)
    # phase 2: with no fewer than bound / nodes rows nowhere, a value can't reach the bound
    share = max(1, -(-bound // max(1, nodes)))
    if share < FEW and nodes > MERGED:  # so many small nodes that the share says little
        groups = local.groupBy((F.col("node") % 1_000_003 % MERGED).alias("node"), "value").agg(F.sum("n").alias("n"))
        local, nodes = written(groups, "merged-counts"), MERGED
        share = max(1, -(-bound // nodes))
    partial = local.filter(F.col("n") >= share).groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seen"))
    bound = max(bound, _kth(partial, k))
    # a value has less than share rows in each node that did not report it
    candidates = partial.filter(F.col("n") + (nodes - F.col("seen")) * (share - 1) >= bound).select("value")
    # phase 3: exact counts of the candidates
    exact = local.join(candidates, "value", "left_semi").groupBy("value").agg(F.sum("n").alias("n"))
    return exact.orderBy(F.desc("n"), F.asc("value")).limit(k).select(F.col("value").alias(value), "n")


def _leaders(local: DataFrame, k: int) -> DataFrame:
    """The k largest counts of each node; the rows of a node lie together and sorted, so each task keeps k a node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, int] = {}
        for b in batches:
            nodes = b.column(0).to_numpy()
            keep = np.zeros(len(nodes), dtype=bool)
            for node in np.unique(nodes):
                here = np.flatnonzero(nodes == node)[: max(0, k - taken.get(int(node), 0))]
                keep[here] = True
                taken[int(node)] = taken.get(int(node), 0) + len(here)
            yield b.filter(pa.array(keep))

    return local.mapInArrow(work, local.schema)


def _kth(counts: DataFrame, k: int) -> int:
    """The k-th largest n, 0 if there are fewer."""
    top = counts.select("n").orderBy(F.desc("n")).limit(k).agg(F.count("n").alias("c"), F.min("n").alias("m")).first()
    return top["m"] if top["c"] == k else 0
