"""Filling containers of fixed capacity with items: minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "item bigint, piece int, start bigint, tokens bigint, container bigint"


def byte_tokens(text: Column) -> Column:
    """Size in the public byte-level ByT5 vocabulary: one token a UTF-8 byte and one end token."""
    return F.octet_length(text).cast("bigint") + 1


def fullest(counts: np.ndarray, capacity: int, first: int) -> list[int]:
    """Lengths of a fullest feasible container that holds the given length.

    Subset sums are bits of one integer: bit s is set if s can be reached. Lengths join in
    falling order, each at most as often as it is left and as it fits, until the full
    capacity is reached or none is left; then the steps are walked back from the highest bit.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for length in np.flatnonzero(counts[: room + 1])[::-1]:
        length = int(length)
        times = min(int(counts[length]) - (length == first), room // length)
        for _ in range(times):
            new = (reach | (reach << length)) & mask
            if new == reach:
                break
            steps.append((length, reach))
            reach = new
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, [first]
    for length, before in reversed(steps):
        if not (before >> at) & 1:
            chosen.append(length)
            at -= length
    return chosen


def pack_pool(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each length, by minimum bin slack over the lengths that are left, the largest first."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    ends = np.cumsum(counts)  # items of length L end at ends[L] in order; they are taken from the end
    out = np.full(len(lengths), -1, dtype=np.int64)
    bin_no, top, left = 0, capacity, len(lengths)
    while left:
        while not counts[top]:
            top -= 1
        for length in fullest(counts, capacity, top):
            counts[length] -= 1
            ends[length] -= 1
            out[order[ends[length]]] = bin_no
            left -= 1
        bin_no += 1
    return out


def pack_lengths(lengths: np.ndarray, capacity: int, pool: int = 1000, enough: float = 0.995) -> np.ndarray:
    """Container number of each length. Lengths are packed a pool at a time, which keeps a container's search short;
    what lies in containers filled below enough joins the next pool."""
    out = np.full(len(lengths), -1, dtype=np.int64)
    carried, done = np.empty(0, dtype=np.int64), 0
    for start in range(0, len(lengths), pool):
        here = np.concatenate([carried, np.arange(start, min(start + pool, len(lengths)))])
        bins = pack_pool(lengths[here], capacity)
        good = np.bincount(bins, weights=lengths[here]) >= enough * capacity
        if start + pool >= len(lengths):
            good[:] = True
        number = np.cumsum(good) - 1 + done
        kept = good[bins]
        out[here[kept]] = number[bins[kept]]
        carried, done = here[~kept], done + int(good.sum())
    return out


def pack(df: DataFrame, item: str, size: Column, capacity: int, shards: int | None = None) -> DataFrame:
    """(item, piece, start, tokens, container): each item's pieces and the containers that hold them.

    An item within the capacity is one piece (0). A larger one is cut into pieces of the full
    capacity, each a container of its own, and a last piece that is packed like any item.
    Every task packs the items it reads by minimum bin slack; only ids and sizes reach it.
    Tasks share no container, which costs at most a few part-filled ones a task; give shards
    where the input has many tiny partitions. container is unique over all tasks.

    A null size (null text) is no item; an empty text is an item of its end token; sizes
    below 1 are no items. Repeated rows are items each. An empty table gives no rows.
    """
    rows = df.select(F.col(item).cast("bigint").alias("item"), size.cast("bigint").alias("tokens")).filter(F.col("tokens") > 0)
    if shards:
        rows = rows.repartition(shards, F.xxhash64("item"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts).combine_chunks()
        ids, sizes = held["item"], held["tokens"].to_numpy()
        whole, rest = sizes // capacity, sizes % capacity
        pieces = whole + (rest > 0)
        at = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.minimum(sizes[at] - piece * capacity, capacity)
        open_ = tokens < capacity
        number = np.empty(len(at), dtype=np.int64)
        number[open_] = pack_lengths(tokens[open_], capacity)
        number[~open_] = (number[open_].max() + 1 if open_.any() else 0) + np.arange((~open_).sum())
        base = np.int64(TaskContext.get().partitionId()) << 40
        out = pa.table(
            [ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(tokens), pa.array(base + number)],
            names=["item", "piece", "start", "tokens", "container"],
        )
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return rows.mapInArrow(work, PACKED)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill): how full the containers are over all."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 4)
    )
