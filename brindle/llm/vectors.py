"""Dense vectors as fixed-width binary rows, which Arrow hands to NumPy without a copy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers of a multiplicative hash (fixed values, the fractional parts of the golden ratio and of square roots).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def decode_mask(batch: pa.RecordBatch, dim: int) -> pa.Array:
    """Which rows of a batch (id, x, ...) are usable: id present, exactly dim values, all finite."""
    ids, x = batch.column(0), batch.column(1)
    fits = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(x), dim), False))
    flat = x.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    out = fits.to_numpy(zero_copy_only=False).copy()
    out[out] = np.isfinite(flat.reshape(-1, dim)).all(axis=1)
    return pa.array(out)


def decode(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors of the usable rows of a batch (id, x)."""
    ids, x = batch.column(0), batch.column(1)
    fits = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(x), dim), False))
    ids, x = ids.filter(fits), x.filter(fits)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    vectors = flat.reshape(-1, dim)
    good = np.isfinite(vectors).all(axis=1)
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), np.ascontiguousarray(vectors[good])


def pack_rows(vectors: np.ndarray) -> pa.Array:
    """float32 rows as a binary column."""
    n, width = len(vectors), vectors.shape[1] * 4
    data = pa.py_buffer(np.ascontiguousarray(vectors, dtype=np.float32).tobytes())
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])


def unpack_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The inverse of pack_rows."""
    if isinstance(column, pa.ChunkedArray):
        parts = [unpack_rows(c, dim) for c in column.chunks]
        return np.concatenate(parts) if parts else np.empty((0, dim), np.float32)
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty((0, dim), np.float32)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim)


def mixed(numbers: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 63-bit hashes of integers."""
    with np.errstate(over="ignore"):
        z = numbers.astype(np.uint64) + np.uint64(MIX[0]) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def content_hash(vectors: np.ndarray) -> np.ndarray:
    """63-bit hashes of whole vectors, equal for equal vectors (0.0 and -0.0 are equal)."""
    bits = (vectors + np.float32(0)).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        odd = mixed(np.arange(1, vectors.shape[1] + 1), 7).astype(np.uint64) | np.uint64(1)
        return mixed((bits * odd).sum(axis=1, dtype=np.uint64) ^ ((bits[:, ::-1] + np.uint64(MIX[0])) * odd).sum(axis=1, dtype=np.uint64))


def squared_distances(a: np.ndarray, b: np.ndarray, b_norms: np.ndarray | None = None) -> np.ndarray:
    """Squared Euclidean distances by one matrix product (approximate where a and b nearly coincide)."""
    bn = (b * b).sum(axis=1) if b_norms is None else b_norms
    d = a @ b.T
    d *= -2
    d += (a * a).sum(axis=1)[:, None]
    d += bn[None, :]
    return np.maximum(d, 0, out=d)


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Position of the nearest centre of each row, in blocks whose distances take a few dozen MB."""
    norms, step = (centres * centres).sum(axis=1), max(128, 8_000_000 // max(1, len(centres)))
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), step):
        out[s : s + step] = squared_distances(x[s : s + step], centres, norms).argmin(axis=1)
    return out


def source(points: DataFrame, id_col: str, x_col: str) -> DataFrame:
    """The two columns that the vector operators read."""
    return points.select(F.col(id_col).cast("bigint").alias("id"), F.col(x_col).cast("array<float>").alias("x"))


def pack_source(points: DataFrame, id_col: str, x_col: str, dim: int, salt: int) -> DataFrame:
    """(id, h, x): each usable row once, with the hash of its id and its packed vector.

    Of unequal vectors under one id the smallest in bytes counts. Rows repeated under one id
    are combined where they are read, before the shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = decode(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mixed(ids, salt)), pack_rows(x)], names=["id", "h", "x"])

    packed = source(points, id_col, x_col).mapInArrow(work, "id bigint, h bigint, x binary")
    return packed.groupBy("id", "h").agg(F.min("x").alias("x"))


def kmeans(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """k centroids, started from the first k rows; an empty one stays where it is."""
    c = x[:k].copy()
    for _ in range(steps):
        near = nearest_rows(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order][starts]] = np.add.reduceat(x[order], starts, axis=0) / n[near[order][starts]][:, None]
    return c


class Router:
    """Cells around centroids, in one level or in two, and the cells that a vector visits.

    Two vectors within a reach of each other whose nearest centroids differ are parted by the
    plane between these; one of the two is no farther than half the reach from it. A vector
    that visits every cell whose plane is so near thus meets, in its own cell or as a
    visitor, every vector within the reach. With two levels this holds at either: a vector
    has a nearest inner centroid in every outer cell that it visits.
    """

    #: The most centroids of one level.
    FLAT = 2048

    def __init__(self, outer: np.ndarray, inner: list[np.ndarray]):
        self.outer, self.inner = outer, inner
        self.start = np.cumsum([0, *[len(c) for c in inner]])
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_held": {}}

    @classmethod
    def fit(cls, x: np.ndarray, k: int, steps: int = 6) -> Router:
        """k cells or a few less, for a sample in random order."""
        if k <= cls.FLAT or len(x) <= cls.FLAT:
            return cls(np.zeros((1, x.shape[1]), np.float32), [kmeans(x, max(1, min(k, len(x))), steps)])
        outer = kmeans(x, int(np.sqrt(k)), steps)
        near = nearest_rows(x, outer)
        some = np.unique(near)
        inner = [kmeans(x[near == g], max(1, round(k * float((near == g).mean()))), steps) for g in some]
        return cls(outer[some], inner)

    def centroid(self, cell: int) -> np.ndarray:
        g = int(np.searchsorted(self.start, cell, side="right")) - 1
        return self.inner[g][cell - self.start[g]]

    def _level(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids of the outer level (-1) or of one outer cell, their squared norms and the distances between them."""
        c = self.outer if g < 0 else self.inner[g]
        if g not in self._held:
            self._held[g] = (c * c).sum(axis=1), np.sqrt(squared_distances(c, c))
        return c, *self._held[g]

    def _visits(self, g: int, x: np.ndarray, reach: float | None, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, norms, gaps = self._level(g)
        d = squared_distances(x, c, norms)
        first = d.argmin(axis=1)
        if reach is not None:
            go = d - np.take_along_axis(d, first[:, None], axis=1) <= reach * gaps[first] * 1.0001 + 1e-3
        else:
            go = np.zeros(d.shape, bool)
            p = min(probes, d.shape[1])
            np.put_along_axis(go, np.argpartition(d, p - 1, axis=1)[:, :p], True, axis=1)
        np.put_along_axis(go, first[:, None], True, axis=1)
        at, cell = np.nonzero(go)
        return at, cell, cell == first[at]

    def visits(self, x: np.ndarray, reach: float | None, probes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): the cells that each row visits. own: the nearest inner centroid of a visited outer cell;
        without a reach, that of the nearest outer cell only."""
        if len(self.inner) == 1:
            return self._visits(0, x, reach, probes)
        rows, cells, owns = [], [], []
        at, group, outer_own = self._visits(-1, x, reach, probes)
        for g in np.unique(group):
            m = group == g
            a, cell, own = self._visits(int(g), x[at[m]], reach, probes)
            rows.append(at[m][a])
            cells.append(cell + self.start[g])
            owns.append(own & (outer_own[m][a] | (reach is not None)))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(owns)

    def leading(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells of largest inner product with each row; of two levels, probes outer ones and probes cells in each."""

        def best(c: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = min(probes, len(c))
            cells = np.argpartition(-(x[rows] @ c.T), p - 1, axis=1)[:, :p]
            return np.repeat(rows, p), cells.ravel()

        everyone = np.arange(len(x))
        if len(self.inner) == 1:
            return best(self.inner[0], everyone)
        at, group = best(self.outer, everyone)
        found = [(best(self.inner[g], at[group == g]), self.start[g]) for g in np.unique(group)]
        return np.concatenate([f[0][0] for f in found]), np.concatenate([f[0][1] + f[1] for f in found])
