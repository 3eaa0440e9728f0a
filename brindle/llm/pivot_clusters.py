"""Similarity clusters of dense vectors by parallel pivot correlation clustering.

Two vectors are similar within a radius. Records are ordered by the hash of their id; the
pivots are those that have no similar pivot before them, and each absorbs what is similar to
it. The similarity graph is never written down. Pivots of frequent clusters come first: of
the records that are left, those of lowest hash are examined together (every record before
them is among them or gone, so the local minima found there are exact), and one pass absorbs.
When pivots no longer absorb many records each, the rest is sent to cells that overlap by the
radius, and every round takes the local minima of all cells at once as pivots and absorbs
their neighbours, until no record is left. Then members move to the closest pivot, medoids
are recomputed and take the pivots' place, and medoids that are similar themselves are
clustered in the same way, the largest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.vectors import Router, nearest_rows, pack_rows, pack_source, squared_distances, unpack_rows
from brindle.session import written

#: Rows a cell of the rest holds on average, and the most cells.
CELL_ROWS, MOST_CELLS = 20_000, 65_536
#: Records that a pivot known to all tasks absorbs at least, and the most such pivots.
ABSORBS, MOST_PIVOTS = 16, 16_384
#: The part of what is left that a round of such pivots absorbs, or the search for them ends; and the records of a last, deeper look.
SHARE, DEEP = 1 / 64, 16_384
PACKED = "id bigint, h bigint, x binary"


@dataclass
class Clusters:
    """rows (id, h, x): the usable rows. medoids (ids), centres (their vectors), means and sizes of the frequent clusters.
    near (row_id, cluster, distance) are their members, left (id, h, x) the other rows."""

    rows: DataFrame
    dim: int
    radius: float
    medoids: np.ndarray
    centres: np.ndarray
    means: np.ndarray
    sizes: np.ndarray
    near: DataFrame
    left: DataFrame


def local_minima(x: np.ndarray, radius: float) -> np.ndarray:
    """Positions of the pivots among vectors in order: each that is similar to no pivot before it."""
    pivots, limit, block = np.empty(0, np.int64), radius * radius, 512
    for s in range(0, len(x), block):
        part = x[s : s + block]
        free = np.ones(len(part), bool)
        for t in range(0, len(pivots), 8192):
            free &= squared_distances(part, x[pivots[t : t + 8192]]).min(axis=1) > limit
        within = squared_distances(part, part) <= limit
        new = []
        for i in np.flatnonzero(free):
            if free[i]:
                new.append(s + i)
                free &= ~within[i]
        pivots = np.concatenate([pivots, np.array(new, np.int64)])
    return pivots


def _closest(x: np.ndarray, centres: np.ndarray, means: np.ndarray | None, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance to its centre, member): a member is within the radius of the closest centre, or of that cluster's mean."""
    if not len(centres):
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x), bool)
    best = nearest_rows(x, centres)
    # anew from the differences: the same for equal rows in any batch
    d = np.sqrt(((x.astype(np.float64) - centres[best]) ** 2).sum(axis=1))
    member = d <= radius
    if means is not None:
        member |= ((x.astype(np.float64) - means[best]) ** 2).sum(axis=1) <= radius * radius
    return best, d, member


def _moments(rows: DataFrame, dim: int, radius: float, centres: np.ndarray, means: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(size, mean) of each cluster after members have moved to the closest centre. Each task sends one row a cluster."""
    k = len(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim))
        for b in batches:
            x = unpack_rows(b.column(0), dim)
            c, _, member = _closest(x, centres, means, radius)
            c, x = c[member], x[member]
            n += np.bincount(c, minlength=k)
            order = np.argsort(c, kind="stable")
            starts = np.flatnonzero(np.diff(c[order], prepend=-1))
            if len(starts):
                total[c[order][starts]] += np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
        some = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dim, pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), sums], names=["c", "n", "s"])

    out = rows.select("x").mapInArrow(work, "c bigint, n bigint, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dim)]).alias("s")).toArrow()
    n, mean = np.zeros(k, np.int64), centres.astype(np.float64).copy()
    c = out["c"].to_numpy()
    n[c] = out["n"].to_numpy()
    if len(c):
        mean[c] = out["s"].combine_chunks().flatten().to_numpy().reshape(-1, dim) / n[c][:, None]
    return n, mean


def _medoids(rows: DataFrame, dim: int, radius: float, centres: np.ndarray, means: np.ndarray | None, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, id, vector) of the medoids. Under squared Euclidean distance the member of least total distance to the
    others is the one nearest their mean; ties go to the smaller id. Each task sends one row a cluster."""
    k = len(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, who, vec = np.full(k, np.inf), np.full(k, np.iinfo(np.int64).max), np.zeros((k, dim), np.float32)
        for b in batches:
            ids, x = b.column(0).to_numpy(), unpack_rows(b.column(1), dim)
            c, _, member = _closest(x, centres, means, radius)
            ids, c, x = ids[member], c[member], x[member]
            d = ((x.astype(np.float64) - mean[c]) ** 2).sum(axis=1)
            order = np.lexsort((ids, d, c))
            first = order[np.flatnonzero(np.diff(c[order], prepend=-1))]
            better = (d[first] < near[c[first]]) | ((d[first] == near[c[first]]) & (ids[first] < who[c[first]]))
            first = first[better]
            near[c[first]], who[c[first]], vec[c[first]] = d[first], ids[first], x[first]
        some = np.flatnonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near[some]), pa.array(who[some]), pack_rows(vec[some])], names=["c", "d", "id", "x"])

    best = rows.select("id", "x").mapInArrow(work, "c bigint, d double, id bigint, x binary").groupBy("c").agg(F.min(F.struct("d", "id", "x")).alias("m"))
    out = best.select("c", "m.id", "m.x").toArrow()
    return out["c"].to_numpy(), out["id"].to_numpy(), unpack_rows(out["x"], dim)


def _beyond(left: DataFrame, dim: int, pivots: np.ndarray, radius: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack_rows(b.column(2), dim)
            if len(x):
                yield b.filter(pa.array(~_closest(x, pivots, None, radius)[2]))

    return left.mapInArrow(work, PACKED)


def fit(points: DataFrame, id_col: str, x_col: str, dim: int, radius: float, examined: int = 1024, moves: int = 6, salt: int = 11) -> Clusters:
    """Frequent clusters of all usable rows, and the rows outside of them (see ``assign``).

    examined is how many records of lowest hash a round looks at together (and what reaches
    the driver of them). Pivots that absorb fewer than ABSORBS records are left to the cells
    with their records, and so is everything once a round absorbs too little. That moves
    work, not pivots: either way finds the pivots of the one order by hash. Members move to
    the closest medoid, and medoids are recomputed, until they stay or moves are done.
    """
    rows = written(pack_source(points, id_col, x_col, dim, salt), "points")
    left, pivots, ids, total = rows, np.empty((0, dim), np.float32), np.empty(0, np.int64), rows.count()
    while total and len(pivots) < MOST_PIVOTS:
        head = left.orderBy("h", "id").limit(examined).toArrow()
        x = unpack_rows(head["x"], dim)
        new = local_minima(x, radius)
        n, _ = _moments(left, dim, radius, x[new], None)
        fertile = new[n >= ABSORBS]
        if len(fertile):
            left, pivots, ids = written(_beyond(left, dim, x[fertile], radius), "left"), np.concatenate([pivots, x[fertile]]), np.concatenate([ids, head["id"].to_numpy()[fertile]])
        before, total = total, left.count()
        if before - total < SHARE * before:
            if examined >= DEEP or total < 64 * DEEP:
                break
            examined = DEEP
    means = None
    for _ in range(moves if len(pivots) else 0):
        n, mean = _moments(rows, dim, radius, pivots, means)
        c, medoid, vec = _medoids(rows, dim, radius, pivots, means, mean)
        order = np.lexsort((medoid, -n[c]))
        c, medoid, vec = c[order], medoid[order], vec[order]
        kept = local_minima(vec, radius)  # similar medoids: the largest cluster's stands for all
        same = np.array_equal(np.sort(medoid[kept]), np.sort(ids))
        ids, pivots, means = medoid[kept], vec[kept], mean[c[kept]]
        if same:
            break
    n = np.zeros(len(pivots), np.int64)
    if len(pivots):
        n, mean = _moments(rows, dim, radius, pivots, means)
    else:
        mean = pivots.astype(np.float64)
    within = means

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d, member = _closest(unpack_rows(b.column(2), dim), pivots, within, radius)
            out = pa.array(~member)
            cluster = pa.array(ids[c] if len(ids) else c, pa.int64(), mask=~member)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _only(b.column(2), out), cluster, pa.array(d, mask=~member)], names=["id", "h", "x", "cluster", "distance"])

    placed = written(rows.mapInArrow(place, f"{PACKED}, cluster bigint, distance double"), "placed")
    near = placed.filter("cluster IS NOT NULL").select(F.col("id").alias("row_id"), "cluster", "distance")
    return Clusters(rows, dim, radius, ids, pivots, mean, n, near, placed.filter("cluster IS NULL").select("id", "h", "x"))


def _only(x: pa.Array, keep: pa.Array) -> pa.Array:
    """Values where keep holds, else null."""
    return pc.if_else(keep, x, pa.scalar(None, x.type))


# ---- the rest, in cells that overlap


def _cells(left: DataFrame, dim: int, radius: float, k: int) -> DataFrame:
    """(cell, id, h, x): every row in its cell and in those it visits, so that similar rows share a cell."""
    anchors = unpack_rows(left.orderBy("h", "id").limit(k).select("x").toArrow()["x"], dim)
    router = Router.fit(anchors, k, steps=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack_rows(b.column(2), dim)
            for s in range(0, len(x), 2048):
                part = b.slice(s, 2048)
                at, cell, _ = router.visits(x[s : s + 2048], radius)
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *took.columns], names=["cell", "id", "h", "x"])

    return written(left.mapInArrow(work, f"cell int, {PACKED}"), "cells")


def _has_lower(x: np.ndarray, radius: float) -> np.ndarray:
    """Whether a row before it is similar, for vectors in order."""
    out, block, limit = np.zeros(len(x), bool), 1024, radius * radius
    for s in range(0, len(x), block):
        part = x[s : s + block]
        for t in range(0, s, 8192):
            out[s : s + block] |= squared_distances(part, x[t : min(s, t + 8192)]).min(axis=1) <= limit
        within = np.tril(squared_distances(part, part) <= limit, -1)
        out[s : s + block] |= within.any(axis=1)
    return out


def _ordered(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a cell by (first, h, id)."""
    order = np.lexsort((t["id"].to_numpy(), t["h"].to_numpy(), t["first"].to_numpy()))
    return t["id"].to_numpy()[order], unpack_rows(t["x"], dim)[order]


def _pivots(cells: DataFrame, dim: int, radius: float) -> DataFrame:
    """(id) of the pivots among rows (cell, id, h, x, first) in the order of first, then h.

    Each round takes as pivots all rows that have no similar row before them in any cell, and
    absorbs their neighbours; the lowest row left is one of them, so the rounds end, after a
    few as a rule.
    """

    def lower(t: pa.Table) -> pa.Table:
        ids, x = _ordered(t, dim)
        return pa.table({"id": ids, "lower": _has_lower(x, radius)})

    found, open_ = None, cells
    while not open_.isEmpty():
        low = open_.groupBy("cell").applyInArrow(lower, "id bigint, lower boolean").groupBy("id").agg(F.max("lower").alias("lower"))
        new = written(low.filter("NOT lower").select("id"), "pivots")
        found = new if found is None else found.unionByName(new)
        gone = _nearest_marked(open_, new, dim, radius).select("id")
        open_ = written(open_.join(gone, "id", "left_anti"), "open")
    return found if found is not None else cells.select("id").limit(0)


def _nearest_marked(cells: DataFrame, marked: DataFrame, dim: int, radius: float) -> DataFrame:
    """(id, cluster, distance): the closest marked row within the radius of each row of the cells, ties to the smaller id."""

    def work(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), unpack_rows(t["x"], dim)
        m = t["marked"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids[m], kind="stable")
        who, centres = ids[m][order], x[m][order]
        c, d, near = _closest(x, centres, None, radius)
        return pa.table({"id": ids[near], "cluster": who[c[near]] if len(who) else ids[near], "distance": d[near]})

    flags = cells.select("cell", "id", "x").join(marked.select("id", F.lit(True).alias("m")), "id", "left").select("cell", "id", "x", F.coalesce("m", F.lit(False)).alias("marked"))
    found = flags.groupBy("cell").applyInArrow(work, "id bigint, cluster bigint, distance double")
    return found.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("m")).select("id", "m.cluster", "m.distance")


def _means(members: DataFrame, left: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, mean) of (id, cluster), with the vectors of left."""
    joined = members.select("id", "cluster").join(unpacked(left, dim), "id")
    return joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("v")[j].cast("double")) for j in range(dim)]).alias("mean"))


def unpacked(rows: DataFrame, dim: int) -> DataFrame:
    """(id, v ARRAY<FLOAT>) of packed rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack_rows(b.column(1), dim)
            v = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), v], names=["id", "v"])

    return rows.select("id", "x").mapInArrow(work, "id bigint, v array<float>")


def _settle(t: pa.Table, dim: int, radius: float) -> pa.Table:
    """What ``_rest`` does with several cells, for rows (id, h, x) that one cell holds."""
    order = np.lexsort((t["id"].to_numpy(), t["h"].to_numpy()))
    ids, x = t["id"].to_numpy()[order], unpack_rows(t["x"], dim)[order]
    cluster, distance = np.empty(len(ids), np.int64), np.empty(len(ids))

    def members(rows: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marked = marked[np.argsort(ids[marked], kind="stable")]
        c, d, near = _closest(x[rows], x[marked], None, radius)
        return marked[c], d, near

    everyone = np.arange(len(ids))
    of, _, _ = members(everyone, local_minima(x, radius))
    heads, back, sizes = np.unique(of, return_inverse=True, return_counts=True)
    means = np.zeros((len(heads), dim))
    np.add.at(means, back, x.astype(np.float64))
    means /= sizes[:, None]
    apart = np.where(sizes[back] > 1, ((x.astype(np.float64) - means[back]) ** 2).sum(axis=1), 0.0)
    best = np.lexsort((ids, apart, back))
    medoids = best[np.flatnonzero(np.diff(back[best], prepend=-1))]
    ranked = np.lexsort((medoids, -sizes))
    kept = medoids[ranked][local_minima(x[medoids[ranked]], radius)]
    of, distance, near = members(everyone, kept)
    cluster = ids[of]
    if not near.all():
        rest = np.flatnonzero(~near)
        of, d, _ = members(rest, rest[local_minima(x[rest], radius)])
        cluster[rest], distance[rest] = ids[of], d
    return pa.table({"row_id": ids, "cluster": cluster, "distance": distance})


def _rest(left: DataFrame, dim: int, radius: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(row_id, cluster, distance) of all rows of left."""
    n = left.count()
    if n <= cell_rows:
        return left.withColumn("cell", F.lit(0)).groupBy("cell").applyInArrow(lambda t: _settle(t, dim, radius), "row_id bigint, cluster bigint, distance double")
    cells = _cells(left, dim, radius, min(MOST_CELLS, -(-n // cell_rows)))
    pivots = _pivots(cells.withColumn("first", F.lit(0).cast("bigint")), dim, radius)
    members = written(_nearest_marked(cells, pivots, dim, radius), "members")
    # medoids: of one member itself, of more the member nearest their mean
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    several = members.join(sizes.filter("size > 1"), "cluster").select("id", "cluster")
    apart = F.aggregate(F.zip_with("v", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    near_mean = several.join(_means(several, left, dim), "cluster").join(unpacked(left, dim), "id").groupBy("cluster", "n").agg(F.min(F.struct(apart.alias("d"), "id")).alias("m"))
    medoids = sizes.filter("size = 1").select(F.col("cluster").alias("id"), "size").unionByName(near_mean.select("m.id", F.col("n").alias("size")))
    kept = _pivots(cells.join(written(medoids, "medoids"), "id").select("cell", "id", "h", "x", (-F.col("size")).alias("first")), dim, radius)
    found = written(_nearest_marked(cells, kept, dim, radius), "found")
    # members that no medoid is similar to have pivots of their own
    open_ = written(cells.join(found, "id", "left_anti").withColumn("first", F.lit(0).cast("bigint")), "open")
    if not open_.isEmpty():
        found = found.unionByName(_nearest_marked(open_, _pivots(open_, dim, radius), dim, radius))
    return found.select(F.col("id").alias("row_id"), "cluster", "distance")


def assign(model: Clusters) -> DataFrame:
    """(row_id, cluster, distance): the cluster of every usable row, repeated rows once.

    A cluster is named by the row_id of its medoid (or of its pivot, where a row lies beyond
    the radius of all medoids), and distance is to that row. Members of frequent clusters
    are within the radius of its medoid or mean; all other rows are clustered in cells. A row
    similar to no other is a cluster of its own. Rows without an id, with a null vector, a
    wrong length or a value that is no finite number have no cluster. An empty table gives
    no rows; copies of one vector share a cluster.
    """
    if model.left.isEmpty():
        return model.near
    return model.near.unionByName(_rest(model.left, model.dim, model.radius))


def summaries(model: Clusters, assigned: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, size, mean) of the clusters of at least ``least`` members."""
    spark = assigned.sparkSession
    frequent = spark.createDataFrame([(int(i), int(n), [float(v) for v in m]) for i, n, m in zip(model.medoids, model.sizes, model.means, strict=True) if n >= least], "cluster bigint, size bigint, mean array<double>")
    rest = assigned.join(model.left.select(F.col("id").alias("row_id")), "row_id", "left_semi")
    sizes = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    members = rest.join(sizes, "cluster").select(F.col("row_id").alias("id"), "cluster")
    return frequent.unionByName(_means(members, model.left, model.dim).select("cluster", F.col("n").alias("size"), "mean"))


def describe(assigned: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, rank, row_id, distance): each cluster's size and its most typical members, nearest to the medoid first.

    Ties of distance go to the smaller row_id.
    """
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = assigned.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "row_id"))).filter(F.col("rank") <= typical)
    return ranked.join(sizes, "cluster").select("cluster", "size", "rank", "row_id", "distance")
