"""The k most similar vectors for every vector, by distance or by inner product.

Vectors are divided into lists around centroids. Inside a list they are held as four-bit
codes: two dimensions a code, sixteen words a codebook, trained by a score-aware loss in
which the part of the error parallel to the vector counts more than the rest, since that
part moves the largest scores. Queries scan a list through tables of their scores with the
code words, and what the scan leaves is ranked by exact scores.

By inner product the scanned score ranks, and the best RERANK of a list are compared exactly.
By distance the known error of each code turns the scanned distance into a lower bound, and
only vectors whose bound is within reach are compared exactly. With a largest distance that
search is lossless: vectors within it meet in a list (see ``Router``), both directions of a
pair are kept. A list too large to be scanned as one is divided again where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.vectors import Router, content_hash, decode, decode_mask, kmeans, mixed, pack_rows, source, squared_distances, unpack_rows

WIDTH, WORDS = 2, 16
#: Vectors that a scanned list holds on average; lists that are shuffled hold up to LARGE_LIST, once there are SMALL_LISTS of them.
LIST_ROWS, LARGE_LIST, SMALL_LISTS = 600, 200_000, 1024
#: The most lists (for some 26 thousand million vectors; beyond, lists grow), and the most sampled vectors to fit them with.
MOST_LISTS, SAMPLE = 131_072, 524_288
#: The most sampled vectors to fit code words with.
CODE_SAMPLE = 16_384
#: A vector with more copies than this is searched for through its copies of smallest id.
COPIES = 64
#: Vectors of a list that are compared exactly by inner product, for each one asked for.
RERANK = 16
NEAR = "row_id bigint, other bigint, distance double"


@dataclass
class Index:
    """The lists and the code words of each pair of dimensions, (dim / 2, 16, 2). score: distance or product."""

    router: Router
    words: np.ndarray
    dim: int
    parallel: float
    score: str = "distance"


def lists_for(total: int) -> int:
    """How many lists a table of that many vectors gets."""
    return int(min(MOST_LISTS, max(1, min(total // LIST_ROWS, SMALL_LISTS), total // LARGE_LIST)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]


def encode(r: np.ndarray, words: np.ndarray, parallel: float, rounds: int = 2, toward: np.ndarray | None = None) -> np.ndarray:
    """Codes of residual vectors under the anisotropic loss |e|^2 + (parallel - 1) (e . u)^2, by coordinate descent.
    u is the direction of the residual, or of the vectors given as toward."""
    n, parts = len(r), len(words)
    pieces = r.reshape(n, parts, WIDTH)
    unit = _unit(r if toward is None else toward).reshape(n, parts, WIDTH)
    codes = np.empty((n, parts), np.uint8)
    along = np.empty((n, parts), np.float32)  # each piece's part of e . unit
    for m in range(parts):
        codes[:, m] = squared_distances(np.ascontiguousarray(pieces[:, m]), words[m]).argmin(axis=1)
        along[:, m] = ((pieces[:, m] - words[m][codes[:, m]]) * unit[:, m]).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(rounds if parallel > 1 else 0):
        for m in range(parts):
            loss = squared_distances(np.ascontiguousarray(pieces[:, m]), words[m])
            par = (pieces[:, m] * unit[:, m]).sum(axis=1)[:, None] - unit[:, m] @ words[m].T
            rest = total - along[:, m]
            best = (loss + (parallel - 1) * (rest[:, None] + par) ** 2).argmin(axis=1)
            codes[:, m] = best
            along[:, m] = np.take_along_axis(par, best[:, None], axis=1)[:, 0]
            total = rest + along[:, m]
    return codes


def _train_words(r: np.ndarray, parallel: float, steps: int = 4, toward: np.ndarray | None = None) -> np.ndarray:
    n, dim = r.shape
    parts = dim // WIDTH
    pieces = r.reshape(n, parts, WIDTH)
    words = np.zeros((parts, WORDS, WIDTH), np.float32)
    for m in range(parts):
        p = np.ascontiguousarray(pieces[:, m])
        w = kmeans(p, min(WORDS, n), 8)
        words[m, : len(w)] = w
        words[m, len(w) :] = w[-1]
    unit = _unit(r if toward is None else toward).reshape(n, parts, WIDTH)
    eye = np.eye(WIDTH)
    for _ in range(steps if parallel > 1 else 0):
        codes = encode(r, words, parallel, 1, toward)
        along = np.stack([((pieces[:, m] - words[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(parts)], axis=1)
        total = along.sum(axis=1)
        for m in range(parts):
            u = unit[:, m].astype(np.float64)
            a = eye + (parallel - 1) * u[:, :, None] * u[:, None, :]
            b = np.einsum("nij,nj->ni", a, pieces[:, m].astype(np.float64)) + (parallel - 1) * u * (total - along[:, m])[:, None]
            for j in range(WORDS):
                mine = codes[:, m] == j
                if mine.sum() >= 4:
                    words[m, j] = np.linalg.solve(a[mine].sum(axis=0) + 1e-6 * eye, b[mine].sum(axis=0))
    return words


def fit(points: DataFrame, id_col: str, x_col: str, dim: int, parallel: float = 2.0, lists: int | None = None, score: str = "distance") -> Index:
    """Lists and code words from a sample of lowest hash, SAMPLE rows at most; every row is put into a list later."""
    if dim % (2 * WIDTH):
        raise ValueError("dim must be a multiple of 4")
    src = source(points, id_col, x_col)
    total = points.count()
    k = lists or lists_for(total)
    share = min(1.0, min(SAMPLE, 24 * max(k, 40)) / max(total, 1))
    limit = int(share * (2**63 - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # an id repeated without end is sampled once a task
        for b in batches:
            ids, x = decode(b, dim)
            m = [i for i in np.flatnonzero(mixed(ids, 3) <= limit).tolist() if ids[i] not in sent and not sent.add(int(ids[i]))]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(mixed(ids[m], 3)), pack_rows(x[m])], names=["h", "x"])

    got = src.mapInArrow(work, "h bigint, x binary").toArrow()
    x = unpack_rows(got["x"], dim)
    x = x[np.lexsort((content_hash(x), got["h"].to_numpy()))]
    x = x[np.sort(np.unique(content_hash(x), return_index=True)[1])]
    if not len(x):
        return Index(Router(np.zeros((1, dim), np.float32), [np.zeros((1, dim), np.float32)]), np.zeros((dim // WIDTH, WORDS, WIDTH), np.float32), dim, parallel, score)
    router = Router.fit(x, min(k, len(x)))
    part = x[:CODE_SAMPLE]
    at, cell, own = router.visits(part, None)
    at, cell = at[own], cell[own]
    r = part[at] - np.stack([router.centroid(int(c)) for c in cell])
    return Index(router, _train_words(r, parallel, toward=part[at] if score == "product" else None), dim, parallel, score)


def _top(q: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each q, ties to the smaller id."""
    order = np.lexsort((other, d, q))
    q, other, d = q[order], other[order], d[order]
    starts = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    m = rank < k
    return q[m], other[m], d[m]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _codes(x: np.ndarray, centroid: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a list's vectors, two of four bits a byte and one row a byte, and the length of each one's error."""
    r = x - centroid
    codes = encode(r, index.words, index.parallel, toward=x if index.score == "product" else None)
    decoded = np.stack([index.words[m][codes[:, m]] for m in range(len(index.words))], axis=1).reshape(r.shape)
    return np.ascontiguousarray((codes[:, 0::2] * WORDS + codes[:, 1::2]).T), np.sqrt(((r - decoded) ** 2).sum(axis=1)) * 1.0001 + 1e-4


def _scanned(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the table entries (parts, 16, queries) over the codes of a list, (vectors, queries); a look-up fetches a
    row of all queries."""
    out = np.zeros((codes.shape[1], tables.shape[2]), np.float32)
    for p in range(len(codes)):
        both = (tables[2 * p][:, None, :] + tables[2 * p + 1][None, :, :]).reshape(WORDS * WORDS, -1)
        out += both[codes[p]]
    return out


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, centroid: np.ndarray, index: Index, k: int, reach: float | None, back: np.ndarray | None = None) -> list[Found]:
    """(row, other, distance) pieces: the k nearest of a list's vectors for every query; and of the queries marked in back,
    the k nearest for every vector of the list. By product, distance is the negative product. Candidates are never capped
    by distance."""
    if not len(ids) or not len(q_ids):
        return []
    parts = index.dim // WIDTH
    codes, error = _codes(x, centroid, index)
    x64, q64 = x.astype(np.float64), q.astype(np.float64)
    out: list[Found] = []
    block = max(16, min(512, 4_000_000 // len(ids)))
    for s in range(0, len(q_ids), block):
        part = q[s : s + block]
        if index.score == "product":
            scores = _scanned(np.einsum("qpw,pcw->pcq", part.reshape(-1, parts, WIDTH), index.words), codes) + (part @ centroid)[None]
            keep = min(RERANK * k, len(ids))
            near = np.zeros(scores.shape, bool)
            np.put_along_axis(near, np.argpartition(-scores, keep - 1, axis=0)[:keep], True, axis=0)
        else:
            pieces = (part - centroid).reshape(-1, parts, WIDTH).transpose(1, 0, 2)
            apart = _scanned(sum((index.words[:, :, None, w] - pieces[:, None, :, w]) ** 2 for w in range(WIDTH)), codes)
            if reach is not None:
                near = apart <= np.square(reach + error)[:, None]
            else:
                root = np.sqrt(apart)
                most = root + error[:, None]
                kth = np.partition(most, min(k, len(ids) - 1), axis=0)[min(k, len(ids) - 1)]  # k others beside the query itself
                near = root - error[:, None] <= kth[None] + 1e-4
        xi, qi = np.nonzero(near)
        qi += s
        keep = q_ids[qi] != ids[xi]
        qi, xi = qi[keep], xi[keep]
        d = np.empty(len(qi))
        for t in range(0, len(qi), 100_000):
            a, b = q64[qi[t : t + 100_000]], x64[xi[t : t + 100_000]]
            d[t : t + 100_000] = -(a * b).sum(axis=1) if index.score == "product" else np.sqrt(((a - b) ** 2).sum(axis=1))
        if reach is not None:
            m = d <= reach
            qi, xi, d = qi[m], xi[m], d[m]
        out.append(_top(q_ids[qi], ids[xi], d, k))
        if back is not None and (m := back[qi]).any():
            out.append(_top(ids[xi[m]], q_ids[qi[m]], d[m], k))
    return out


def _places(router: Router, x: np.ndarray, asks: np.ndarray, reach: float | None, probes: int, product: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): where each row lies and, if it asks or there is a reach, which cells it visits."""
    if reach is not None:
        return router.visits(x, reach)
    at, cell, own = router.visits(x, None, 1 if product else probes)
    if product:
        a, c = router.leading(x[asks], probes)
        at, cell, own = np.concatenate([at, np.flatnonzero(asks)[a]]), np.concatenate([cell, c]), np.concatenate([own, np.zeros(len(a), bool)])
        order = np.lexsort((~own, cell, at))  # at home once
        at, cell, own = at[order], cell[order], own[order]
        once = np.append(True, (np.diff(at) != 0) | (np.diff(cell) != 0))
        return at[once], cell[once], own[once]
    m = own | asks[at]
    return at[m], cell[m], own[m]


def scan_list(ids: np.ndarray, x: np.ndarray, own: np.ndarray, asks: np.ndarray, centroid: np.ndarray, index: Index, k: int, reach: float | None, probes: int) -> Found:
    """The nearest of a list's own vectors for every row that asks, and with a reach those of every own vector among the
    visitors. A list of several LIST_ROWS is divided in the same way as the whole."""
    pieces: list[Found] = []
    if own.any() and own.sum() <= 4 * LIST_ROWS:
        pieces = scan(ids[asks], x[asks], ids[own], x[own], centroid, index, k, reach, ~own[asks] if reach is not None else None)
    elif own.any():
        sub = Router.fit(x[own][np.argsort(mixed(ids[own], 31), kind="stable")][: 24 * max(1, int(own.sum()) // LIST_ROWS)], int(own.sum()) // LIST_ROWS, 3)
        visits = [_places(sub, x[s : s + 2048], asks[s : s + 2048], reach, probes, index.score == "product") for s in range(0, len(x), 2048)]
        at = np.concatenate([v[0] + 2048 * i for i, v in enumerate(visits)])
        cell, inner = np.concatenate([v[1] for v in visits]), np.concatenate([v[2] for v in visits])
        order = np.argsort(cell, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            rows, home, c = at[part], inner[part], sub.centroid(int(cell[part[0]]))
            mine, ask = own[rows], asks[rows]
            data, q = rows[home & mine], rows[ask]
            back = ~(home & mine)[ask] if reach is not None else None
            pieces += scan(ids[q], x[q], ids[data], x[data], c, index, k, reach, back)
            if reach is not None:  # visitors at home in this part, for the list's own rows
                data, q = rows[home & ~mine], rows[ask & mine]
                pieces += scan(ids[q], x[q], ids[data], x[data], c, index, k, reach, np.ones(len(q), bool))
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate([p[i] for p in pieces]) for i in range(3))


def nearest(points: DataFrame, id_col: str, x_col: str, dim: int, k: int, reach: float | None = None, index: Index | None = None, probes: int = 4, asks: Column | None = None) -> DataFrame:
    """(row_id, other, distance): the k nearest other vectors of every usable vector, nearest first by distance, then id.

    With reach, only vectors within that distance, and none of them is missed; without, each
    vector searches the probes nearest lists (measure recall against brute force). An index
    fitted for score "product" ranks by inner product, the largest first, and distance is the
    negative product. asks, a condition on the rows of points, names the queries; without it
    every row is one. Every row is searched.

    Vectors with more than COPIES exact copies are searched through the k + 1 copies of
    smallest id; by distance the other copies have those as their nearest at distance 0, so a
    group of copies of any size costs one row each.

    Rows without an id, with a null vector, a wrong length or a value that is no finite
    number take no part; rows repeated under one id count once. An empty table gives no
    rows; other columns are ignored.
    """
    index = index or fit(points, id_col, x_col, dim)
    router, product = index.router, index.score == "product"
    if product and reach is not None:
        raise ValueError("reach is a distance")
    src = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(x_col).cast("array<float>").alias("x"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = decode_mask(b, dim)
            ids, x = decode(b, dim)
            yield pa.RecordBatch.from_arrays([pa.array(content_hash(x)), pa.array(ids), pack_rows(x), b.column(2).filter(fits)], names=["h", "id", "x", "asks"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in full(batches):
            yield b.select([0, 1])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in full(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.ones(len(b), bool))], names=["id", "x", "asks", "held"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, all_x, ask, held = b.column(0).to_numpy(), unpack_rows(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            for s in range(0, len(ids), 2048):
                x = all_x[s : s + 2048]
                at, lists, own = _places(router, x, ask[s : s + 2048], reach, probes, product)
                own &= held[s : s + 2048][at]
                a = ask[s : s + 2048][at]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(own), pa.array(a), pa.array(ids[s : s + 2048][at]), pack_rows(x[at])], names=["list", "own", "asks", "id", "x"])

    def search(t: pa.Table) -> pa.Table:
        ids, own, ask = t["id"].to_numpy(), t["own"].to_numpy(zero_copy_only=False), t["asks"].to_numpy(zero_copy_only=False)
        x = unpack_rows(t["x"], dim)
        first = np.unique(ids, return_index=True)[1]
        row, other, d = scan_list(ids[first], x[first], own[first], ask[first], router.centroid(t["list"][0].as_py()), index, k, reach, probes)
        return pa.table([pa.array(row), pa.array(other), pa.array(d)], names=["row_id", "other", "distance"])

    copies = src.mapInArrow(hashed, "h bigint, id bigint")
    heavy = copies.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COPIES).select("h")
    known = None
    if heavy.isEmpty():
        searched = src.mapInArrow(plain, "id bigint, x binary, asks boolean, held boolean")
    else:
        rows = src.mapInArrow(full, "h bigint, id bigint, x binary, asks boolean")
        members = copies.join(heavy, "h", "left_semi").distinct()
        order = Window.partitionBy("h").orderBy("id")
        first = members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
        light = rows.join(heavy, "h", "left_anti").select("id", "x", "asks", F.lit(True).alias("held"))
        few = rows.join(first.select("h", "id"), ["h", "id"], "left_semi").select("id", "x", "asks", F.lit(True).alias("held"))
        searched = light.unionByName(few)
        others = rows.join(heavy, "h", "left_semi").join(first.select("h", "id"), ["h", "id"], "left_anti").filter("asks")
        if product:  # the other copies ask, and none of them can be an answer before those of smaller id
            searched = searched.unionByName(others.select("id", "x", "asks", F.lit(False).alias("held")))
        else:
            led = first.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            rest = others.select("h", "id").distinct().join(F.broadcast(led) if led.limit(10_001).count() <= 10_000 else led, "h")
            known = rest.select(F.col("id").alias("row_id"), F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(0.0).alias("distance"))
    cells = searched.mapInArrow(visits, "list int, own boolean, asks boolean, id bigint, x binary")
    found = cells.groupBy("list").applyInArrow(search, NEAR)
    if asks is not None:  # with a reach, answers come from either side of a pair
        found = found.join(src.filter("asks").select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi")
    best = Window.partitionBy("row_id").orderBy("distance", "other")
    # a pair found from both of its lists comes twice; equal rows share their dense rank
    ranked = found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k).drop("rank").dropDuplicates(["row_id", "other"])
    return ranked.unionByName(known) if known is not None else ranked


def pairs(found: DataFrame) -> DataFrame:
    """(row_a, row_b), row_a < row_b: each pair of a row and one of its nearest, once."""
    return found.select(F.least("row_id", "other").alias("row_a"), F.greatest("row_id", "other").alias("row_b")).distinct()
