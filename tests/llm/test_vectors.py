"""Clusters and nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import nearest_vectors, pivot_clusters
from brindle.llm.vectors import Router, content_hash, pack_rows, pack_source, unpack_rows

SCHEMA = "row_id bigint, x array<float>, id string, list int"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], "c", 0) for i, x in rows], SCHEMA).repartition(4)


def groups(rng, sizes, dim=8, far=30):
    centres = rng.normal(size=(len(sizes), dim)) * 20
    return [(c, centres[c] + rng.normal(size=dim)) for c, n in enumerate(sizes) for _ in range(n)] + [(-1, rng.normal(size=dim) * 200) for _ in range(far)]


def test_rows_survive_packing():
    x = np.random.default_rng(0).normal(size=(7, 8)).astype(np.float32)
    assert (unpack_rows(pack_rows(x), 8) == x).all() and unpack_rows(pack_rows(x[:0]), 8).shape == (0, 8)
    assert len(set(content_hash(x).tolist())) == 7 and (content_hash(x) == content_hash(x.copy())).all()


def test_clusters_find_the_groups(spark):
    rng = np.random.default_rng(1)
    data = groups(rng, [900, 300, 60])
    rows = [(i, x) for i, (_, x) in enumerate(data)]
    bad = [(9001, None), (9002, [1.0] * 7), (9003, [NAN] * 8), (9004, [None] * 8), (None, [1.0] * 8), rows[0], rows[0]]
    df = frame(spark, rows + bad)
    model = pivot_clusters.fit(df, "row_id", "x", 8, 8.0, examined=256)
    assigned = pivot_clusters.assign(model)
    got = assigned.toPandas()
    assert sorted(got["row_id"]) == list(range(len(data)))
    truth = {i: c for i, (c, _) in enumerate(data)}
    sizes = got.groupby("cluster").size().to_dict()
    assert sorted(sizes.values())[-3:] == [60, 300, 900]
    for c, part in got.groupby("cluster"):
        assert len({truth[i] for i in part["row_id"]}) == 1 and c in set(part["row_id"])
    means = {r["cluster"]: (r["size"], r["mean"]) for r in pivot_clusters.summaries(model, assigned).collect()}
    assert {c: n for c, (n, _) in means.items()} == {c: n for c, n in sizes.items() if n > 1}
    x = {i: v for i, v in rows}
    for c, (_, mean) in means.items():
        p = np.array([x[i] for i in got[got["cluster"] == c]["row_id"]])
        assert np.abs(p.mean(axis=0) - mean).max() < 1e-3
    top = pivot_clusters.describe(assigned).toPandas()
    assert all(len(p) == min(3, sizes[c]) and p["row_id"].iloc[p["rank"].argmin()] == c for c, p in top.groupby("cluster"))


def test_pivots_are_the_sequential_ones():
    x = np.random.default_rng(2).normal(size=(1500, 3)).astype(np.float32)
    want = []
    for i in range(len(x)):
        if all(np.linalg.norm(x[i] - x[j]) > 1.0 for j in want):
            want.append(i)
    assert pivot_clusters.local_minima(x, 1.0).tolist() == want


def test_thousands_of_groups_are_found(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3000, 8)) * 60
    data = [(g * 40 + i, centres[g] + rng.normal(size=8)) for g in range(3000) for i in range(40)]
    got = pivot_clusters.assign(pivot_clusters.fit(frame(spark, data), "row_id", "x", 8, 9.0)).toPandas()
    sizes = got.groupby("cluster").size()
    assert len(got) == 120_000 and (sizes == 40).sum() > 2900
    assert (got.groupby("cluster")["row_id"].agg(lambda r: (r // 40).nunique()) == 1).mean() > 0.98


@pytest.mark.parametrize("spread", [3.0, 40.0])
def test_cells_give_what_one_task_gives(spark, spread):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(60, 8)) * spread)[rng.integers(0, 60, 900)] + rng.normal(size=(900, 8))
    rows = frame(spark, [(i, v) for i, v in enumerate(x)])
    left = pack_source(rows, "row_id", "x", 8, 11)
    whole = {tuple(r) for r in pivot_clusters._rest(left, 8, 4.0).select("row_id", "cluster").collect()}
    cut = {tuple(r) for r in pivot_clusters._rest(left, 8, 4.0, cell_rows=100).select("row_id", "cluster").collect()}
    assert whole == cut and len(whole) == 900


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [0.0] * 8)], [(5, [0.0] * 8), (6, [0.0] * 8)]])
def test_clusters_of_hardly_anything(spark, rows):
    got = pivot_clusters.assign(pivot_clusters.fit(frame(spark, rows), "row_id", "x", 8, 1.0)).toPandas()
    assert sorted(got["row_id"]) == [i for i, x in rows if x is not None] and got["cluster"].nunique() <= 1


def brute(rows, k, reach):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in order if reach is None or d[j] <= reach}
    return out


def families(rng, n=150, dim=8):
    rows, at = [], 0
    for _ in range(n):
        c = rng.normal(size=dim) * 2
        for _ in range(rng.integers(1, 9)):
            rows.append((at * 7 % 5003, c + rng.normal(size=dim) * 0.25))
            at += 1
    return rows


def test_within_reach_nothing_is_missed(spark):
    rng = np.random.default_rng(3)
    rows = families(rng)
    rows += [(6000 + i, rows[3][1]) for i in range(7)]  # copies, and ties with them
    df = frame(spark, rows + [rows[0], (9001, None), (9002, [NAN] * 8)])
    index = nearest_vectors.fit(df, "row_id", "x", 8, lists=12)
    got = nearest_vectors.nearest(df, "row_id", "x", 8, 5, reach=1.0, index=index).toPandas()
    assert not got.duplicated(["row_id", "other"]).any()
    assert set(zip(got["row_id"], got["other"], strict=True)) == brute(rows, 5, 1.0)


def test_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(4)
    rows = families(rng, 40) + [(7000 + i, [0.5] * 8) for i in range(nearest_vectors.COPIES + 40)]
    rows.append((6999, [0.5 + 0.01] + [0.5] * 7))
    df = frame(spark, rows + rows[-3:])
    got = nearest_vectors.nearest(df, "row_id", "x", 8, 5, reach=1.0).toPandas()
    assert set(zip(got["row_id"], got["other"], strict=True)) == brute(rows, 5, 1.0)
    pairs = nearest_vectors.pairs(nearest_vectors.nearest(df, "row_id", "x", 8, 5, reach=1.0)).toPandas()
    assert (pairs["row_a"] < pairs["row_b"]).all() and not pairs.duplicated().any()


def test_recall_without_reach(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x) for i, (_, x) in enumerate(groups(rng, [500, 400, 300], far=0))]
    df = frame(spark, rows)
    index = nearest_vectors.fit(df, "row_id", "x", 8, lists=10)
    got = nearest_vectors.nearest(df, "row_id", "x", 8, 5, index=index).toPandas()
    want = brute(rows, 5, None)
    assert len(set(zip(got["row_id"], got["other"], strict=True)) & want) / len(want) >= 0.9


def test_lists_are_divided_again(spark, monkeypatch):
    monkeypatch.setattr(nearest_vectors, "LIST_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = families(rng)
    df = frame(spark, rows)
    for lists in (1, 3):
        index = nearest_vectors.fit(df, "row_id", "x", 8, lists=lists)
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32)
        own = np.random.default_rng(1).random(len(ids)) < 0.7
        row, other, _ = nearest_vectors.scan_list(ids, x, own, np.ones(len(ids), bool), index.router.centroid(0), index, 5, 1.0, 4)
        held = set(ids[own].tolist())
        assert {p for p in brute(rows, 5, 1.0) if p[1] in held and p[0] not in held} <= set(zip(row.tolist(), other.tolist(), strict=True))
    assert nearest_vectors.lists_for(50_000_000) == 1024 and 50_000_000 / 1024 < nearest_vectors.LARGE_LIST


def test_two_levels_of_cells_bring_neighbours_together(monkeypatch):
    monkeypatch.setattr(Router, "FLAT", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    y = (x + rng.normal(size=x.shape) * 0.2).astype(np.float32)
    router = Router.fit(x, 40)
    assert len(router.inner) > 1
    meet: list[set] = []
    for v in (x, y):
        at, cell, own = router.visits(v, 1.0)
        meet.append({(int(a), int(c), bool(o)) for a, c, o in zip(at, cell, own, strict=True)})
    for i in np.flatnonzero(np.linalg.norm(x - y, axis=1) <= 1.0):
        here = {c for a, c, _ in meet[0] if a == i} & {c for a, c, _ in meet[1] if a == i}
        assert any((i, c, True) in meet[0] | meet[1] for c in here)


def test_inner_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x) for i, (_, x) in enumerate(groups(rng, [500, 400, 300], far=20))]
    rows += [(5000 + i, rows[0][1]) for i in range(nearest_vectors.COPIES + 8)]
    df = frame(spark, [*rows, rows[3], (None, rows[0][1])])
    index = nearest_vectors.fit(df, "row_id", "x", 8, lists=10, parallel=4.0, score="product")
    got = nearest_vectors.nearest(df, "row_id", "x", 8, 5, index=index, probes=6, asks=F.col("row_id") % 10 == 0).toPandas()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    want = set()
    for i in np.flatnonzero(ids % 10 == 0):
        s = x @ x[i]
        want |= {(int(ids[i]), int(ids[j])) for j in [j for j in np.lexsort((ids, -s)) if j != i][:5]}
    pairs = set(zip(got["row_id"], got["other"], strict=True))
    assert len(pairs) == len(want) and len(pairs & want) / len(want) >= 0.9


def test_anisotropic_codes_lower_the_parallel_error():
    rng = np.random.default_rng(6)
    r = rng.normal(size=(2000, 8)).astype(np.float32)
    words = nearest_vectors._train_words(r, 4.0)

    def parallel(codes):
        e = r - np.stack([words[m][codes[:, m]] for m in range(4)], axis=1).reshape(r.shape)
        return (((e * r).sum(axis=1) / np.sqrt((r * r).sum(axis=1))) ** 2).mean()

    assert parallel(nearest_vectors.encode(r, words, 4.0)) < parallel(nearest_vectors.encode(r, words, 1.0))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0] * 8)]])
def test_nearest_of_hardly_anything(spark, rows):
    assert nearest_vectors.nearest(frame(spark, rows), "row_id", "x", 8, 5, reach=2.0).count() == 0
