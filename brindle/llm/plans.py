"""Queries of the training-data operators and their SQL twins, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vec as V
from brindle.llm import eval_leaks, heavy_hitters, nearest_vectors, packing, pivot_clusters, subject_areas, term_frequency
from brindle.session import table

CAPACITY = 8192
DIM = 32


def _clusters(spark: SparkSession, d: str) -> pivot_clusters.Clusters:
    """Two points are similar within 1.2 times the usual distance of two points of one component, by the spreads of the earlier fit."""
    sigma2 = table(spark, d, "gauss").filter(F.size("sigma2") == DIM).select(V.total(F.col("sigma2")).alias("s"))
    spread = sigma2.agg(F.median("s")).first()[0] or 1.0
    return pivot_clusters.fit(table(spark, d, "points"), "row_id", "x", DIM, float(1.2 * np.sqrt(2 * spread)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """A group is a cluster of at least two points. Each is tied to the component nearest to its mean; no component has two
    groups, so of several clusters nearest to one the largest is its group."""
    model = _clusters(spark, d)
    assigned = pivot_clusters.assign(model)
    gauss = table(spark, d, "gauss").filter((F.size("mu") == DIM) & F.col("cluster").isNotNull()).select("cluster", "mu").orderBy("cluster").toArrow()  # 27 rows at every size
    component, mu = gauss["cluster"].to_numpy(), np.array(gauss["mu"].to_pylist()).reshape(-1, DIM)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = b.column(2).flatten().to_numpy().reshape(-1, 1, DIM)
            at = ((mean - mu[None]) ** 2).sum(axis=2).argmin(axis=1) if len(mu) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0)[: len(at)], b.column(1)[: len(at)], pa.array(component[at], pa.int32())], names=["cluster", "size", "component"])

    nearest = pivot_clusters.summaries(model, assigned).mapInArrow(tie, "cluster bigint, size bigint, component int")
    groups = nearest.groupBy("component").agg(F.max(F.struct("size", (-F.col("cluster")).alias("c"))).alias("g"))
    named = groups.select((-F.col("g.c")).alias("cluster"), "component")
    return assigned.join(F.broadcast(named), "cluster").select("row_id", F.col("component").alias("cluster"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All clusters, those of far points too, with their sizes and three most typical members."""
    return pivot_clusters.describe(pivot_clusters.assign(_clusters(spark, d)))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors.nearest(table(spark, d, "points"), "row_id", "x", DIM, 5, reach=2.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors.pairs(p3_nearest(spark, d))


def p3_inner(spark: SparkSession, d: str) -> DataFrame:
    """The five largest inner products with every vector whose row_id is divisible by 100, among all usable vectors."""
    points = table(spark, d, "points")
    index = nearest_vectors.fit(points, "row_id", "x", DIM, parallel=4.0, score="product")
    found = nearest_vectors.nearest(points, "row_id", "x", DIM, 5, index=index, probes=128, asks=F.col("row_id") % 100 == 0)
    return found.select("row_id", "other", (-F.col("distance")).alias("product"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).select("fid")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.top_values(table(spark, d, "sparse_long"), "fid", 50)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.term_frequencies(table(spark, d, "sparse_long"), "row_id", ["field", "fid"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_counts(spark, d).filter(F.col("mark").isNotNull()).select("field", "fid", "mark")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.byte_tokens(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """A document has a second piece exactly if it exceeds a container alone."""
    return p7_containers(spark, d).filter("piece = 1").select(F.col("item").alias("doc_id"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), CAPACITY)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).filter("kind = 'verbatim'").select("item_id", "doc_id").distinct()


def p9_areas(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas.subjects(table(spark, d, "documents"), table(spark, d, "area_examples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_areas(spark, d).select("doc_id", "area").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p3_inner": p3_inner,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_areas": p9_areas,
}

_TERMS = """SELECT field, fid, count(*) AS occurrences, count(DISTINCT row_id) AS records,
    CASE WHEN count(DISTINCT row_id) < 3 THEN 'rare'
         WHEN count(DISTINCT row_id) > 0.5 * (SELECT count(DISTINCT row_id) FROM sparse_long) THEN 'common' END AS mark
    FROM sparse_long WHERE field IS NOT NULL AND fid IS NOT NULL GROUP BY field, fid"""

_PAIRS = """WITH u AS (SELECT row_id, CAST(any_value(x) AS DOUBLE[]) AS x FROM points
      WHERE row_id IS NOT NULL AND x IS NOT NULL AND len(x) = 32 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 GROUP BY row_id),
    d AS (SELECT a.row_id AS a, b.row_id AS b, list_distance(a.x, b.x) AS d FROM u a JOIN u b ON a.row_id <> b.row_id WHERE list_distance(a.x, b.x) <= 2.0),
    r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d)"""

ORACLES = {
    "p3_found": f"{_PAIRS} SELECT DISTINCT least(a, b) AS row_a, greatest(a, b) AS row_b FROM r WHERE r <= 5",
    "p4_found": "SELECT fid FROM (SELECT fid, count(*) AS n FROM sparse_long WHERE fid IS NOT NULL GROUP BY fid ORDER BY n DESC, fid LIMIT 50)",
    "p4_counts": "SELECT fid, count(*) AS n FROM sparse_long WHERE fid IS NOT NULL GROUP BY fid ORDER BY n DESC, fid LIMIT 50",
    "p6_found": f"SELECT field, fid, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p6_counts": _TERMS,
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
