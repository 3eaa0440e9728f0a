"""Queries of the general data problems (p1, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.skew import eager_join_aggregate, top_row_per_key
from brindle.session import table
from brindle.sources.rejects import load_ad_lines, rejects, triples


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_row_per_key(table(spark, d, "sparse_long"), "fid", "val", "row_id").select("fid", "row_id")


def p1_pair_sums(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of rows of one fid from fields below and from 6 on: their number and value sums, never building a pair."""
    rows = table(spark, d, "sparse_long")
    out = eager_join_aggregate(
        rows.filter("field < 6"), rows.filter("field >= 6"), "fid", {"left_val": F.col("val")}, {"right_val": F.col("val")}
    )
    return out.select("fid", F.col("n_pairs").cast("bigint").alias("n_pairs"), F.round("left_val", 2).alias("left_val"), F.round("right_val", 2).alias("right_val"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects(load_ad_lines(table(spark, d, "ad_lines"))).select("line_id", "reason")


def p5_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples(load_ad_lines(table(spark, d, "ad_lines"))).select("line_id", "row_id", "label", "pos", "field", "fid", "val")


QUERIES = {"p1_found": p1_found, "p1_pair_sums": p1_pair_sums, "p5_found": p5_found, "p5_triples": p5_triples}

#: A line's soundness under RFC 4180 and its fields, for DuckDB.
_LINES = r"""
  l AS (SELECT line_id, regexp_replace(coalesce(line, ''), '\r\z', '') AS t FROM ad_lines),
  q AS (SELECT line_id, t, regexp_matches(t, '(?s)\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z') AS sound FROM l),
  c AS (SELECT line_id, t, sound, regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS raw FROM q),
  f AS (SELECT line_id, sound, len(raw) AS n, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM c),
  s AS (SELECT line_id, sound, n, v, trim(v[3], ' ') AS feats FROM f),
  t AS (SELECT line_id, sound, n, v, CASE WHEN n <> 4 OR feats = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(feats, ' +') END AS toks FROM s),
  u AS (SELECT line_id, CASE
      WHEN NOT sound THEN 'quoting'
      WHEN n <> 4 OR len(list_filter(toks, lambda x: length(x) - length(replace(x, ':', '')) <> 2)) > 0 THEN 'column_count'
      WHEN NOT regexp_full_match(v[1], '[0-9]{1,18}') OR NOT regexp_full_match(v[2], '[01]') OR len(toks) = 0
        OR len(list_filter(toks, lambda x: NOT (
             regexp_full_match(split_part(x, ':', 1), '0*([0-9]|[123][0-9])')
             AND regexp_full_match(split_part(x, ':', 2), '0*[0-9]{1,19}')
             AND coalesce(TRY_CAST(split_part(x, ':', 2) AS HUGEINT) <= 9223372036854775807, false)
             AND regexp_full_match(split_part(x, ':', 3), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
             AND coalesce(isfinite(TRY_CAST(split_part(x, ':', 3) AS DOUBLE)), false)))) > 0 THEN 'bad_value' END AS reason,
      v, toks FROM t)
"""

ORACLES = {
    "p1_found": """SELECT fid, row_id FROM (SELECT fid, row_id, row_number() OVER (PARTITION BY fid ORDER BY val DESC, row_id) AS r
        FROM sparse_long WHERE fid IS NOT NULL AND val IS NOT NULL) WHERE r = 1""",
    "p1_pair_sums": """SELECT a.fid, CAST(a.n * b.n AS BIGINT) AS n_pairs, round(a.s * b.n, 2) AS left_val, round(b.s * a.n, 2) AS right_val
        FROM (SELECT fid, count(*) AS n, sum(val) AS s FROM sparse_long WHERE field < 6 AND fid IS NOT NULL GROUP BY fid) a
        JOIN (SELECT fid, count(*) AS n, sum(val) AS s FROM sparse_long WHERE field >= 6 AND fid IS NOT NULL GROUP BY fid) b ON a.fid = b.fid""",
    "p5_found": f"WITH {_LINES} SELECT line_id, reason FROM u WHERE reason IS NOT NULL",
    "p5_triples": f"""WITH {_LINES} SELECT line_id, CAST(v[1] AS BIGINT) AS row_id, CAST(v[2] AS INTEGER) AS label, CAST(pos - 1 AS INTEGER) AS pos,
        CAST(split_part(tok, ':', 1) AS INTEGER) AS field, CAST(split_part(tok, ':', 2) AS BIGINT) AS fid, CAST(split_part(tok, ':', 3) AS DOUBLE) AS val
        FROM (SELECT line_id, v, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM u WHERE reason IS NULL)""",
}
