"""Readers and writers of sparse rows, dense rows and vocabularies, and the bindings of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import spread, table

SPARSE = "row_id bigint, label int, pos int, field int, fid bigint, val double"


def scan_sparse_text(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """(row_id, label, pos, field, fid, val) of ``label field:fid:val ...`` lines.

    A token without three parts or with a part that doesn't parse is dropped; so is a line
    without a label. pos counts the tokens that are kept.
    """
    parts = F.split(F.trim(F.col(line_col)), r"\s+")
    token = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.split(t, ":"))
    feats = F.transform(
        F.filter(token, lambda t: F.size(t) == 3),
        lambda t: F.struct(F.try_to_number(t[0], F.lit("999999999")).cast("int").alias("field"), t[1].try_cast("bigint").alias("fid"), t[2].try_cast("double").alias("val")),
    )
    sound = F.filter(feats, lambda f: f["field"].isNotNull() & f["fid"].isNotNull() & f["val"].isNotNull())
    rows = lines.select(F.col(id_col).alias("row_id"), parts[0].try_cast("int").alias("label"), sound.alias("f")).filter("label IS NOT NULL")
    return rows.select("row_id", "label", F.posexplode("f").alias("pos", "f")).select("row_id", "label", "pos", "f.field", "f.fid", "f.val")


def read_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """scan_sparse_text over a file or folder; rows are numbered without a shuffle."""
    return scan_sparse_text(spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()), "row_id", "value")


def write_sparse_text(rows: DataFrame, path: str) -> None:
    """The inverse of read_sparse_text; one line a row_id."""
    token = F.concat_ws(":", F.col("field").cast("string"), F.col("fid").cast("string"), F.col("val").cast("string"))
    lines = rows.groupBy("row_id", "label").agg(F.sort_array(F.collect_list(F.struct("pos", token.alias("t")))).alias("t"))
    lines.select(F.concat_ws(" ", F.col("label").cast("string"), F.col("t.t")).alias("value")).write.mode("overwrite").text(path)


def scan_dense_text(lines: DataFrame, id_col: str, line_col: str, scale: float = 1.0) -> DataFrame:
    """(row_id, label, x) of ``label,v,v,...`` lines, values divided by scale."""
    parts = F.split(F.col(line_col), ",")
    x = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.try_cast("double") / F.lit(float(scale)))
    return lines.select(F.col(id_col).alias("row_id"), parts[0].try_cast("int").alias("label"), x.alias("x"))


def rechunk(values: Column, width: int) -> Column:
    """Rows of the given width from one long array; a short end is left out."""
    n = F.floor(F.size(values) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))


def write_model(params: DataFrame, path: str) -> None:
    """Parameters (fid, w, v ...) of which the weight or a factor is not 0, as a table."""
    params.filter((F.col("w") != 0) | F.exists("v", lambda v: v != 0)).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The inverse of write_model; features left out weigh nothing."""
    return spark.read.parquet(path)


def write_scores(scored: DataFrame, path: str) -> None:
    """One probability a row, with its row."""
    scored.select("row_id", "p").write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str, name: str, value: str) -> None:
    """``name v v v`` lines of embeddings, code words or topic weights; codes and clusters are written the same way."""
    line = F.concat_ws(" ", F.col(name).cast("string"), F.array_join(F.col(value).cast("array<string>"), " "))
    vectors.filter(F.col(name).isNotNull() & F.col(value).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, x ARRAY<DOUBLE>): the inverse of write_vectors. A value that is no number makes its line's vector null."""
    parts = F.split("value", " ")
    x = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.try_cast("double"))
    return spark.read.text(path).select(parts[0].alias("name"), F.when(~F.exists(x, lambda v: v.isNull()), x).alias("x"))


def write_mixture(model: list[tuple], spark: SparkSession, path: str) -> None:
    """(cluster, weight, mu, sigma2) of a mixture as a table."""
    spark.createDataFrame(model, "cluster int, weight double, mu array<double>, sigma2 array<double>").write.mode("overwrite").parquet(path)


def read_mixture(spark: SparkSession, path: str) -> list[tuple]:
    return [(r["cluster"], r["weight"], r["mu"], r["sigma2"]) for r in spark.read.parquet(path).orderBy("cluster").collect()]


def read_vocab(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(wid, word, freq) of ``id word freq`` lines, where a word may hold blanks; ids below most only.

    Raises ValueError where a word is more frequent than the one before it.
    """
    part = lambda i: F.regexp_extract("value", r"^(\d+) (.*) (\d+)$", i)
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\d+ .* \d+$")).select(part(1).cast("int").alias("wid"), part(2).alias("word"), part(3).cast("bigint").alias("freq"))
    rows = rows.filter(F.col("wid") < most) if most is not None else rows
    before = rows.select((F.col("wid") + 1).alias("wid"), F.col("freq").alias("last"))
    if not rows.join(before, "wid").filter("freq > last").isEmpty():
        raise ValueError("frequencies must not increase")
    return rows


def ad_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as ad rows (row_id, label, features): user, hour, k and value buckets as fields 0 to 3; a purchase is a click."""
    e = table(spark, d, "events")
    raw = [
        F.col("user_id") % 100,
        F.hour("ts").cast("bigint"),
        F.get_json_object("props", "$.k").cast("bigint") % 20,
        F.least(F.floor(F.col("value") / 10).cast("bigint"), F.lit(49).cast("bigint")),
    ]
    feats = [F.struct(F.lit(i).alias("pos"), F.lit(i).alias("field"), (v + i * 1000).alias("fid"), F.lit(1.0).alias("val")) for i, v in enumerate(raw)]
    return e.select(F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.array(*feats).alias("features"), "ts")


def ad_long(spark: SparkSession, d: str) -> DataFrame:
    """ad_rows exploded."""
    return ad_rows(spark, d).select("row_id", "label", F.inline("features"))


#: The same in SQL, as a common table expression.
AD_SQL = """ad AS (
  SELECT event_id AS row_id, CAST(event_type = 'purchase' AS INTEGER) AS label, ts, 0 AS field, CAST(user_id % 100 AS BIGINT) AS fid, CAST(1 AS DOUBLE) AS val FROM events
  UNION ALL SELECT event_id, CAST(event_type = 'purchase' AS INTEGER), ts, 1, CAST(hour(ts) + 1000 AS BIGINT), CAST(1 AS DOUBLE) FROM events
  UNION ALL SELECT event_id, CAST(event_type = 'purchase' AS INTEGER), ts, 2, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 + 2000, CAST(1 AS DOUBLE) FROM events
  UNION ALL SELECT event_id, CAST(event_type = 'purchase' AS INTEGER), ts, 3, least(CAST(floor(value / 10) AS BIGINT), 49) + 3000, CAST(1 AS DOUBLE) FROM events)"""


def dense(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as (row_id, label, x ARRAY<DOUBLE>)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


DENSE_SQL = "dense AS (SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def words(spark: SparkSession, d: str) -> DataFrame:
    """documents as (doc_id, pos, word): maximal runs of letters of any script, lower-cased, as the text lies."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("pos", "word"))


WORDS_SQL = r"""raw AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
  words AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM raw))"""
