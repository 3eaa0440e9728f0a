"""Scans, projections, filters and scalar functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.functions import vec as V
from brindle.plans.book import Book, mix_sql
from brindle.session import table
from brindle.sources import ads
from brindle.sources.ads import AD_SQL, DENSE_SQL, WORDS_SQL

B = Book()
query = B.query

_LINES = "lines AS (SELECT row_id, CAST(min(label) AS VARCHAR) || ' ' || string_agg(field || ':' || fid || ':1', ' ' ORDER BY field) AS line FROM ad GROUP BY row_id)"


def _ad_lines(spark: SparkSession, d: str) -> DataFrame:
    token = lambda f: F.concat_ws(":", f["field"].cast("string"), f["fid"].cast("string"), F.lit("1"))
    return ads.ad_rows(spark, d).select("row_id", F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("features", token), " ")).alias("line"))


@query(f"""WITH {AD_SQL}, {_LINES}, t AS (SELECT row_id, CAST(split_part(line, ' ', 1) AS INTEGER) AS label, i, split_part(line, ' ', i + 2) AS tok FROM lines, range(0, 4) r(i))
  SELECT row_id, label, CAST(i AS INTEGER) AS pos, CAST(split_part(tok, ':', 1) AS INTEGER) AS field, CAST(split_part(tok, ':', 2) AS BIGINT) AS fid, CAST(split_part(tok, ':', 3) AS DOUBLE) AS val FROM t""")
def scan_libffm(spark: SparkSession, d: str) -> DataFrame:
    return ads.scan_sparse_text(_ad_lines(spark, d), "row_id", "line")


@query(f"""WITH {DENSE_SQL} SELECT row_id, CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS INTEGER) AS label, CAST(i AS INTEGER) AS fid, round(x[i], 6) AS val
  FROM dense, range(1, 65) r(i) WHERE abs(x[i]) >= 0.02""")
def scan_dense_csv(spark: SparkSession, d: str) -> DataFrame:
    """Dense lines to sparse rows: features count from 1, small values are missing, the label in two classes."""
    lines = ads.dense(spark, d).select("row_id", F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")).alias("line"))
    parsed = ads.scan_dense_text(lines, "row_id", "line")
    out = parsed.select("row_id", F.when(F.col("label") < 5, 0).otherwise(1).alias("label"), F.posexplode("x").alias("i", "v"))
    return out.filter(F.abs("v") >= 0.02).select("row_id", "label", (F.col("i") + 1).alias("fid"), F.round("v", 6).alias("val"))


@query(f"WITH {DENSE_SQL} SELECT row_id, label, CAST(i AS INTEGER) AS i, round(x[i] / 255, 6) + 0 AS val FROM dense, range(1, 65) r(i)")
def scan_dense_scaled(spark: SparkSession, d: str) -> DataFrame:
    x = V.scale(F.col("x"), 1 / 255)
    return ads.dense(spark, d).select("row_id", "label", F.posexplode(x).alias("p", "v")).select("row_id", "label", (F.col("p") + 1).alias("i"), F.round("v", 6).alias("val"))


@query(f"WITH {DENSE_SQL} SELECT row_id, CAST(c AS INTEGER) AS chunk, round(x[c * 10 + 1], 6) AS first, round(x[c * 10 + 10], 6) AS last FROM dense, range(0, 6) r(c)")
def scan_rechunk(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.dense(spark, d).select("row_id", F.posexplode(ads.rechunk(F.col("x"), 10)).alias("chunk", "r"))
    return rows.select("row_id", "chunk", F.round(F.get("r", F.lit(0)), 6).alias("first"), F.round(F.get("r", F.lit(9)), 6).alias("last"))


@query("""SELECT n_nationkey AS wid, lower(n_name) AS word, CAST(n_regionkey + 1 AS BIGINT) AS freq FROM nation""")
def scan_vocab(spark: SparkSession, d: str) -> DataFrame:
    """``id word freq`` lines, where a word may hold blanks."""
    lines = table(spark, d, "nation").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.lower("n_name"), (F.col("n_regionkey") + 1).cast("string")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^(\d+) (.*) (\d+)$", i)
    return lines.select(part(1).cast("int").alias("wid"), part(2).alias("word"), part(3).cast("bigint").alias("freq"))


@query(f"SELECT shard, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CAST(floor(4 * {mix_sql('event_id')}) AS INTEGER) AS shard FROM events) GROUP BY shard")
def random_split_hash(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.floor(4 * S.hash_mix(F.col("event_id"))).cast("int").alias("shard"))
    return e.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, pos, word FROM words")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return ads.words(spark, d)


@query(f"WITH {AD_SQL} SELECT row_id, label, field, fid, val FROM ad")
def feature_explode(spark: SparkSession, d: str) -> DataFrame:
    return ads.ad_long(spark, d).select("row_id", "label", "field", "fid", "val")


@query("SELECT vec_id AS row_id, CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS INTEGER) AS label FROM embeddings")
def label_binarize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.when(F.col("label") < 5, 0).otherwise(1).alias("label"))


@query("SELECT vec_id AS row_id, CAST(i AS INTEGER) AS cls, CAST(i = label AS INTEGER) AS hot FROM embeddings, range(0, 10) r(i)")
def onehot_label(spark: SparkSession, d: str) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode(hot).alias("cls", "hot"))


@query(f"WITH {DENSE_SQL} SELECT row_id, count(*) AS present, round(sum(x[i]), 4) AS total FROM dense, range(1, 65) r(i) WHERE abs(x[i]) >= 0.02 GROUP BY row_id")
def zero_as_missing(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("x", lambda v: F.abs(v) >= 0.02)
    return ads.dense(spark, d).select("row_id", F.size(kept).cast("bigint").alias("present"), F.round(V.total(kept), 4).alias("total")).filter("present > 0")


@query("SELECT event_id, value FROM events WHERE isfinite(value) AND abs(value) > 1e-7 AND abs(value) < 15")
def preferred_value_filter(spark: SparkSession, d: str) -> DataFrame:
    v = F.abs("value")
    return table(spark, d, "events").filter(~F.isnan("value") & (v > 1e-7) & (v < 15)).select("event_id", "value")


@query("""SELECT row_id, field, fid FROM (SELECT row_id, field, fid, row_number() OVER (PARTITION BY row_id, field ORDER BY pos, fid, val, arrived_at) AS r
  FROM sparse_long WHERE field IS NOT NULL AND fid IS NOT NULL) WHERE r = 1""")
def first_per_field(spark: SparkSession, d: str) -> DataFrame:
    """The first feature of each field of a record; min_by over the order, so no window is sorted."""
    rows = table(spark, d, "sparse_long").filter("field IS NOT NULL AND fid IS NOT NULL")
    first = F.min(F.struct("pos", "fid")).alias("m")
    return rows.groupBy("row_id", "field").agg(first).select("row_id", "field", F.col("m.fid").alias("fid"))


#: Words without a subject of their own, in the four languages of the texts (fixed values).
_STOP = (
    "the a an of to in and is it you that for on with we he she they be are "
    "le la les un une des du de et est il elle vous que pour sur avec nous ils pas "
    "der die das ein eine und ist es du ich wir sie ihr nicht mit auf von zu den "
    "el los las una y en que por con no se al lo su del"
).split()
_STOP = sorted(set(_STOP))


@query(f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS kept FROM words WHERE word NOT IN ({', '.join(repr(w) for w in _STOP)}) AND length(word) > 1 GROUP BY doc_id")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = ads.words(spark, d).filter(~F.col("word").isin(_STOP) & (F.length("word") > 1))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {WORDS_SQL}, f AS (SELECT word, count(*) AS f FROM words GROUP BY word), n AS (SELECT count(*) AS n FROM words),
  k AS (SELECT doc_id, w.word, {mix_sql('doc_id * 1009 + pos')} AS u, (sqrt(f / (0.0001 * n)) + 1) * (0.0001 * n) / f AS keep FROM words w JOIN f ON w.word = f.word, n)
  SELECT word, count(*) AS n FROM k WHERE u <= keep GROUP BY word""")
def subsample_words(spark: SparkSession, d: str) -> DataFrame:
    """Frequent words kept with probability (sqrt(f / tN) + 1) tN / f, drawn from the place of each."""
    w = ads.words(spark, d)
    freq = w.groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    total = freq.agg(F.sum("f")).first()[0] or 0
    t = F.lit(0.0001 * total)
    keep = (F.sqrt(F.col("f") / t) + 1) * t / F.col("f")
    drawn = w.join(freq, "word").filter(S.hash_mix(F.col("doc_id") * 1009 + F.col("pos")) <= keep)
    return drawn.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, count(*) AS n, round(sum(greatest(least(l_extendedprice / 1000 - 30, 15), -15)), 2) AS g FROM lineitem GROUP BY l_linestatus")
def grad_clip(spark: SparkSession, d: str) -> DataFrame:
    g = S.clip(F.col("l_extendedprice") / 1000 - 30)
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(g), 2).alias("g"))


@query("SELECT event_id, round(sign(value - 50) * greatest(abs(value - 50) - 5, 0), 6) + 0 AS g FROM events")
def soft_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(S.soft_threshold(F.col("value") - 50, 5), 6).alias("g"))


@query(f"WITH {DENSE_SQL} SELECT row_id, 128 AS n, round(x[1] + 2 * x[64], 6) AS ends FROM dense")
def flatten_maps(spark: SparkSession, d: str) -> DataFrame:
    flat = F.flatten(F.array(F.col("x"), V.scale(F.col("x"), 2)))
    return ads.dense(spark, d).select("row_id", F.size(flat).alias("n"), F.round(F.get(flat, F.lit(0)) + F.get(flat, F.lit(127)), 6).alias("ends"))


# ---- activations, losses, statistics

_X = "(value - 50) / 10"


def _scalar(name: str, sql: str, f) -> None:
    """A query that applies one function to events.value, centred and scaled."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        x = (F.col("value") - 50) / 10
        return table(spark, d, "events").select("event_id", F.round(f(x), 6).alias("y"))

    q.__name__ = name
    query(f"SELECT event_id, round({sql.replace('X', '(' + _X + ')')}, 6) + 0 AS y FROM events")(q)


_SIG = "CASE WHEN X < -16 THEN 1e-7 WHEN X > 16 THEN 1 - 1e-7 ELSE 1 / (1 + exp(-(X))) END"
_ERF = f"sign(X) * sqrt(1 - exp(-(X) * (X) * ({4 / math.pi!r} + 0.140012 * (X) * (X)) / (1 + 0.140012 * (X) * (X))))"
_ERF2 = _ERF.replace("X", f"(X / {math.sqrt(2)!r})")
_CDF = f"((1 + {_ERF2}) / 2)"
_scalar("act_sigmoid", _SIG, S.sigmoid)
_scalar("act_tanh", "(exp(2 * least(X, 20)) - 1) / (exp(2 * least(X, 20)) + 1)", F.tanh)
_scalar("act_relu", "greatest(X, 0)", S.relu)
_scalar("act_softplus", "CASE WHEN X > 30 THEN X ELSE ln(1 + exp(least(X, 30))) END", S.softplus)
_scalar("act_identity", "X", lambda x: x)
_scalar("act_binary_sigmoid", "greatest(0, least(1, (X + 1) / 2))", S.binary_sigmoid)
_scalar("erf_approx", _ERF, S.erf)
_scalar("normal_cdf", _CDF, S.normal_cdf)
_scalar("log_cdf", f"ln({_CDF})", S.log_cdf)
_scalar("gaussian_significance", f"2 * {_CDF} - 1", S.significance)


@query(f"""WITH v AS (SELECT event_id, {_SIG.replace('X', '(' + _X + ')')} AS s, greatest({_X}, 0) AS r, ln(1 + exp(least({_X}, 30))) AS sp,
    (exp(2 * least({_X}, 20)) - 1) / (exp(2 * least({_X}, 20)) + 1) AS t FROM events)
  SELECT event_id, round(s * (1 - s), 6) AS d_sigmoid, round(1 - t * t, 6) AS d_tanh, CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS d_relu, round(1 - exp(-sp), 6) AS d_softplus FROM v""")
def act_derivatives(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("value") - 50) / 10
    return table(spark, d, "events").select(
        "event_id",
        F.round(S.d_sigmoid(S.sigmoid(x)), 6).alias("d_sigmoid"),
        F.round(S.d_tanh(F.tanh(x)), 6).alias("d_tanh"),
        S.d_relu(S.relu(x)).alias("d_relu"),
        F.round(S.d_softplus(F.log1p(F.exp(F.least(x, F.lit(30.0))))), 6).alias("d_softplus"),
    )


@query(f"SELECT event_type, count(*) AS n, round(sum(power(s - l, 2) / 2), 4) AS loss FROM (SELECT event_type, {_SIG.replace('X', '(' + _X + ')')} AS s, CAST(event_type = 'purchase' AS INTEGER) AS l FROM events) GROUP BY event_type")
def loss_square(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    loss = S.square_loss(S.sigmoid((F.col("value") - 50) / 10), (F.col("event_type") == "purchase").cast("double"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(loss), 4).alias("loss"))


@query(f"SELECT event_type, round(sum(greatest(x, 0) - x * l + ln(1 + exp(-abs(x)))), 4) AS loss FROM (SELECT event_type, {_X} AS x, CAST(event_type = 'purchase' AS INTEGER) AS l FROM events) GROUP BY event_type")
def loss_logistic(spark: SparkSession, d: str) -> DataFrame:
    loss = S.logistic_nll((F.col("value") - 50) / 10, (F.col("event_type") == "purchase").cast("double"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(loss), 4).alias("loss"))


@query(f"""WITH {DENSE_SQL}, e AS (SELECT label, list_transform(range(0, 10), lambda c: list_sum(list_transform(range(0, 7), lambda m: coalesce(x[m * 10 + c + 1], 0)))) AS x FROM dense), s AS (SELECT label, exp(x[label + 1]) / list_sum(list_transform(x, lambda v: exp(v))) AS p FROM e)
  SELECT label, count(*) AS n, round(sum(-ln(p)), 4) AS loss FROM s GROUP BY label""")
def loss_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Ten logits, each the sum of every tenth value."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: V.total(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda m: F.coalesce(F.get("x", m * 10 + c), F.lit(0.0)))))
    p = F.element_at(V.softmax(logits), F.col("label") + 1)
    return ads.dense(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(-F.log(p)), 4).alias("loss"))


_HALVE = f"""WITH RECURSIVE b(p, lo, hi, n) AS (SELECT p, CAST(-5 AS DOUBLE), CAST(5 AS DOUBLE), 0 FROM g
    UNION ALL SELECT p, CASE WHEN {_CDF.replace('X', '((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_CDF.replace('X', '((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM b WHERE n < 40),
  q AS (SELECT p, (lo + hi) / 2 AS x FROM b WHERE n = 40)"""


@query(f"""{_HALVE.replace('WITH RECURSIVE ', "WITH RECURSIVE g(p) AS (SELECT i / 100 FROM range(1, 100) r(i)), ")} SELECT p, round(x, 5) + 0 AS x, round({_CDF.replace('X', 'x')}, 5) AS back FROM q""")
def inverse_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Round trip of the quantile: |CDF(quantile(p)) - p| stays under 1e-6 (checked in tests)."""
    p = spark.range(1, 100).select((F.col("id") / 100.0).alias("p"))
    x = S.inverse_cdf(F.col("p"))
    return p.select("p", F.round(x, 5).alias("x"), F.round(S.normal_cdf(x), 5).alias("back"))


@query(f"""{_HALVE.replace('WITH RECURSIVE ', "WITH RECURSIVE c(confidence, error) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM (VALUES (0.9), (0.95), (0.99)) x(a), (VALUES (0.01), (0.05)) y(b)), g(p) AS (SELECT DISTINCT (confidence + 1) / 2 FROM c), ")} SELECT confidence, error, CAST(ceil(x * x / (4 * error * error)) AS BIGINT) AS n FROM c JOIN q ON q.p = (confidence + 1) / 2""")
def subsample_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows to draw for a share's error e at confidence c: (z / 2e)^2 with z the quantile of (1 + c) / 2."""
    grid = spark.createDataFrame([(c, e) for c in (0.9, 0.95, 0.99) for e in (0.01, 0.05)], "confidence double, error double")
    z = S.inverse_cdf((F.col("confidence") + 1) / 2)
    return grid.select("confidence", "error", F.ceil(z * z / (4 * F.col("error") * F.col("error"))).alias("n"))


def _codes(name: str, sql: str, f) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        x = F.explode("x").alias("v")
        return ads.dense(spark, d).select(x).groupBy(f(F.col("v")).alias("code")).agg(F.count(F.lit(1)).alias("n"))

    q.__name__ = name
    query(f"WITH {DENSE_SQL} SELECT code, count(*) AS n FROM (SELECT CAST({sql} AS INTEGER) AS code FROM (SELECT unnest(x) AS v FROM dense)) GROUP BY code")(q)


def _cdf_sql(x: str, mu: float, sigma: float) -> str:
    return _CDF.replace("X", f"(({x} - {mu}) / {sigma})")


_codes("quantile_uniform", "least(greatest(floor((v + 0.6) / 0.0046875), 0), 255)", lambda v: S.uniform_code(v, -0.6, 0.6, 8))
_log = (math.log(1.0) - math.log(1e-4)) / 127
_codes(
    "quantile_log",
    f"CASE WHEN v = 0 THEN 0 ELSE sign(v) * (least(greatest(floor((ln(abs(v)) - ({math.log(1e-4)!r})) / {_log!r}), 0), 126) + 1) END",
    lambda v: S.log_code(v, 1e-4, 1.0, 8),
)
_codes("quantile_normal", f"least(floor({_cdf_sql('v', 0.0, 1.0)} * 256), 255)", lambda v: S.normal_code(v, 0.0, 1.0, 8))
_codes("quantile_custom", f"least(floor({_cdf_sql('v', 0.0, 0.125)} * 16), 15)", lambda v: S.normal_code(v, 0.0, 0.125, 4))


@query(f"""WITH {DENSE_SQL}, v AS (SELECT row_id, unnest(x) AS v FROM dense)
  SELECT row_id, round(sum(CASE WHEN v >= 0 THEN 1.0 / 3 ELSE -1.0 / 3 END), 4) + 0 AS one, round(CAST(sum(sign(v) * CASE WHEN abs(v) < 0.5 THEN 0.25 ELSE 0.75 END) AS DOUBLE), 4) + 0 AS two FROM v GROUP BY row_id""")
def lowbit_quantize(spark: SparkSession, d: str) -> DataFrame:
    one, two = V.total(F.transform("x", lambda v: S.lowbit(v, 1))), V.total(F.transform("x", lambda v: S.lowbit(v, 2)))
    return ads.dense(spark, d).select("row_id", F.round(one, 4).alias("one"), F.round(two, 4).alias("two"))


@query("SELECT event_id, CAST(greatest(1, ceil(ln(event_id * 65537 + 1) / ln(128) - 1e-12)) AS INTEGER) AS bytes FROM events WHERE event_id * 65537 < 4398046511104")
def varuint_length(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("event_id") * 65537
    return table(spark, d, "events").select("event_id", S.varuint_length(x).alias("bytes"))


#: Half precision of v > 0 below 65520: mantissas of 2^(e - 10), to nearest even.
_HALF = "least(greatest(floor(log2(abs(v))), -14), 15)"


@query(f"""WITH a AS (SELECT event_id, value AS v, CASE WHEN value = 0 THEN -14 ELSE {_HALF.replace('v', 'value')} END AS e FROM events),
  b AS (SELECT event_id, v, e, round_even(abs(v) / power(2, e - 10), 0) AS m FROM a),
  c AS (SELECT event_id, v, CASE WHEN m >= 2048 THEN e + 1 ELSE e END AS e, CASE WHEN m >= 2048 THEN 1024 ELSE m END AS m FROM b)
  SELECT event_id, v AS value, CAST((CASE WHEN v < 0 THEN 32768 ELSE 0 END) + CASE WHEN m < 1024 THEN m ELSE (e + 15) * 1024 + m - 1024 END AS INTEGER) AS bits, sign(v) * m * power(2, e - 10) + 0 AS back FROM c""")
def float16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Values through IEEE half precision, to nearest even, with their 16 bits."""

    @F.pandas_udf("struct<bits:int,back:double>")
    def half(v: pd.Series) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            h = v.to_numpy(dtype=np.float64, na_value=np.nan).astype(np.float16)
        return pd.DataFrame({"bits": h.view(np.uint16).astype(np.int32), "back": h.astype(np.float64)})

    return table(spark, d, "events").select("event_id", "value", half("value").alias("h")).select("event_id", "value", "h.bits", "h.back")


def _mul(z: str, k: int) -> str:
    """The lower 64 bits of a product of 64-bit numbers, from halves of the constant that don't overflow 128 bits."""
    low, high = k & 0xFFFFFFFF, k >> 32
    wrap = "18446744073709551616"
    return f"((({z}) * {low} + ((({z}) * {high}) % {wrap}) * 4294967296) % {wrap})"


@query(f"""WITH a AS (SELECT event_id, CAST(event_id AS HUGEINT) AS z FROM events), b AS (SELECT event_id, {_mul('xor(z, z >> 33)', 0xFF51AFD7ED558CCD)} AS z FROM a),
  c AS (SELECT event_id, {_mul('xor(z, z >> 33)', 0xC4CEB9FE1A85EC53)} AS z FROM b) SELECT event_id, CAST(xor(z, z >> 33) % 4294967296 AS BIGINT) AS h FROM c""")
def murmur_hash(spark: SparkSession, d: str) -> DataFrame:
    """The 64-bit finaliser of MurmurHash3, lower 32 bits."""

    @F.pandas_udf("bigint")
    def fmix(v: pd.Series) -> pd.Series:
        z = v.to_numpy(dtype=np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                z = (z ^ (z >> np.uint64(33))) * np.uint64(k)
            z ^= z >> np.uint64(33)
        return pd.Series((z & np.uint64(0xFFFFFFFF)).astype(np.int64))

    return table(spark, d, "events").select("event_id", fmix("event_id").alias("h"))


# ---- array algebra over embeddings: each vector with itself reversed


def _vector(name: str, sql: str, f) -> None:
    """sql gives the list from lists x and y."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        x, y = F.col("x"), F.reverse("x")
        return ads.dense(spark, d).select("row_id", F.posexplode(f(x, y)).alias("i", "v")).select("row_id", "i", F.round("v", 6).alias("v"))

    q.__name__ = name
    query(f"""WITH {DENSE_SQL}, r AS (SELECT row_id, x, list_reverse(x) AS y FROM dense), o AS (SELECT row_id, {sql} AS o FROM r)
      SELECT row_id, CAST(i - 1 AS INTEGER) AS i, round(o[i], 6) AS v FROM o, range(1, 65) q(i)""")(q)


_zip = lambda e: f"list_transform(range(1, 65), lambda i: {e})"
_vector("vec_add", _zip("x[i] + y[i]"), V.add)
_vector("vec_scale", _zip("x[i] * 2.5"), lambda x, y: V.scale(x, 2.5))
_vector("vec_fma", _zip("x[i] + y[i] * 0.5"), lambda x, y: V.fma(x, y, 0.5))
_vector("vec_sqrt", _zip("sqrt(abs(x[i]))"), lambda x, y: V.sqrt_abs(x))
_vector("vec_rcp", _zip("CASE WHEN x[i] + 2 = 0 THEN NULL ELSE 1 / (x[i] + 2) END"), lambda x, y: V.reciprocal(F.transform(x, lambda v: v + 2)))
_vector("vec_div", _zip("x[i] / (y[i] + 2)"), lambda x, y: V.divide(x, F.transform(y, lambda v: v + 2)))
_vector("mat_transpose", _zip("x[((i - 1) % 8) * 8 + CAST(floor((i - 1) / 8) AS BIGINT) + 1]"), lambda x, y: V.transpose(x, 8, 8))
_vector("mat_hadamard", _zip("x[i] * y[i]"), V.hadamard)
_vector("mat_rot180", _zip("x[65 - i]"), lambda x, y: V.rot180(x))


def _reduced(name: str, sql: str, f) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return ads.dense(spark, d).select("row_id", F.round(f(F.col("x"), F.reverse("x")), 6).alias("v"))

    q.__name__ = name
    query(f"WITH {DENSE_SQL}, r AS (SELECT row_id, x, list_reverse(x) AS y FROM dense) SELECT row_id, round({sql}, 6) AS v FROM r")(q)


_sum = lambda e: f"list_sum({_zip(e)})"
_reduced("dot_product", _sum("x[i] * y[i]"), V.dot)
_reduced("l2_norm_sq", _sum("x[i] * x[i]"), lambda x, y: V.l2_norm_sq(x))
_reduced("l1_sum", _sum("x[i]"), lambda x, y: V.l1_sum(x))
_reduced("l2_distance_sq", _sum("(x[i] - y[i]) * (x[i] - y[i])"), V.l2_distance_sq)
_reduced("logsumexp", f"list_max(x) + ln({_sum('exp(x[i] - list_max(x))')})", lambda x, y: V.logsumexp(x))


@query(f"WITH {DENSE_SQL} SELECT row_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS cls FROM dense")
def argmax_class(spark: SparkSession, d: str) -> DataFrame:
    return ads.dense(spark, d).select("row_id", V.argmax(F.col("x")).alias("cls"))


@query(f"WITH {DENSE_SQL}, s AS (SELECT row_id, x, list_sum(list_transform(x, lambda v: exp(v / 0.5))) AS s FROM dense) SELECT row_id, CAST(i AS INTEGER) AS i, round(exp(x[i] / 0.5) / s, 6) AS p FROM s, range(1, 65) r(i)")
def softmax_over_group(spark: SparkSession, d: str) -> DataFrame:
    return ads.dense(spark, d).select("row_id", F.posexplode(V.softmax(F.col("x"), 0.5)).alias("p0", "p")).select("row_id", (F.col("p0") + 1).alias("i"), F.round("p", 6).alias("p"))
