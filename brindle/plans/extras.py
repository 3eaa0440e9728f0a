"""Decoders, draws, hashes of text, vector forms, ranking windows, liveness states and back-pressure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.functions import vec as V
from brindle.operators import metrics
from brindle.plans.book import Book, mix_sql
from brindle.plans.features import _CDF
from brindle.plans.relational import PUSH_SQL, _VOCAB_SQL, doc_term, pushes
from brindle.session import table
from brindle.sources import ads
from brindle.sources.ads import DENSE_SQL

B = Book()
query = B.query


def _extracts(name: str, code_sql: str, value_sql: str, code, value) -> None:
    """A query that codes every value of embeddings, decodes it and reports the error by code."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        v = ads.dense(spark, d).select(F.explode("x").alias("v")).withColumn("code", code(F.col("v")))
        by = v.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
        return by.select("code", "n", F.round(value(F.col("code")), 5).alias("value"), F.round("mean", 5).alias("mean"))

    q.__name__ = name
    query(f"""WITH RECURSIVE {DENSE_SQL}, c AS (SELECT CAST({code_sql} AS INTEGER) AS code, count(*) AS n, avg(v) AS mean FROM (SELECT unnest(x) AS v FROM dense) GROUP BY 1){value_sql[0]}
      SELECT code, n, round(CAST({value_sql[1]} AS DOUBLE), 5) + 0 AS value, round(mean, 5) + 0 AS mean FROM {value_sql[2]}""")(q)


_extracts("quantile_uniform_extract", "least(greatest(floor((v + 0.6) / 0.0046875), 0), 255)", ("", "-0.6 + (code + 0.5) * 0.0046875", "c"), lambda v: S.uniform_code(v, -0.6, 0.6, 8), lambda c: S.uniform_value(c, -0.6, 0.6, 8))
_SPAN = (math.log(1.0) - math.log(1e-4)) / 127
_extracts(
    "quantile_log_extract",
    f"CASE WHEN v = 0 THEN 0 ELSE sign(v) * (least(greatest(floor((ln(abs(v)) - ({math.log(1e-4)!r})) / {_SPAN!r}), 0), 126) + 1) END",
    ("", f"CASE WHEN code = 0 THEN 0 ELSE sign(code) * exp({math.log(1e-4)!r} + (abs(code) - 0.5) * {_SPAN!r}) END", "c"),
    lambda v: S.log_code(v, 1e-4, 1.0, 8),
    lambda c: S.log_value(c, 1e-4, 1.0, 8),
)
_MID = _CDF.replace("X", "((lo + hi) / 2)")


def _bisect(bits: int) -> str:
    return f""", b(code, lo, hi, k) AS (SELECT code, CAST(-5 AS DOUBLE), CAST(5 AS DOUBLE), 0 FROM c UNION ALL
      SELECT code, CASE WHEN {_MID} < (code + 0.5) / {1 << bits} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_MID} < (code + 0.5) / {1 << bits} THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 40),
      e AS (SELECT c.code, n, mean, (lo + hi) / 2 AS z FROM c JOIN b ON b.code = c.code AND k = 40)"""


for _name, _sigma, _bits in (("quantile_normal_extract", 1.0, 8), ("quantile_custom_extract", 0.125, 4)):
    _extracts(
        _name,
        f"least(floor({_CDF.replace('X', f'(v / {_sigma})')} * {1 << _bits}), {(1 << _bits) - 1})",
        (_bisect(_bits), f"{_sigma} * z", "e"),
        lambda v, s=_sigma, b=_bits: S.normal_code(v, 0.0, s, b),
        lambda c, s=_sigma, b=_bits: S.normal_value(c, 0.0, s, b),
    )


_BYTE = "((x >> (7 * CAST(i AS INTEGER))) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END"


@query(f"""WITH a AS (SELECT event_id, event_id * 65537 AS x, CAST(greatest(1, ceil(ln(event_id * 65537 + 1) / ln(128) - 1e-12)) AS INTEGER) AS n FROM events)
  SELECT event_id, string_agg(upper(printf('%02x', {_BYTE})), '' ORDER BY i) AS bytes, x AS back FROM a, range(0, 9) r(i) WHERE i < n GROUP BY event_id, x""")
def varuint_codec(spark: SparkSession, d: str) -> DataFrame:
    """Integers in base 128 as hexadecimal bytes, and decoded again."""
    e = table(spark, d, "events").select("event_id", S.varuint_encode(F.col("event_id") * 65537).alias("bytes"))
    return e.select("event_id", "bytes", S.varuint_decode(F.col("bytes")).alias("back"))


def text_hash(keys: list[str], seed: int = 97) -> np.ndarray:
    """MurmurHash2 (32 bits) of texts in UTF-8; texts of equal length are hashed together."""
    data = [k.encode() for k in keys]
    out = np.zeros(len(data), np.uint32)
    sizes = np.array([len(b) for b in data])
    m = np.uint32(0x5BD1E995)
    with np.errstate(over="ignore"):
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), size)
            h = np.full(len(at), np.uint32(seed ^ int(size)))
            for word in np.ascontiguousarray(rows[:, : size // 4 * 4]).view("<u4").T:
                w = word * m
                h = (h * m) ^ ((w ^ (w >> np.uint32(24))) * m)
            tail = rows[:, size // 4 * 4 :]
            if tail.shape[1]:
                for i in range(tail.shape[1]):
                    h ^= tail[:, i].astype(np.uint32) << np.uint32(8 * i)
                h *= m
            h = (h ^ (h >> np.uint32(13))) * m
            out[at] = h ^ (h >> np.uint32(15))
    return out


@query(None)
def text_hash_shards(spark: SparkSession, d: str) -> DataFrame:
    """Event types and users hashed as text, as a key router would."""

    @F.pandas_udf("bigint")
    def hashed(v: pd.Series) -> pd.Series:
        return pd.Series(text_hash(v.tolist()).astype(np.int64))

    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return table(spark, d, "events").select(key.alias("key")).distinct().select("key", hashed("key").alias("h"))


_U, _W = mix_sql("event_id * 2"), mix_sql("event_id * 2 + 1")
_R = f"sqrt(-2 * ln({_U} * {2147483646 / 2147483647!r} + {1 / 4294967294!r}))"


@query(f"SELECT event_id, round({mix_sql('event_id')}, 6) AS uniform, round({_R} * cos(2 * pi() * {_W}), 6) + 0 AS a, round({_R} * sin(2 * pi() * {_W}), 6) + 0 AS b, CAST({mix_sql('event_id')} < 0.3 AS INTEGER) AS coin FROM events")
def random_draws(spark: SparkSession, d: str) -> DataFrame:
    """Uniform, two-dimensional normal and Bernoulli draws, fixed by the row's id."""
    a, b = S.draw_normal(F.col("event_id"))
    u = S.hash_mix(F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.round(u, 6).alias("uniform"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), (u < 0.3).cast("int").alias("coin"))


@query(None)
def float16_sum(spark: SparkSession, d: str) -> DataFrame:
    """Each vector plus its reverse in half precision."""

    @F.pandas_udf("array<double>")
    def half(x: pd.Series) -> pd.Series:
        v = np.stack(x.to_numpy()).astype(np.float16) if len(x) else np.empty((0, 1), np.float16)
        return pd.Series(list((v + v[:, ::-1]).astype(np.float64)))

    return ads.dense(spark, d).select("row_id", half("x").alias("v"))


@query(f"WITH {DENSE_SQL}, m AS (SELECT row_id, x, list_sum(list_transform(x, lambda v: abs(v))) / 64 AS m FROM dense) SELECT row_id, CAST(i - 1 AS INTEGER) AS i, round(m * greatest(0, least(1, (x[i] + 1) / 2)), 6) + 0 AS y FROM m, range(1, 65) q(i)")
def binary_sigmoid_vector(spark: SparkSession, d: str) -> DataFrame:
    """The clipped line over a vector, scaled by its mean absolute value."""
    mean = V.total(F.transform("x", lambda v: F.abs(v))) / F.size("x")
    y = F.transform("x", lambda v: S.binary_sigmoid(v))
    return ads.dense(spark, d).select("row_id", mean.alias("m"), F.posexplode(y).alias("i", "y")).select("row_id", "i", F.round(F.col("m") * F.col("y"), 6).alias("y"))


@query(f"WITH {DENSE_SQL}, s AS (SELECT row_id, label, list_transform(x, lambda v: exp(v)) AS e FROM dense), p AS (SELECT row_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM s) SELECT row_id, CAST(i AS INTEGER) AS i, round(p[i + 1] - CAST(i = label AS INTEGER), 6) + 0 AS g FROM p, range(0, 64) q(i)")
def softmax_derivative(spark: SparkSession, d: str) -> DataFrame:
    """Gradient of the softmax loss by logit: probability less the one-hot label."""
    p = V.softmax(F.col("x"), floor=0.0)
    x = ads.dense(spark, d).select("row_id", "label", F.posexplode(p).alias("i", "p"))
    return x.select("row_id", "i", F.round(F.col("p") - (F.col("i") == F.col("label")).cast("double"), 6).alias("g"))


@query(f"WITH {_VOCAB_SQL}, n AS (SELECT doc_id, wid, count(*) AS n FROM words w JOIN vocab v ON w.word = v.word GROUP BY doc_id, wid) SELECT doc_id, {', '.join(f'coalesce(sum(n) FILTER (wid = {w}), 0)::BIGINT AS w{w}' for w in range(20))} FROM n GROUP BY doc_id")
def doc_term_dense(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the twenty leading words, a column each."""
    wide = doc_term(spark, d).groupBy("doc_id").pivot("wid", list(range(20))).agg(F.sum("n"))
    return wide.select("doc_id", *[F.coalesce(F.col(str(w)), F.lit(0)).alias(f"w{w}") for w in range(20)])


_BOOST = """v AS (SELECT event_id, m AS learner, CAST(value > 20 * (m + 1) AS INTEGER) = CAST(event_type = 'purchase' AS INTEGER) AS ok, 1 + event_id % 3 AS w FROM events, range(0, 3) r(m)),
  e AS (SELECT learner, sum(CASE WHEN NOT ok THEN w ELSE 0 END) / sum(w) AS err FROM v GROUP BY learner),
  a AS (SELECT learner, CASE WHEN err < 1e-4 THEN 50 ELSE ln((1 - err) / err) / 2 END AS alpha FROM e),
  m AS (SELECT event_id, v.learner, w * exp(CASE WHEN ok THEN -alpha ELSE alpha END) AS w FROM v JOIN a ON a.learner = v.learner)"""


@query(f"WITH {_BOOST} SELECT event_id, CAST(learner AS INTEGER) AS learner, round(w / sum(w) OVER (PARTITION BY learner) * 10000, 6) AS weight FROM m")
def adaboost_reweight(spark: SparkSession, d: str) -> DataFrame:
    m = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("learner")
    v = table(spark, d, "events").select("event_id", "value", "event_type", m)
    ok = (F.col("value") > 20 * (F.col("learner") + 1)) == (F.col("event_type") == "purchase")
    votes = v.select(F.col("event_id").alias("row_id"), "learner", ok.alias("correct"), (1.0 + F.col("event_id") % 3).alias("weight"))
    out = metrics.adaboost_reweight(votes, metrics.adaboost_round(votes))
    return out.select(F.col("row_id").alias("event_id"), "learner", F.round(F.col("weight") * 10000, 6).alias("weight"))


@query("""SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER v AS quarter, lag(event_id) OVER v AS before, lead(event_id) OVER v AS after
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type), v AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ranking_windows(spark: SparkSession, d: str) -> DataFrame:
    w, v = Window.partitionBy("user_id").orderBy("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = lambda c: c.cast("bigint")
    return table(spark, d, "events").select(
        "event_id", long(F.rank().over(w)).alias("rank"), long(F.dense_rank().over(w)).alias("dense"), long(F.ntile(4).over(v)).alias("quarter"), F.lag("event_id").over(v).alias("before"), F.lead("event_id").over(v).alias("after")
    )


@query(f"""WITH {PUSH_SQL}, p AS (SELECT *, least(max(epoch) FILTER (worker = 0) OVER o, max(epoch) FILTER (worker = 1) OVER o, max(epoch) FILTER (worker = 2) OVER o, max(epoch) FILTER (worker = 3) OVER o) AS slowest FROM pushes WINDOW o AS (ORDER BY arrival))
  SELECT worker, count(*) AS pulls, count(*) FILTER (epoch > slowest + 5) AS held FROM p GROUP BY worker""")
def stale_pulls_held(spark: SparkSession, d: str) -> DataFrame:
    """Bounded staleness: pulls that get nothing because their worker is over five epochs ahead of the slowest one's newest
    epoch so far. Running maxima are taken in blocks of arrivals and over the blocks' maxima."""
    p = pushes(spark, d).withColumn("block", F.floor(F.col("arrival") / 10000))
    newest = [F.max(F.when(F.col("worker") == w, F.col("epoch"))).alias(f"m{w}") for w in range(4)]
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = p.groupBy("block").agg(*newest)
    tops = tops.select("block", *[F.max(f"m{w}").over(before).alias(f"b{w}") for w in range(4)])
    inside = Window.partitionBy("block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    so_far = [F.greatest(F.max(F.when(F.col("worker") == w, F.col("epoch"))).over(inside), f"b{w}") for w in range(4)]
    seen = p.join(tops, "block").withColumn("slowest", F.least(*so_far))
    return seen.groupBy("worker").agg(F.count(F.lit(1)).alias("pulls"), F.count_if(F.col("epoch") > F.col("slowest") + 5).alias("held"))


@query("""WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, (SELECT max(ts) FROM events) AS now FROM events)
  SELECT user_id AS node, ts AS since, CASE WHEN coalesce(next, now) - ts >= INTERVAL 20 HOUR THEN 'dead' ELSE 'suspect' END AS state, next IS NOT NULL AS came_back FROM g WHERE coalesce(next, now) - ts >= INTERVAL 10 HOUR""")
def heartbeat_states(spark: SparkSession, d: str) -> DataFrame:
    """Silences of nodes: suspect from ten hours on, dead from twenty, and whether a beat followed."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = e.select("user_id", "ts", after.alias("after"))
    hours = (F.unix_micros(F.coalesce("after", F.lit(now)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    state = F.when(hours >= 20, "dead").otherwise("suspect")
    return g.filter(hours >= 10).select(F.col("user_id").alias("node"), F.col("ts").alias("since"), state.alias("state"), F.col("after").isNotNull().alias("came_back"))
