"""Models: one deterministic step of each with its SQL twin, and the full trainers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import optim
from brindle.functions import scalar as S
from brindle.functions import vec as V
from brindle.operators import boosting, deep, embedding, factorization, forest, graph, mixtures, nets
from brindle.plans.book import Book, mix_sql, unit_sql
from brindle.plans.relational import doc_term, vocab
from brindle.session import shared_dir, table, written
from brindle.sources import ads
from brindle.sources.ads import AD_SQL, DENSE_SQL, WORDS_SQL
from brindle.streaming import online

B = Book()
query = B.query
K = 4


def _u(n: int) -> float:
    return ((n * 1103515245 + 12345) % 2147483648) / 2147483648


def _lists(x: np.ndarray) -> str:
    """A list literal of SQL."""
    return "[" + ", ".join(_lists(v) if getattr(v, "ndim", 0) else f"CAST({float(v)!r} AS DOUBLE)" for v in x) + "]"


def _arr(x: np.ndarray) -> Column:
    return F.array(*[_arr(v) if getattr(v, "ndim", 0) else F.lit(float(v)) for v in x])


# ---- factorization machines

_V = [f"({unit_sql(f'fid + {100000 * (f + 1)}')} - 0.5) / 2" for f in range(K)]
_FM_SQL = f"""{AD_SQL}, par AS (SELECT *, {unit_sql('fid')} - 0.5 AS w, {', '.join(f'{v} AS v{f}' for f, v in enumerate(_V))} FROM ad),
  row AS (SELECT row_id, label, any_value(ts) AS ts, sum(w * val) AS wx, {', '.join(f'sum(v{f} * val) AS s{f}, sum(power(v{f} * val, 2)) AS q{f}' for f in range(K))} FROM par GROUP BY row_id, label),
  fm AS (SELECT row_id, label, ts, {', '.join(f's{f}' for f in range(K))}, wx + ({' + '.join(f's{f} * s{f} - q{f}' for f in range(K))}) / 2 AS z, 1 / (1 + exp(-(wx + ({' + '.join(f's{f} * s{f} - q{f}' for f in range(K))}) / 2))) AS p FROM row)"""


@query(f"WITH {_FM_SQL} SELECT row_id, label, round(z, 4) + 0 AS logit, round(p, 4) AS p FROM fm")
def fm_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.ad_long(spark, d)
    out = factorization.forward(rows, factorization.initial(rows, K), K)
    return out.select("row_id", "label", F.round("logit", 4).alias("logit"), F.round("p", 4).alias("p"))


@query(f"WITH {_FM_SQL} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS logloss, round(avg(p), 4) AS p FROM fm GROUP BY 1")
def fm_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: scan, explode, parameter join, row sums, score, log-loss and mean click probability by hour."""
    rows = ads.ad_long(spark, d)
    out = factorization.forward(rows, factorization.initial(rows, K), K)
    hours = ads.ad_rows(spark, d).select("row_id", F.hour("ts").alias("hour"))
    by = out.join(hours, "row_id").groupBy("hour")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.log_loss(F.col("p"), F.col("label"))), 4).alias("logloss"), F.round(F.avg("p"), 4).alias("p"))


_G_SQL = f"{_FM_SQL}, n AS (SELECT count(*) AS n FROM row), g AS (SELECT fid, sum((p - a.label) * val + 0.001 * w) AS gw, {', '.join(f'sum((p - a.label) * val * (s{f} - v{f} * val) + 0.001 * v{f}) AS g{f}' for f in range(K))} FROM par a JOIN fm ON fm.row_id = a.row_id GROUP BY fid), m AS (SELECT fid, gw / n AS gw, {', '.join(f'g{f} / n AS g{f}' for f in range(K))} FROM g, n)"


@query(f"WITH {_G_SQL} SELECT fid, round({unit_sql('fid')} - 0.5 - 0.1 * gw / sqrt(gw * gw + 1e-7), 4) + 0 AS w, {', '.join(f'round({v} - 0.1 * g{f} / sqrt(g{f} * g{f} + 1e-7), 4) + 0 AS v{f}' for f, v in enumerate(_V))} FROM m")
def fm_step(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.ad_long(spark, d)
    p0 = factorization.initial(rows, K)
    n = rows.select("row_id").distinct().count()
    out = factorization.step(p0, factorization.gradients(rows, p0, K), K, 0.1, n)
    return out.select("fid", F.round("w", 4).alias("w"), *[F.round(F.col("v")[f], 4).alias(f"v{f}") for f in range(K)])


@query(f"""WITH {AD_SQL}, par AS (SELECT *, {unit_sql('fid')} - 0.5 AS w FROM ad), s AS (SELECT row_id, 1 / (1 + exp(-sum(w * val))) AS p FROM par GROUP BY row_id), n AS (SELECT count(*) AS n FROM s),
  g AS (SELECT fid, any_value(w) AS w, sum((p - label) * val + 0.001 * w) / any_value(n) AS g FROM par a JOIN s ON s.row_id = a.row_id, n GROUP BY fid) SELECT fid, round(w - 0.1 * g / sqrt(g * g + 1e-7), 4) + 0 AS w FROM g""")
def lr_step(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.ad_long(spark, d)
    p0 = factorization.initial(rows, 1).withColumn("v", F.array().cast("array<double>")).withColumn("acc_v", F.array().cast("array<double>"))
    n = rows.select("row_id").distinct().count()
    return factorization.step(p0, factorization.gradients(rows, p0, 0), 0, 0.1, n).select("fid", F.round("w", 4).alias("w"))


_FV = lambda fid, field, f: f"({unit_sql(f'{fid} + 10000 * ({field} + 1) + {1000000 * (f + 1)}')} - 0.5) / 2"
_FFM_SQL = f"""{AD_SQL}, pr AS (SELECT a.row_id, a.label, a.field AS fi, a.fid AS i, b.field AS fj, b.fid AS j, a.val * b.val AS xx, {', '.join(f"{_FV('a.fid', 'b.field', f)} AS a{f}, {_FV('b.fid', 'a.field', f)} AS b{f}" for f in range(K))}
    FROM ad a JOIN ad b ON a.row_id = b.row_id AND a.field < b.field), fz AS (SELECT row_id, label, sum(({' + '.join(f'a{f} * b{f}' for f in range(K))}) * xx) AS z FROM pr GROUP BY row_id, label)"""


@query(f"WITH {_FFM_SQL} SELECT row_id, label, round(z, 4) + 0 AS logit, round(1 / (1 + exp(-z)), 4) AS p FROM fz")
def ffm_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.ad_long(spark, d)
    out = factorization.ffm_forward(factorization.row_pairs(rows), factorization.ffm_initial(rows, K), K)
    return out.select("row_id", "label", F.round("logit", 4).alias("logit"), F.round("p", 4).alias("p"))


@query(f"""WITH {_FFM_SQL}, n AS (SELECT count(*) AS n FROM fz), e AS (SELECT pr.*, (1 / (1 + exp(-z)) - pr.label) * xx AS e FROM pr JOIN fz ON fz.row_id = pr.row_id),
  o AS (SELECT i AS fid, fj AS field, {', '.join(f'e * b{f} + 0.001 * a{f} AS g{f}' for f in range(K))} FROM e UNION ALL SELECT j, fi, {', '.join(f'e * a{f} + 0.001 * b{f}' for f in range(K))} FROM e),
  g AS (SELECT fid, field, {', '.join(f'sum(g{f}) AS g{f}' for f in range(K))} FROM o GROUP BY fid, field)
  SELECT fid, field, {', '.join(f"round({_FV('fid', 'field', f)} - 50 * g{f} / n, 4) + 0 AS v{f}" for f in range(K))} FROM g, n""")
def ffm_step(spark: SparkSession, d: str) -> DataFrame:
    rows = ads.ad_long(spark, d)
    out = factorization.ffm_step(factorization.row_pairs(rows), factorization.ffm_initial(rows, K), K, 50.0)
    own = out.filter(F.floor(F.col("fid") / 1000) != F.col("field"))
    return own.select("fid", "field", *[F.round(F.col("v")[f], 4).alias(f"v{f}") for f in range(K)])


_W1 = np.array([[_u(7000000 + i * 100 + j) - 0.5 for i in range(K)] for j in range(8)])
_W2 = np.array([_u(7100000 + j) - 0.5 for j in range(8)])


@query(f"""WITH {_FM_SQL}, b AS (SELECT row_id, wx, [{', '.join(f'(s{f} * s{f} - q{f}) / 2' for f in range(K))}] AS b FROM row), h AS (SELECT row_id, wx, list_transform({_lists(_W1)}, lambda w: 1 / (1 + exp(-({' + '.join(f'w[{f + 1}] * b[{f + 1}]' for f in range(K))})))) AS h FROM b)
  SELECT row_id, round(1 / (1 + exp(-(wx + {' + '.join(f'({float(_W2[j])!r}) * h[{j + 1}]' for j in range(8))}))), 4) AS p FROM h""")
def nfm_forward(spark: SparkSession, d: str) -> DataFrame:
    """Linear part plus a dense net over the bi-interaction vector; the net's weights are constants of the plan."""
    rows = ads.ad_long(spark, d)
    deep = V.total(V.hadamard(F.transform(_arr(_W1), lambda w: S.sigmoid(V.dot(w, F.col("b")))), _arr(_W2)))
    return bi_interaction(rows, factorization.initial(rows, K)).select("row_id", F.round(S.sigmoid(F.col("wx") + deep), 4).alias("p"))


def bi_interaction(rows: DataFrame, params: DataFrame) -> DataFrame:
    x = rows.join(params, "fid")
    s = [F.sum(F.col("v")[f] * F.col("val")) for f in range(K)]
    q = [F.sum(F.pow(F.col("v")[f] * F.col("val"), 2)) for f in range(K)]
    return x.groupBy("row_id", "label").agg(F.sum(F.col("w") * F.col("val")).alias("wx"), F.array(*[(a * a - b) / 2 for a, b in zip(s, q, strict=True)]).alias("b"))


_D1 = np.array([[_u(7200000 + i * 100 + j) - 0.5 for i in range(16)] for j in range(6)])
_D2 = np.array([_u(7300000 + j) - 0.5 for j in range(6)])


def _embedded(rows: DataFrame) -> DataFrame:
    """(row_id, label, wx, x): linear sum, and the fields' embeddings side by side."""
    v = [(S.hash_unit(F.col("fid") + 100000 * (f + 1)) - 0.5) / 2 for f in range(K)]
    x = rows.select("row_id", "label", "field", ((S.hash_unit(F.col("fid")) - 0.5) * F.col("val")).alias("wx"), F.array(*v).alias("v"))
    g = x.groupBy("row_id", "label").agg(F.sum("wx").alias("wx"), F.sort_array(F.collect_list(F.struct("field", "v"))).alias("e"))
    return g.select("row_id", "label", "wx", F.flatten(F.transform("e", lambda t: t["v"])).alias("x"))


@query(f"""WITH {AD_SQL}, e AS (SELECT row_id, sum(({unit_sql('fid')} - 0.5) * val) AS wx, flatten(list([{', '.join(_V)}] ORDER BY field)) AS x FROM ad GROUP BY row_id),
  h AS (SELECT row_id, wx, list_transform({_lists(_D1)}, lambda w: {' + '.join(f'w[{i + 1}] * x[{i + 1}]' for i in range(16))}) AS h FROM e)
  SELECT row_id, round(1 / (1 + exp(-(wx + {' + '.join(f'({float(_D2[j])!r}) * (exp(2 * h[{j + 1}]) - 1) / (exp(2 * h[{j + 1}]) + 1)' for j in range(6))}))), 4) AS p FROM h""")
def wide_deep_forward(spark: SparkSession, d: str) -> DataFrame:
    deep = V.total(V.hadamard(F.transform(_arr(_D1), lambda w: F.tanh(V.dot(w, F.col("x")))), _arr(_D2)))
    return _embedded(ads.ad_long(spark, d)).select("row_id", F.round(S.sigmoid(F.col("wx") + deep), 4).alias("p"))


# ---- optimizers over fixed parameters and the gradients of events

_OPT_SQL = f"par AS (SELECT k.fid, {unit_sql('k.fid')} - 0.5 AS w, g / 100 AS g, g IS NULL AS none FROM (SELECT DISTINCT user_id % 100 AS fid FROM events) k LEFT JOIN (SELECT user_id % 100 AS fid, sum(value - 50) AS g FROM events GROUP BY 1) g ON g.fid = k.fid), m AS (SELECT fid, w, coalesce(g, 0) AS m FROM par)"


def _opt(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 100).alias("fid"), "user_id", "value")
    g = e.groupBy("fid").agg(F.sum(F.col("value") - 50).alias("g"))
    return e.select("fid").distinct().withColumn("w", S.hash_unit(F.col("fid")) - 0.5).join(g, "fid", "left")


def _opt_query(name: str, sql: dict[str, str], f, batch: int = 100) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        out = f(F.col("w"), F.lit(0.5), F.lit(0.25), F.col("g"))
        return _opt(spark, d).select("fid", *[F.round(out[c], 6).alias(c) for c in sql])

    q.__name__ = name
    query(f"WITH {_OPT_SQL} SELECT fid, {', '.join(f'round({x}, 6) + 0 AS {c}' for c, x in sql.items())} FROM m")(q)


_opt_query("sgd_step", {"w": "w - 0.1 * m"}, lambda w, a, b, g: optim.sgd(w, g, 0.1, 100))
_opt_query("adagrad_step", {"w": "CASE WHEN m = 0 THEN w ELSE w - 0.1 * m / sqrt(0.5 + m * m + 1e-7) END", "acc": "0.5 + m * m"}, lambda w, a, b, g: optim.adagrad(w, a, g, 0.1, 100))
_opt_query(
    "rmsprop_step",
    {"w": "CASE WHEN m = 0 THEN w ELSE w - 0.1 * m / sqrt(0.99 * 0.5 + 0.01 * m * m + 1e-7) END", "acc": "CASE WHEN m = 0 THEN 0.5 ELSE 0.99 * 0.5 + 0.01 * m * m END"},
    lambda w, a, b, g: optim.rmsprop(w, a, g, 0.1, 100),
)
_ada = "m * sqrt((0.25 + 1e-7) / (0.8 * 0.5 + 0.2 * m * m + 1e-7))"
_opt_query(
    "adadelta_step",
    {"w": f"CASE WHEN m = 0 THEN w ELSE w - {_ada} END", "delta": f"CASE WHEN m = 0 THEN 0.25 ELSE 0.8 * 0.25 + 0.2 * power({_ada}, 2) END"},
    lambda w, a, b, g: optim.adadelta(w, a, b, g, 100),
)
_opt_query(
    "adam_step",
    {"w": f"CASE WHEN m = 0 THEN w ELSE w - 0.1 * ((0.8 * 0.5 + 0.2 * m) / {1 - 0.8**3!r}) / (sqrt((0.999 * 0.25 + 0.001 * m * m) / {1 - 0.999**3!r}) + 1e-8) END"},
    lambda w, a, b, g: optim.adam(w, a, b, g, 0.1, 3, 100),
)
_fz = "(0.25 + m - (sqrt(0.5 + m * m) - sqrt(0.5)) / 0.15 * w)"
_opt_query(
    "ftrl_step",
    {"w": f"CASE WHEN abs({_fz}) <= 1 THEN 0 ELSE -({_fz} - sign({_fz})) / ((1 + sqrt(0.5 + m * m)) / 0.15 + 1) END", "z": _fz},
    lambda w, a, b, g: optim.ftrl(w, a, b, g, 100),
)
_opt_query("dcasgd_step", {"w": "w - 0.1 * (m + 0.1 * m * m * (w - 0.5))"}, lambda w, a, b, g: optim.dcasgd(w, a, g, 0.1, 100))
_opt_query(
    "dcasgd_adaptive_step",
    {"w": "w - 0.1 * (m + 0.1 / sqrt(0.95 * 0.25 + 0.05 * m * m + 1e-7) * m * m * (w - 0.5))"},
    lambda w, a, b, g: optim.dcasgd_adaptive(w, a, b, g, 0.1, 100),
)
_opt_query("l2_l1_decay", {"w": "0.001 * w + 0.00001 * sign(w)"}, lambda w, a, b, g: {"w": optim.decay(w, 1e-3, 1e-5)})
_opt_query("dropout_mask", {"w": f"CASE WHEN {mix_sql('fid')} < 0.8 THEN w / 0.8 ELSE 0 END"}, lambda w, a, b, g: {"w": F.when(S.hash_mix(F.col("fid")) < 0.8, w / 0.8).otherwise(0.0)})


# ---- boosting

_GBM_SQL = f"""{DENSE_SQL}, feat AS (SELECT row_id, CAST(i AS INTEGER) AS fid, x[i] AS val FROM dense, range(1, 65) r(i) WHERE abs(x[i]) >= 0.02),
  st AS (SELECT row_id, 0 AS cls, CAST(1 + row_id % 2 AS BIGINT) AS node, 0.5 - CAST(label >= 5 AS INTEGER) AS g, CAST(0.25 AS DOUBLE) AS h FROM dense),
  tot AS (SELECT cls, node, CAST(sum(g) AS DOUBLE) AS tg, sum(h) AS th, count(*) AS n FROM st GROUP BY cls, node)"""
_T = lambda g, h: f"power(sign({g}) * greatest(abs({g}) - 1e-5, 0), 2) / ({h} + 1e-5)"
_SPLIT_SQL = f"""{_GBM_SQL}, bv AS (SELECT cls, node, fid, val, CAST(sum(g) AS DOUBLE) AS g, sum(h) AS h FROM st JOIN feat ON feat.row_id = st.row_id GROUP BY cls, node, fid, val),
  w AS (SELECT *, lead(val) OVER o AS nx, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER q AS gf, sum(h) OVER q AS hf FROM bv WINDOW o AS (PARTITION BY cls, node, fid ORDER BY val), q AS (PARTITION BY cls, node, fid)),
  c AS (SELECT w.cls, w.node, fid, (val + nx) / 2 AS thr, tg, th, b AS nan_right, CASE WHEN b THEN gl ELSE gl + tg - gf END AS a, CASE WHEN b THEN hl ELSE hl + th - hf END AS hh FROM w JOIN tot ON tot.cls = w.cls AND tot.node = w.node, (VALUES (true), (false)) v(b) WHERE nx IS NOT NULL),
  cand AS (SELECT cls, node, fid, thr, nan_right, {_T('a', 'hh')} + {_T('(tg - a)', '(th - hh)')} - {_T('tg', 'th')} AS gain FROM c WHERE hh >= 1 AND th - hh >= 1),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls, node ORDER BY round(gain, 9) DESC, fid, thr, nan_right) AS r FROM cand WHERE gain > 1e-9) WHERE r = 1)"""


def _gbm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = ads.dense(spark, d)
    f = x.select("row_id", F.posexplode("x").alias("i", "val")).filter(F.abs("val") >= 0.02).select("row_id", (F.col("i") + 1).alias("fid"), "val")
    g = F.lit(0.5) - (F.col("label") >= 5).cast("int")
    return x.select("row_id", F.lit(0).alias("cls"), (1 + F.col("row_id") % 2).alias("node"), g.alias("g"), F.lit(0.25).alias("h")), f


@query(f"WITH {_GBM_SQL} SELECT cls, node, round(tg, 4) + 0 AS g, round(th, 4) AS h, n FROM tot")
def gbm_node_totals(spark: SparkSession, d: str) -> DataFrame:
    return boosting.node_totals(_gbm(spark, d)[0]).select("cls", "node", F.round("G", 4).alias("g"), F.round("H", 4).alias("h"), "n")


@query(f"WITH {_SPLIT_SQL} SELECT cls, node, fid, nan_right, count(*) AS n, round(max(gain), 4) + 0 AS gain FROM cand GROUP BY cls, node, fid, nan_right")
def gbm_split_search(spark: SparkSession, d: str) -> DataFrame:
    c = boosting.split_search(*_gbm(spark, d))
    return c.groupBy("cls", "node", "fid", "nan_right").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gain"), 4).alias("gain"))


@query(f"WITH {_SPLIT_SQL} SELECT cls, node, fid, round(thr, 6) + 0 AS thr, nan_right, round(gain, 4) AS gain FROM best")
def gbm_best_split(spark: SparkSession, d: str) -> DataFrame:
    b = boosting.best_split(boosting.split_search(*_gbm(spark, d)))
    return b.select("cls", "node", "fid", F.round("thr", 6).alias("thr"), "nan_right", F.round("gain", 4).alias("gain"))


_ROUTE_SQL = f"{_SPLIT_SQL}, rt AS (SELECT st.row_id, st.cls, CASE WHEN b.thr IS NULL THEN st.node ELSE st.node * 2 + CAST(CASE WHEN f.val IS NULL THEN b.nan_right ELSE f.val >= b.thr END AS INTEGER) END AS node, st.g, st.h FROM st LEFT JOIN best b ON b.cls = st.cls AND b.node = st.node LEFT JOIN feat f ON f.row_id = st.row_id AND f.fid = b.fid)"


@query(f"WITH {_ROUTE_SQL} SELECT row_id, cls, CAST(node AS BIGINT) AS node FROM rt")
def gbm_route_level(spark: SparkSession, d: str) -> DataFrame:
    st, f = _gbm(spark, d)
    return boosting.route(st, f, boosting.best_split(boosting.split_search(st, f))).select("row_id", "cls", "node")


@query(f"WITH {_ROUTE_SQL}, lv AS (SELECT cls, node, -sign(sum(g)) * greatest(abs(sum(g)) - 1e-5, 0) / (sum(h) + 1e-5) * 0.6 AS wt FROM rt GROUP BY cls, node) SELECT row_id, round(wt, 4) + 0 AS margin FROM rt JOIN lv ON lv.cls = rt.cls AND lv.node = rt.node")
def gbm_predict(spark: SparkSession, d: str) -> DataFrame:
    st, f = _gbm(spark, d)
    leaves = boosting.route(st, f, boosting.best_split(boosting.split_search(st, f)))
    w = boosting.node_totals(leaves).select("cls", "node", (boosting.leaf_weight(F.col("G"), F.col("H")) * 0.6).alias("w"))
    return leaves.join(w, ["cls", "node"]).select("row_id", F.round("w", 4).alias("margin"))


@query(f"WITH {_SPLIT_SQL} SELECT fid, count(*) AS splits FROM best GROUP BY fid")
def gbm_importance(spark: SparkSession, d: str) -> DataFrame:
    return boosting.importance([{"levels": [boosting.best_split(boosting.split_search(*_gbm(spark, d)))]}])


@query(None)
def gbm_binary_train(spark: SparkSession, d: str) -> DataFrame:
    """Two classes by one margin, trees over samples of rows and features."""
    x = ads.dense(spark, d).select("row_id", (F.col("label") >= 5).cast("int").alias("label"), "x")
    f = x.select("row_id", F.posexplode("x").alias("i", "val")).filter(F.abs("val") >= 0.02).select("row_id", (F.col("i") + 1).alias("fid"), "val")
    _, _, margins = boosting.train(x.select("row_id", "label"), f, 1, 2, 3, row_share=0.7, feature_share=0.7)
    return margins.select("row_id", "label", S.sigmoid(F.col("m")[0]).alias("p"))


@query(None)
def gbm_train(spark: SparkSession, d: str) -> DataFrame:
    x = ads.dense(spark, d)
    f = x.select("row_id", F.posexplode("x").alias("i", "val")).filter(F.abs("val") >= 0.02).select("row_id", (F.col("i") + 1).alias("fid"), "val")
    _, _, margins = boosting.train(x.select("row_id", "label"), f, 10, 2, 3)
    return margins.select("row_id", "label", V.argmax(F.col("m")).alias("cls"))


# ---- mixtures, topics, quantisers

_DIM = 10


def _cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return ads.dense(spark, d).select("row_id", F.slice("x", 1, _DIM).alias("x"))


def _start(k: int = 4) -> list[mixtures.Gauss]:
    return [(c, 1 / k, [(_u(500 + c * 100 + j) - 0.5) * 0.4 for j in range(_DIM)], [0.05] * _DIM) for c in range(k)]


_GM = ", ".join(f"({c}, CAST({w!r} AS DOUBLE), {_lists(np.array(mu))}, {_lists(np.array(s))})" for c, w, mu, s in _start())
_GMM_SQL = f"""{DENSE_SQL}, gm(c, w, mu, s2) AS (VALUES {_GM}), lp AS (SELECT row_id, c, x, ln(w) - 0.5 * list_sum(list_transform(range(1, 11), lambda j: (x[j] - mu[j]) * (x[j] - mu[j]) / s2[j] + ln(s2[j]) + ln(2 * pi()))) AS lp FROM dense, gm),
  rs AS (SELECT *, exp(lp - max(lp) OVER w) / sum(exp(lp - m)) OVER w AS r FROM (SELECT *, max(lp) OVER (PARTITION BY row_id) AS m FROM lp) WINDOW w AS (PARTITION BY row_id))"""


@query(f"WITH {_GMM_SQL} SELECT row_id, CAST(c AS INTEGER) AS c, round(lp, 4) + 0 AS lp FROM lp")
def gaussian_logpdf(spark: SparkSession, d: str) -> DataFrame:
    lp = mixtures.log_densities(_cluster_rows(spark, d), _start())
    return lp.select("row_id", F.posexplode("lp").alias("c", "lp")).select("row_id", "c", F.round("lp", 4).alias("lp"))


@query(f"WITH {_GMM_SQL} SELECT row_id, CAST(c AS INTEGER) AS c, round(r, 5) AS r FROM rs")
def gmm_estep(spark: SparkSession, d: str) -> DataFrame:
    r = mixtures.responsibilities(_cluster_rows(spark, d), _start())
    return r.select("row_id", F.posexplode("r").alias("c", "r")).select("row_id", "c", F.round("r", 5).alias("r"))


@query(f"""WITH {_GMM_SQL}, n AS (SELECT c, sum(r) AS n FROM rs GROUP BY c), a AS (SELECT c, j, sum(r * x[j]) AS a, sum(r * x[j] * x[j]) AS b FROM rs, range(1, 11) q(j) GROUP BY c, j)
  SELECT CAST(a.c AS INTEGER) AS c, CAST(j AS INTEGER) AS j, round(n / sum(n) OVER (PARTITION BY j), 5) AS weight, round(a / n, 5) + 0 AS mu, round(greatest(0.01, b / n - (a / n) * (a / n)), 5) AS s2 FROM a JOIN n ON n.c = a.c""")
def gmm_mstep(spark: SparkSession, d: str) -> DataFrame:
    model, _ = mixtures.mixture_step(_cluster_rows(spark, d), _start())
    rows = [(c, j + 1, w, mu[j], s[j]) for c, w, mu, s in model for j in range(_DIM)]
    out = spark.createDataFrame(rows, "c int, j int, weight double, mu double, s2 double")
    return out.select("c", "j", *[F.round(x, 5).alias(x) for x in ("weight", "mu", "s2")])


@query(f"WITH {_GMM_SQL} SELECT row_id, CAST(arg_max(c, (round(lp, 9), -c)) AS INTEGER) AS c FROM lp GROUP BY row_id")
def gmm_assign(spark: SparkSession, d: str) -> DataFrame:
    lp = mixtures.log_densities(_cluster_rows(spark, d), _start())
    return lp.select("row_id", V.argmax(F.transform("lp", lambda v: F.round(v, 9))).alias("c"))


@query(f"WITH {_GMM_SQL}, h AS (SELECT row_id, arg_max(c, (round(lp, 9), -c)) AS c FROM lp GROUP BY row_id) SELECT CAST(c AS INTEGER) AS c, count(*) AS n, min(row_id) AS first FROM h GROUP BY c")
def word_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and first member of each cluster."""
    return gmm_assign(spark, d).groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


@query(None)
def gmm_train(spark: SparkSession, d: str) -> DataFrame:
    model, lls = mixtures.mixture_train(_cluster_rows(spark, d), _start(), 5)
    return spark.createDataFrame([(c, w, mu, s) for c, w, mu, s in model], "cluster int, weight double, mu array<double>, sigma2 array<double>")


_TOPICS = 3
_PLSA_SQL = f"""{WORDS_SQL}, freq AS (SELECT word, count(*) AS freq FROM words GROUP BY word), voc AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 AS INTEGER) AS wid, word FROM freq QUALIFY wid < 200),
  cnt AS (SELECT doc_id, wid, count(*) AS n FROM words w JOIN voc v ON w.word = v.word GROUP BY doc_id, wid),
  zw AS (SELECT wid, z, u / sum(u) OVER (PARTITION BY z) AS pw FROM (SELECT DISTINCT wid, z, {unit_sql('wid * 10 + z')} + 0.1 AS u FROM voc, range(0, {_TOPICS}) r(z))),
  jn AS (SELECT doc_id, cnt.wid, n, z, pw / {_TOPICS} AS j FROM cnt JOIN zw ON zw.wid = cnt.wid), qz AS (SELECT *, j / sum(j) OVER (PARTITION BY doc_id, wid) AS q FROM jn)"""


def _plsa(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts = written(doc_term(spark, d), "counts")
    voc = vocab(spark, d).select("wid", F.array(*[S.hash_unit(F.col("wid").cast("bigint") * 10 + z) + 0.1 for z in range(_TOPICS)]).alias("u"))
    tot = voc.agg(*[F.sum(F.col("u")[z]).alias(f"t{z}") for z in range(_TOPICS)]).first()
    inv = F.array(*[F.lit(1.0 / (tot[f"t{z}"] or 1.0)) for z in range(_TOPICS)])
    dz = counts.select("doc_id").distinct().withColumn("pz", F.array(*[F.lit(1.0 / _TOPICS)] * _TOPICS))
    return counts, dz, voc.select("wid", V.hadamard(F.col("u"), inv).alias("pw"))


@query(f"WITH {_PLSA_SQL} SELECT wid, CAST(z AS INTEGER) AS z, round(avg(q), 5) AS q FROM qz GROUP BY wid, z")
def plsa_estep(spark: SparkSession, d: str) -> DataFrame:
    j = mixtures.plsa_joined(*_plsa(spark, d)).select("wid", F.posexplode("q").alias("z", "q"))
    return j.groupBy("wid", "z").agg(F.round(F.avg("q"), 5).alias("q"))


@query(f"WITH {_PLSA_SQL}, s AS (SELECT wid, z, sum(n * q) AS s FROM qz GROUP BY wid, z) SELECT wid, CAST(z AS INTEGER) AS z, round(s / sum(s) OVER (PARTITION BY z), 6) AS pw FROM s")
def plsa_mstep(spark: SparkSession, d: str) -> DataFrame:
    _, zw = mixtures.plsa_step(*_plsa(spark, d), _TOPICS)
    return zw.select("wid", F.posexplode("pw").alias("z", "pw")).select("wid", "z", F.round("pw", 6).alias("pw"))


@query(f"WITH {_PLSA_SQL}, l AS (SELECT doc_id, wid, any_value(n) AS n, sum(j) AS p FROM jn GROUP BY doc_id, wid) SELECT round(sum(n * ln(p)) / sum(n), 5) + 0 AS ll FROM l")
def plsa_loglik(spark: SparkSession, d: str) -> DataFrame:
    j = mixtures.plsa_joined(*_plsa(spark, d))
    return j.agg(F.round(F.sum(F.col("n") * F.log(V.total(F.col("joint")))) / F.sum("n"), 5).alias("ll"))


@query(f"WITH {_PLSA_SQL}, s AS (SELECT wid, z, sum(n * q) AS s FROM qz GROUP BY wid, z) SELECT wid, CAST(arg_max(z, (round(s, 6), -z)) AS INTEGER) AS z FROM s GROUP BY wid")
def topic_of_word(spark: SparkSession, d: str) -> DataFrame:
    j = mixtures.plsa_joined(*_plsa(spark, d)).select("wid", F.posexplode(V.scale(F.col("q"), F.col("n").cast("double"))).alias("z", "s"))
    s = j.groupBy("wid", "z").agg(F.round(F.sum("s"), 6).alias("s"))
    return s.groupBy("wid").agg(F.max(F.struct("s", (-F.col("z")).alias("m"))).alias("b")).select("wid", (-F.col("b.m")).alias("z"))


@query(None)
def plsa_train(spark: SparkSession, d: str) -> DataFrame:
    counts, dz, zw = _plsa(spark, d)
    for _ in range(3):
        dz, zw = (written(t, "plsa") for t in mixtures.plsa_step(counts, dz, zw, _TOPICS))
    return zw


_BOOK = {p: [[(_u(9000 + p * 1000 + c * 100 + j) - 0.5) * 0.5 for j in range(16)] for c in range(8)] for p in range(4)}
_BK = ", ".join(f"({p}, {c}, {_lists(np.array(w))})" for p, ws in _BOOK.items() for c, w in enumerate(ws))
_PQ_SQL = f"""{DENSE_SQL}, bk(p, c, w) AS (VALUES {_BK}), en AS (SELECT row_id, p, arg_min(c, (round(d2, 12), c)) AS c FROM (SELECT row_id, p, c, list_sum(list_transform(range(1, 17), lambda j: (x[p * 16 + j] - w[j]) * (x[p * 16 + j] - w[j]))) AS d2 FROM dense, bk) GROUP BY row_id, p)"""


@query(f"WITH {_PQ_SQL} SELECT row_id, CAST(p AS INTEGER) AS part, CAST(c AS INTEGER) AS code FROM en")
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    return mixtures.encode(mixtures.parts(ads.dense(spark, d), 64, 4), _BOOK).select("row_id", "part", "code")


@query(f"WITH {_PQ_SQL} SELECT CAST(p AS INTEGER) AS part, CAST(en.c AS INTEGER) AS code, count(*) AS n, round(avg(x[p * 16 + 1]), 5) + 0 AS first FROM en JOIN dense ON dense.row_id = en.row_id GROUP BY p, en.c")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    e = mixtures.encode(mixtures.parts(ads.dense(spark, d), 64, 4), _BOOK)
    return e.groupBy("part", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y")[0]), 5).alias("first"))


@query(None)
def pq_train(spark: SparkSession, d: str) -> DataFrame:
    book, _ = mixtures.quantiser_train(ads.dense(spark, d), 64, 4, 16, 5)
    return spark.createDataFrame([(p, c, w) for p, ws in book.items() for c, w in enumerate(ws)], "part int, code int, centroid array<double>")


@query(f"WITH {DENSE_SQL}, m AS (SELECT i, avg(x[i]) AS m FROM dense, range(1, 11) q(i) GROUP BY i) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg((x[a.i] - a.m) * (x[b.i] - b.m)), 6) + 0 AS v FROM dense, m a, m b GROUP BY a.i, b.i")
def pca_covariance(spark: SparkSession, d: str) -> DataFrame:
    _, cov = mixtures.covariance(_cluster_rows(spark, d), _DIM)
    rows = [(i + 1, j + 1, cov[i][j]) for i in range(_DIM) for j in range(_DIM)]
    return spark.createDataFrame(rows, "i int, j int, v double").select("i", "j", F.round("v", 6).alias("v"))


@query(None)
def pca_project(spark: SparkSession, d: str) -> DataFrame:
    mean, cov = mixtures.covariance(_cluster_rows(spark, d), _DIM)
    w = np.linalg.eigh(np.array(cov))[1][:, ::-1][:, :2].T
    w *= np.sign(w[np.arange(2), np.abs(w).argmax(axis=1)])[:, None]
    y = F.transform(_arr(w), lambda c: V.dot(V.sub(F.col("x"), _arr(np.array(mean))), c))
    return _cluster_rows(spark, d).select("row_id", y.alias("y"))


@query(None)
def pca_gha(spark: SparkSession, d: str) -> DataFrame:
    _, cov = mixtures.covariance(_cluster_rows(spark, d), _DIM)
    w = embedding.hebbian(np.array(cov), 2)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(w)], "component int, w array<double>")


# ---- layers with fixed weights

_DW = np.array([[_u(7400000 + i * 100 + j) - 0.5 for i in range(64)] for j in range(3)])


@query(f"WITH {DENSE_SQL}, h AS (SELECT row_id, list_transform({_lists(_DW)}, lambda w: {' + '.join(f'w[{i}] * x[{i}]' for i in range(1, 65))}) AS h FROM dense) SELECT row_id, CAST(j AS INTEGER) AS j, round(1 / (1 + exp(-h[j])), 6) AS y FROM h, range(1, 4) q(j)")
def dense_forward(spark: SparkSession, d: str) -> DataFrame:
    y = F.transform(_arr(_DW), lambda w: S.sigmoid(V.dot(w, F.col("x"))))
    return ads.dense(spark, d).select("row_id", F.posexplode(y).alias("p", "y")).select("row_id", (F.col("p") + 1).alias("j"), F.round("y", 6).alias("y"))


_CW = [_u(7500000 + i) - 0.5 for i in range(9)]
_conv_sql = " + ".join(f"({w!r}) * x[r * 8 + c + {(i // 3) * 8 + i % 3 + 1}]" for i, w in enumerate(_CW))


def _conv(relu: bool):
    def cell(o: Column) -> Column:
        at = F.floor(o / 6).cast("int") * 8 + o % 6
        v = sum((F.lit(w) * F.get("x", at + (i // 3) * 8 + i % 3) for i, w in enumerate(_CW)), F.lit(0.0))
        return F.greatest(v, F.lit(0.0)) if relu else v

    return F.transform(F.sequence(F.lit(0), F.lit(35)), cell)


@query(f"WITH {DENSE_SQL} SELECT row_id, CAST(r * 6 + c AS INTEGER) AS o, round({_conv_sql}, 6) + 0 AS y FROM dense, range(0, 6) a(r), range(0, 6) b(c)")
def conv2d_forward(spark: SparkSession, d: str) -> DataFrame:
    return ads.dense(spark, d).select("row_id", F.posexplode(_conv(False)).alias("o", "y")).select("row_id", "o", F.round("y", 6).alias("y"))


@query(f"WITH {DENSE_SQL} SELECT row_id, CAST(r * 6 + c AS INTEGER) AS o, round(greatest({_conv_sql}, 0), 6) + 0 AS y FROM dense, range(0, 6) a(r), range(0, 6) b(c)")
def conv_layer_forward(spark: SparkSession, d: str) -> DataFrame:
    return ads.dense(spark, d).select("row_id", F.posexplode(_conv(True)).alias("o", "y")).select("row_id", "o", F.round("y", 6).alias("y"))


@query(f"WITH {DENSE_SQL}, s AS (SELECT row_id, t, x[t * 8 + 1 : t * 8 + 8] AS h FROM dense, range(0, 8) q(t)), e AS (SELECT row_id, t, h, exp(4 * h[1] - 2 * h[2]) AS e FROM s), a AS (SELECT row_id, h, e / sum(e) OVER (PARTITION BY row_id) AS a FROM e) SELECT row_id, CAST(j AS INTEGER) AS j, round(sum(a * h[j]), 6) + 0 AS y FROM a, range(1, 9) p(j) GROUP BY row_id, j")
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Eight steps of eight values, pooled inside each row."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", t * 8 + 1, F.lit(8)))
    a = V.softmax(F.transform(steps, lambda h: 4 * h[0] - 2 * h[1]), floor=0.0)
    y = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: V.total(F.zip_with(a, steps, lambda w, h: w * F.get(h, j))))
    return ads.dense(spark, d).select("row_id", F.posexplode(y).alias("p", "y")).select("row_id", (F.col("p") + 1).alias("j"), F.round("y", 6).alias("y"))


@query(f"WITH {DENSE_SQL} SELECT row_id, CAST(j AS INTEGER) AS j, round(x[j] + exp(x[j + 32] / 2) * ({unit_sql('row_id * 100 + j')} - 0.5), 6) + 0 AS z FROM dense, range(1, 33) q(j)")
def vae_sample_forward(spark: SparkSession, d: str) -> DataFrame:
    eps = lambda j: S.hash_unit(F.col("row_id") * 100 + j.cast("bigint")) - 0.5
    z = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda j: F.get("x", j - 1) + F.exp(F.get("x", j + 31) / 2) * eps(j))
    return ads.dense(spark, d).select("row_id", F.posexplode(z).alias("p", "z")).select("row_id", (F.col("p") + 1).alias("j"), F.round("z", 6).alias("z"))


@query(f"WITH {DENSE_SQL} SELECT row_id, round(list_sum(list_transform(range(1, 33), lambda j: exp(x[j + 32]) - 1 - x[j + 32] + x[j] * x[j])) / 2, 6) AS kl FROM dense")
def vae_kl(spark: SparkSession, d: str) -> DataFrame:
    mu, lv = F.slice("x", 1, 32), F.slice("x", 33, 32)
    return ads.dense(spark, d).select("row_id", F.round(V.total(F.zip_with(mu, lv, lambda m, v: F.exp(v) - 1 - v + m * m)) / 2, 6).alias("kl"))


@query(f"WITH {DENSE_SQL}, r AS (SELECT row_id, x, list_reverse(x) AS y FROM dense) SELECT row_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(list_sum(list_transform(range(1, 9), lambda k: x[i * 8 + k] * y[(k - 1) * 8 + j + 1])), 6) + 0 AS v FROM r, range(0, 8) a(i), range(0, 8) b(j)")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as an 8 x 8 matrix times its reverse as another, inside its row."""
    x = ads.dense(spark, d).select("row_id", "x", F.reverse("x").alias("y"))
    return x.select("row_id", F.posexplode(V.matmul(F.col("x"), F.col("y"), 8, 8, 8)).alias("c", "v")).select("row_id", F.floor(F.col("c") / 8).cast("int").alias("i"), (F.col("c") % 8).alias("j"), F.round("v", 6).alias("v"))


@query("""WITH RECURSIVE s(step, w, b) AS (SELECT 0, [CAST(1 AS DOUBLE), 2, 3, 4], CAST(0.3 AS DOUBLE) UNION ALL
  SELECT step + 1, list_transform(range(1, 5), lambda i: w[i] - 0.5 * (1 / (1 + exp(-(w[1] * 0.1 + w[2] * 0.2 + w[3] * 0.3 + w[4] * 0.4 + b)))) * (i / 10)), b - 0.5 / (1 + exp(-(w[1] * 0.1 + w[2] * 0.2 + w[3] * 0.3 + w[4] * 0.4 + b))) FROM s WHERE step < 5)
  SELECT CAST(step AS INTEGER) AS step, round(ln(1 + exp(w[1] * 0.1 + w[2] * 0.2 + w[3] * 0.3 + w[4] * 0.4 + b)), 6) AS loss FROM s""")
def dag_lr_step(spark: SparkSession, d: str) -> DataFrame:
    """Matmul, add and logistic loss of one row with label 0 as a graph; its losses before and after five plain steps."""
    w, b = graph.trainable("w", [1.0, 2.0, 3.0, 4.0]), graph.trainable("b", [0.3])
    x = graph.source(*[F.lit(v) for v in (0.1, 0.2, 0.3, 0.4)])
    loss = graph.logistic_loss(graph.add(graph.matmul(w, x), b), graph.source(F.lit(0.0)))
    _, losses = graph.train(spark.range(1), loss, 6, 0.5)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(losses)], "step int, loss double")


@query(None)
def dag_train(spark: SparkSession, d: str) -> DataFrame:
    """A two-layer graph over events' values and hours, trained on purchases: its losses."""
    e = table(spark, d, "events").select(((F.col("value") - 50) / 50).alias("a"), (F.hour("ts") / 24).alias("b"), (F.col("event_type") == "purchase").cast("double").alias("label"))
    x, hidden = graph.source("a", "b"), []
    for j in range(2):
        h = graph.add(graph.matmul(graph.trainable(f"w{j}", [0.4 - j, 0.3 + j]), x), graph.trainable(f"b{j}", [0.1]))
        hidden.append(graph.matmul(graph.activation(h, "tanh"), graph.trainable(f"v{j}", [0.5 - j])))
    loss = graph.logistic_loss(graph.add(*hidden), graph.source("label"))
    _, losses = graph.train(e, loss, 4, 0.5)
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double")


# ---- full trainers: rows only, their convergence is tested


@query(None)
def fm_train(spark: SparkSession, d: str) -> DataFrame:
    params, _ = factorization.train(ads.ad_long(spark, d), K, 2)
    return params.select("fid", "w", "v")


@query(None)
def ffm_train(spark: SparkSession, d: str) -> DataFrame:
    return factorization.ffm_train(ads.ad_long(spark, d), K, 2)[0]


@query(None)
def nfm_train(spark: SparkSession, d: str) -> DataFrame:
    """Weights and factors of every feature, learnt together with the dense part over the bi-interaction vectors."""
    return deep.train(ads.ad_long(spark, d), K, deep.nfm(K), [nets.Dense(K, 8, "sigmoid"), nets.Dense(8, 1)], 2)[0].select("fid", "w", "v")


@query(None)
def wide_deep_train(spark: SparkSession, d: str) -> DataFrame:
    """Wide weights and embeddings of every feature, learnt together with the dense part over the fields' embeddings."""
    return deep.train(ads.ad_long(spark, d), K, deep.wide_deep(K, [0, 1, 2, 3]), [nets.Dense(16, 16, "tanh"), nets.Dense(16, 1)], 2)[0].select("fid", "w", "v")


@query(None)
def cnn_train(spark: SparkSession, d: str) -> DataFrame:
    """The class of every row by a trained net."""
    net = nets.cnn(8, 10)
    nets.train(ads.dense(spark, d), net, nets.softmax_loss, 2)
    return nets.predict(ads.dense(spark, d), net).select("row_id", V.argmax(F.col("y")).alias("cls"))


@query(None)
def rnn_train(spark: SparkSession, d: str) -> DataFrame:
    net = nets.rnn(8, 8, 16, 10)
    nets.train(ads.dense(spark, d), net, nets.softmax_loss, 2)
    return nets.predict(ads.dense(spark, d), net).select("row_id", V.argmax(F.col("y")).alias("cls"))


@query(None)
def vae_train(spark: SparkSession, d: str) -> DataFrame:
    """The latent means of every row."""
    net = nets.vae(64, 24, 6)
    nets.train(ads.dense(spark, d), net, nets.rebuild_loss, 2, target="x")
    return nets.predict(ads.dense(spark, d), net[:2]).select("row_id", F.slice("y", 1, 6).alias("mu"))


@query(None)
def huffman_codes(spark: SparkSession, d: str) -> DataFrame:
    v = vocab(spark, d).orderBy("wid").collect()
    codes, paths = embedding.huffman([r["freq"] for r in v])
    return spark.createDataFrame([(r["wid"], c, p) for r, c, p in zip(v, codes, paths, strict=True)], "wid int, code string, path array<int>")


@query(None)
def cbow_train(spark: SparkSession, d: str) -> DataFrame:
    v = vocab(spark, d)
    freq = [r["freq"] for r in v.orderBy("wid").collect()]
    docs = embedding.word_lists(ads.words(spark, d).join(F.broadcast(v.select("word", "wid")), "word").select("doc_id", "pos", "wid"))
    vectors, _ = embedding.cbow_train(docs, freq, dim=8, epochs=1, negatives=4)
    return spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(vectors)], "wid int, x array<double>")


@query(None)
def ann_build_query(spark: SparkSession, d: str) -> DataFrame:
    """Five largest inner products with every hundredth vector from a hyperplane forest that holds every vector."""
    x = ads.dense(spark, d)
    return forest.nearest(x, x.filter("row_id % 100 = 0"), forest.fit(x, 8), 5)


@query(None)
def stream_online_lr(spark: SparkSession, d: str) -> DataFrame:
    """Weights after a stream of all ad rows."""
    import uuid

    base = f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    ads.ad_long(spark, d).write.parquet(f"{base}/rows")
    rows = spark.readStream.schema("row_id bigint, label int, pos int, field int, fid bigint, val double").parquet(f"{base}/rows")
    online.push_gradients(rows, f"{base}/state", f"{base}/checkpoint")
    return online.latest(spark, f"{base}/state")
