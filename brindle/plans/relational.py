"""Joins, aggregates, windows, rankings and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.functions import vec as V
from brindle.operators import knn, metrics
from brindle.plans.book import Book, mix_sql, unit_sql
from brindle.session import table
from brindle.sources import ads
from brindle.sources.ads import AD_SQL, DENSE_SQL, WORDS_SQL

B = Book()
query = B.query


def N() -> Column:  # noqa: N802
    return F.count(F.lit(1))



def params(spark: SparkSession, d: str) -> DataFrame:
    """Initial weights of all features seen: (fid, w)."""
    return ads.ad_long(spark, d).select("fid").distinct().withColumn("w", S.hash_unit(F.col("fid")) - 0.5)


PARAMS_SQL = f"params AS (SELECT fid, {unit_sql('fid')} - 0.5 AS w FROM (SELECT DISTINCT fid FROM ad))"


@query(f"WITH {AD_SQL}, {PARAMS_SQL} SELECT row_id, round(sum(w * val), 4) AS wx FROM ad JOIN params ON ad.fid = params.fid GROUP BY row_id")
def param_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    return ads.ad_long(spark, d).join(params(spark, d), "fid").groupBy("row_id").agg(F.round(F.sum(F.col("w") * F.col("val")), 4).alias("wx"))


@query(f"WITH {AD_SQL}, {PARAMS_SQL} SELECT k.batch, k.fid, coalesce(w, 0) AS w FROM (SELECT DISTINCT CAST(floor(row_id / 1000) AS BIGINT) AS batch, fid FROM ad) k LEFT JOIN (SELECT * FROM params WHERE fid % 3 <> 0) p ON k.fid = p.fid")
def ps_pull_join(spark: SparkSession, d: str) -> DataFrame:
    """Weights for the distinct keys of every mini-batch; keys that the server doesn't hold get 0."""
    keys = ads.ad_long(spark, d).select(F.floor(F.col("row_id") / 1000).alias("batch"), "fid").distinct()
    held = params(spark, d).filter("fid % 3 <> 0")
    return keys.join(held, "fid", "left").select("batch", "fid", F.coalesce("w", F.lit(0.0)).alias("w"))


_VOCAB_SQL = f"""{WORDS_SQL}, freq AS (SELECT word, count(*) AS freq FROM words GROUP BY word),
  vocab AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 AS INTEGER) AS wid, word, freq FROM freq QUALIFY wid < 200)"""


def vocab(spark: SparkSession, d: str, k: int = 200) -> DataFrame:
    """The k most frequent words numbered from 0; only those k rows meet in one task."""
    top = ads.words(spark, d).groupBy("word").agg(N().alias("freq")).orderBy(F.desc("freq"), "word").limit(k)
    wid = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("freq"), "word")) - 1
    return top.select(wid.cast("int").alias("wid"), "word", "freq")


@query(f"WITH {_VOCAB_SQL} SELECT wid, word, freq FROM vocab")
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return vocab(spark, d)


@query(f"WITH {_VOCAB_SQL} SELECT doc_id, count(*) AS known FROM words w JOIN vocab v ON w.word = v.word GROUP BY doc_id")
def vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ads.words(spark, d).join(F.broadcast(vocab(spark, d)), "word").groupBy("doc_id").agg(N().alias("known"))


@query(f"WITH {_VOCAB_SQL} SELECT word, count(*) AS n FROM words w WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.word = w.word) GROUP BY word")
def oov_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return ads.words(spark, d).join(F.broadcast(vocab(spark, d)), "word", "left_anti").groupBy("word").agg(N().alias("n"))


@query(f"WITH {AD_SQL} SELECT a.field AS f1, b.field AS f2, count(*) AS pairs, count(DISTINCT a.fid * 10000 + b.fid) AS kinds FROM ad a JOIN ad b ON a.row_id = b.row_id AND a.field < b.field GROUP BY a.field, b.field")
def ffm_pair_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    """Pairs inside a row are made from its array: no join, no shuffle before the aggregate."""
    x = F.col("features")
    pairs = F.flatten(F.transform(x, lambda a: F.transform(F.filter(x, lambda b: b["pos"] > a["pos"]), lambda b: F.struct(a["field"].alias("f1"), b["field"].alias("f2"), (a["fid"] * 10000 + b["fid"]).alias("kind")))))
    return ads.ad_rows(spark, d).select(F.inline(pairs)).groupBy("f1", "f2").agg(N().alias("pairs"), F.countDistinct("kind").alias("kinds"))


def _centroids(spark: SparkSession, d: str, k: int = 8) -> list[tuple[int, list[float]]]:
    """The first k vectors, as the starting centroids."""
    return [(r["row_id"], r["x"]) for r in ads.dense(spark, d).filter(F.col("row_id") < k).orderBy("row_id").collect()]


def _to_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with its squared distance to each centroid, which are constants of the plan."""
    c = _centroids(spark, d)
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("c"), V.l2_distance_sq(F.col("x"), F.array(*[F.lit(float(v)) for v in x])).alias("d2")) for i, x in c])
    return ads.dense(spark, d).select("row_id", "x", rows.alias("ds"))


_CENT_SQL = f"{DENSE_SQL}, pc AS (SELECT p.row_id, p.x, c.row_id AS c, list_sum(list_transform(range(1, 65), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS d2 FROM dense p, dense c WHERE c.row_id < 8)"


@query(f"WITH {_CENT_SQL} SELECT row_id, c, round(d2, 5) AS d2 FROM pc")
def points_x_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _to_centroids(spark, d).select("row_id", F.inline("ds")).select("row_id", "c", F.round("d2", 5).alias("d2"))


@query(f"WITH {_CENT_SQL} SELECT row_id, min_by(c, (round(d2, 9), c)) AS c FROM pc GROUP BY row_id")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    best = F.array_min(F.transform("ds", lambda s: F.struct(F.round(s["d2"], 9).alias("d2"), s["c"].alias("c"))))
    return _to_centroids(spark, d).select("row_id", best["c"].alias("c"))


@query(f"""WITH ring AS (SELECT n AS node, {mix_sql('n * 1000 + v + 7')} AS pt FROM range(0, 4) a(n), range(0, 5) b(v)), k AS (SELECT DISTINCT user_id, {mix_sql('user_id')} AS h FROM events)
  SELECT user_id, coalesce((SELECT arg_min(node, pt) FROM ring WHERE pt >= h), (SELECT arg_min(node, pt) FROM ring)) AS node FROM k""")
def consistent_hash_route(spark: SparkSession, d: str) -> DataFrame:
    """Smallest ring point at or after a key's hash, past the end the first; the ring (nodes by virtual nodes) is a constant of the plan."""
    ring = spark.range(20).select((F.col("id") / 5).cast("bigint").alias("node"), S.hash_mix(F.floor(F.col("id") / 5) * 1000 + F.col("id") % 5 + 7).alias("pt")).orderBy("pt").collect()
    h = S.hash_mix(F.col("user_id"))
    node = F.lit(ring[0]["node"])
    for r in reversed(ring):
        node = F.when(h <= F.lit(r["pt"]), F.lit(r["node"])).otherwise(node)
    return table(spark, d, "events").select("user_id").distinct().select("user_id", node.cast("bigint").alias("node"))


@query(f"WITH {AD_SQL}, tr AS (SELECT DISTINCT fid FROM ad WHERE row_id % 5 <> 0) SELECT row_id, count(*) AS kept FROM ad WHERE row_id % 5 = 0 AND fid IN (SELECT fid FROM tr) GROUP BY row_id")
def unseen_feature_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Test rows without the features that training never saw."""
    rows = ads.ad_long(spark, d)
    seen = rows.filter("row_id % 5 <> 0").select("fid").distinct()
    return rows.filter("row_id % 5 = 0").join(seen, "fid", "left_semi").groupBy("row_id").agg(N().alias("kept"))


@query(f"WITH {AD_SQL} SELECT fid, round(sum((0.2 - label) * val), 4) + 0 AS g, count(*) AS n FROM ad GROUP BY fid")
def grad_reduce(spark: SparkSession, d: str) -> DataFrame:
    return ads.ad_long(spark, d).groupBy("fid").agg(F.round(F.sum((F.lit(0.2) - F.col("label")) * F.col("val")), 4).alias("g"), N().alias("n"))


@query(f"WITH {AD_SQL} SELECT row_id, round(sum(({unit_sql('fid')} - 0.5) * val), 4) AS s, round(sum(power(({unit_sql('fid')} - 0.5) * val, 2)), 4) AS s2 FROM ad GROUP BY row_id")
def row_forward_sum(spark: SparkSession, d: str) -> DataFrame:
    """Weights are functions of ids, so a row's sums come from its own array."""
    t = F.transform("features", lambda f: (S.hash_unit(f["fid"]) - 0.5) * f["val"])
    return ads.ad_rows(spark, d).select("row_id", F.round(V.total(t), 4).alias("s"), F.round(V.l2_norm_sq(t), 4).alias("s2"))


@query(f"WITH {WORDS_SQL} SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM words GROUP BY word")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    by_doc = ads.words(spark, d).groupBy("doc_id", "word").agg(N().alias("n"))
    return by_doc.groupBy("word").agg(F.sum("n").alias("freq"), N().alias("docs"))


@query(f"WITH {_VOCAB_SQL} SELECT doc_id, wid, count(*) AS n FROM words w JOIN vocab v ON w.word = v.word GROUP BY doc_id, wid")
def doc_term_count(spark: SparkSession, d: str) -> DataFrame:
    return doc_term(spark, d)


def doc_term(spark: SparkSession, d: str) -> DataFrame:
    return ads.words(spark, d).join(F.broadcast(vocab(spark, d)), "word").groupBy("doc_id", "wid").agg(N().alias("n"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id")
def words_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return ads.words(spark, d).groupBy("doc_id").agg(N().alias("n"))


@query(f"WITH {AD_SQL} SELECT DISTINCT CAST(floor(row_id / 500) AS BIGINT) AS batch, fid FROM ad")
def batch_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return ads.ad_long(spark, d).select(F.floor(F.col("row_id") / 500).alias("batch"), "fid").distinct()


@query(f"WITH {AD_SQL} SELECT CAST(max(fid) + 1 AS BIGINT) AS feature_cnt, CAST(max(field) + 1 AS INTEGER) AS field_cnt FROM ad")
def max_id(spark: SparkSession, d: str) -> DataFrame:
    return ads.ad_long(spark, d).agg((F.max("fid") + 1).alias("feature_cnt"), (F.max("field") + 1).alias("field_cnt"))


@query(f"WITH {AD_SQL}, w AS (SELECT fid, e.user_id % 4 AS worker, sum(e.value) AS g FROM ad JOIN events e ON e.event_id = ad.row_id GROUP BY fid, worker) SELECT fid, count(*) AS workers, round(avg(g), 4) AS g FROM w GROUP BY fid")
def allreduce_avg(spark: SparkSession, d: str) -> DataFrame:
    """Gradients summed on each worker, then averaged over the workers that have the key."""
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), (F.col("user_id") % 4).alias("worker"), "value")
    by_worker = ads.ad_long(spark, d).join(e, "row_id").groupBy("fid", "worker").agg(F.sum("value").alias("g"))
    return by_worker.groupBy("fid").agg(N().alias("workers"), F.round(F.avg("g"), 4).alias("g"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """events with a fixed score: (row_id, label, p)."""
    p = S.sigmoid((F.col("value") - 50) / 40)
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("int").alias("label"), p.alias("p"))


_SCORED_SQL = "scored AS (SELECT event_id AS row_id, CAST(event_type = 'purchase' AS INTEGER) AS label, CASE WHEN (value - 50) / 40 > 16 THEN 1 - 1e-7 ELSE 1 / (1 + exp(-(value - 50) / 40)) END AS p FROM events)"


@query(f"WITH {_SCORED_SQL} SELECT count(*) AS n, round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 5) AS logloss, round(avg(CAST(CAST(p >= 0.5 AS INTEGER) = label AS INTEGER)), 5) AS accuracy FROM scored")
def logloss_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.logloss_accuracy(scored(spark, d)).select("n", F.round("logloss", 5).alias("logloss"), F.round("accuracy", 5).alias("accuracy"))


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.5 AND label = 1) AS fn FROM scored)
  SELECT tp, fp, fn, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall, round(2 * tp / (2 * tp + fp + fn), 5) AS f1 FROM c""")
def confusion_prf(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.precision_recall(scored(spark, d))
    return c.select("tp", "fp", "fn", *[F.round(x, 5).alias(x) for x in ("precision", "recall", "f1")])


@query(f"""WITH {_SCORED_SQL}, h AS (SELECT least(floor(p * 16777215), 16777214) AS b, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY b),
  c AS (SELECT *, sum(pos) OVER (ORDER BY b DESC) AS cum FROM h)
  SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(CAST(sum(neg * (2 * cum - pos)) AS DOUBLE) / 2 / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM c""")
def auc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(scored(spark, d)).select("positives", "negatives", F.round("auc", 6).alias("auc"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Three learners' probabilities for ten classes of each vector."""
    x = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda m: F.struct(m.alias("learner"), V.softmax(F.slice("x", m * 10 + 1, F.lit(10))).alias("p")))
    return ads.dense(spark, d).select("row_id", F.inline(x))


_VOTES_SQL = f"{DENSE_SQL}, e AS (SELECT row_id, m AS learner, x[m * 10 + 1 : m * 10 + 10] AS s FROM dense, range(0, 3) r(m)), votes AS (SELECT row_id, learner, i AS cls, exp(s[i + 1]) / list_sum(list_transform(s, lambda v: exp(v))) AS p FROM e, range(0, 10) q(i))"


@query(f"WITH {_VOTES_SQL} SELECT row_id, CAST(cls AS INTEGER) AS cls, round(avg(p), 6) AS p FROM votes GROUP BY row_id, cls")
def voting_soft(spark: SparkSession, d: str) -> DataFrame:
    flat = _votes(spark, d).select("row_id", F.posexplode("p").alias("cls", "p"))
    return flat.groupBy("row_id", "cls").agg(F.round(F.avg("p"), 6).alias("p"))


@query(f"WITH {_VOTES_SQL}, h AS (SELECT row_id, learner, arg_max(cls, (p, -cls)) AS cls FROM votes GROUP BY row_id, learner), n AS (SELECT row_id, cls, count(*) AS n FROM h GROUP BY row_id, cls) SELECT row_id, CAST(arg_max(cls, (n, -cls)) AS INTEGER) AS cls, max(n) AS votes FROM n GROUP BY row_id")
def voting_hard(spark: SparkSession, d: str) -> DataFrame:
    """The class most learners choose; ties to the smaller class."""
    n = _votes(spark, d).select("row_id", V.argmax(F.col("p")).alias("cls")).groupBy("row_id", "cls").agg(N().alias("n"))
    best = n.groupBy("row_id").agg(F.max(F.struct("n", (-F.col("cls")).alias("c"))).alias("m"))
    return best.select("row_id", (-F.col("m.c")).alias("cls"), F.col("m.n").alias("votes"))


@query("""WITH v AS (SELECT event_id, m AS learner, CAST(value > 20 * (m + 1) AS INTEGER) = CAST(event_type = 'purchase' AS INTEGER) AS ok, 1 + event_id % 3 AS w FROM events, range(0, 3) r(m)),
  e AS (SELECT learner, sum(CASE WHEN NOT ok THEN w ELSE 0 END) / sum(w) AS err FROM v GROUP BY learner)
  SELECT CAST(learner AS INTEGER) AS learner, round(err, 6) AS err, round(CASE WHEN err < 1e-4 THEN 1000 ELSE ln((1 - err) / err) / 2 END, 6) AS alpha FROM e""")
def adaboost_weights(spark: SparkSession, d: str) -> DataFrame:
    m = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("learner")
    v = table(spark, d, "events").select("event_id", "value", "event_type", m)
    ok = (F.col("value") > 20 * (F.col("learner") + 1)) == (F.col("event_type") == "purchase")
    out = metrics.adaboost_round(v.select("event_id", "learner", ok.alias("correct"), (1.0 + F.col("event_id") % 3).alias("weight")))
    return out.select("learner", F.round("err", 6).alias("err"), F.round("alpha", 6).alias("alpha"))


@query(f"""WITH {_VOCAB_SQL}, t AS (SELECT doc_id, wid, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM words w JOIN vocab v ON w.word = v.word)
  SELECT doc_id, k, coalesce(sum(wid) OVER b, 0) - wid AS ctx, count(*) OVER b - 1 AS n FROM t WINDOW b AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""".replace("SELECT doc_id, k, coalesce(sum(wid) OVER b, 0) - wid AS ctx", "SELECT doc_id, k, CAST(sum(wid) OVER b - wid AS BIGINT) AS ctx"))
def context_window_cbow(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the word ids around each place, six before and five after."""
    known = ads.words(spark, d).join(F.broadcast(vocab(spark, d)), "word")
    place = Window.partitionBy("doc_id").orderBy("pos")
    t = known.select("doc_id", F.col("wid").cast("bigint").alias("wid"), F.row_number().over(place).cast("bigint").alias("k"))
    around = Window.partitionBy("doc_id").orderBy("k").rowsBetween(-6, 5)
    return t.select("doc_id", "k", (F.sum("wid").over(around) - F.col("wid")).alias("ctx"), (F.count("wid").over(around) - 1).alias("n"))


@query(f"WITH {_VOCAB_SQL}, s AS (SELECT wid, power(freq, 0.75) AS p FROM vocab) SELECT wid, round(sum(p) OVER (ORDER BY wid) / sum(p) OVER (), 6) AS upto FROM s")
def neg_sampling_table(spark: SparkSession, d: str) -> DataFrame:
    """Upper ends of the words' intervals, drawn as frequency^0.75; the vocabulary has a fixed size."""
    s = vocab(spark, d).select("wid", F.pow("freq", F.lit(0.75)).alias("p"))
    one = Window.partitionBy(F.lit(0))
    return s.select("wid", F.round(F.sum("p").over(one.orderBy("wid")) / F.sum("p").over(one), 6).alias("upto"))


@query(f"WITH {DENSE_SQL}, c AS (SELECT row_id, i, x[i + 1] AS v FROM dense, range(0, 64) r(i)) SELECT row_id, CAST(floor(floor(i / 8) / 2) AS BIGINT) AS a, CAST(floor((i % 8) / 2) AS BIGINT) AS b, round(max(v), 6) AS v FROM c GROUP BY row_id, a, b")
def max_pooling(spark: SparkSession, d: str) -> DataFrame:
    """2 x 2 pooling of 8 x 8 maps inside each row."""
    cell = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda c: F.struct(
            F.floor(c / 4).alias("a"),
            (c % 4).cast("bigint").alias("b"),
            F.greatest(*[F.get("x", (F.floor(c / 4) * 16 + (c % 4) * 2 + o).cast("int")) for o in (0, 1, 8, 9)]).alias("v"),
        ),
    )
    return ads.dense(spark, d).select("row_id", F.inline(cell)).select("row_id", "a", "b", F.round("v", 6).alias("v"))


_KNN_SQL = f"""{DENSE_SQL}, s AS (SELECT q.row_id AS query, p.row_id, round(list_sum(list_transform(range(1, 65), lambda i: q.x[i] * p.x[i])), 6) AS score FROM dense q JOIN dense p ON q.row_id <> p.row_id WHERE q.row_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row_id) AS r FROM s)"""


@query(f"WITH {_KNN_SQL} SELECT query, row_id, score FROM r WHERE r <= 5")
def topk_knn(spark: SparkSession, d: str) -> DataFrame:
    x = ads.dense(spark, d)
    return knn.topk_scores(x, x.filter("row_id % 100 = 0"), 5)


@query(f"WITH {_KNN_SQL} SELECT query, row_id FROM r WHERE r <= 5 UNION SELECT query, row_id FROM r WHERE r BETWEEN 3 AND 8")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    x = ads.dense(spark, d)
    best = knn.topk_scores(x, x.filter("row_id % 100 = 0"), 8)
    r = best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row_id")))
    one, two = r.filter("r <= 5").select("query", "row_id"), r.filter("r BETWEEN 3 AND 8").select("query", "row_id")
    return one.unionByName(two).distinct()


@query(f"SELECT event_id, CAST(row_number() OVER (PARTITION BY CAST(floor(event_id / 1000) AS BIGINT) ORDER BY {mix_sql('event_id')}, event_id) AS INTEGER) AS place FROM events")
def hash_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Order of the rows inside their batch, by a hash of the id."""
    w = Window.partitionBy(F.floor(F.col("event_id") / 1000)).orderBy(S.hash_mix(F.col("event_id")), "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("place"))


@query(f"SELECT event_id FROM events ORDER BY {mix_sql('event_id')}, event_id LIMIT 100")
def sample_k(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows without replacement; tasks keep their own hundred."""
    return table(spark, d, "events").select("event_id").orderBy(S.hash_mix(F.col("event_id")), "event_id").limit(100)


# ---- what the reference lacks


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("""SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS viewed FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last view before it: one sort by user and time, no range join."""
    e = table(spark, d, "events").filter("event_type IN ('purchase', 'view')")
    last = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(last)
    return e.select("event_id", "event_type", view.alias("viewed")).filter("event_type = 'purchase'").select("event_id", "viewed")


@query("""SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts WHERE a.event_type = 'purchase' GROUP BY a.event_id""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Views in the six hours before each purchase, as a range frame."""
    e = table(spark, d, "events").filter("event_type IN ('purchase', 'view')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    n = F.count(F.when(F.col("event_type") == "view", 1)).over(w)
    return e.select("event_id", "event_type", n.alias("near")).filter("event_type = 'purchase' AND near > 0").select("event_id", "near")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    level = (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int")
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(level.alias("level"), N().alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    both = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))
    return both.exceptAll(table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, count(*) AS n FROM orders GROUP BY ALL")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    o = table(spark, d, "orders").select(F.year(t).alias("y"), F.quarter(t).alias("q"), (F.dayofweek(t) - 1).alias("dow"))
    return o.groupBy("y", "q", "dow").agg(N().alias("n"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY k")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return e.groupBy("k").agg(N().alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(N().alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' AS start, count(*) AS n, round(sum(value), 2) AS value FROM events, range(0, 3) r(i) GROUP BY ALL")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "3 hours", "1 hour").alias("w")
    return table(spark, d, "events").groupBy(w).agg(N().alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "n", "value")


def pushes(spark: SparkSession, d: str) -> DataFrame:
    """events as pushes of gradients: arrival, worker, epoch, key, grad."""
    e = table(spark, d, "events")
    epoch = F.floor(F.col("event_id") / 50) - F.col("user_id") % 17
    return e.select(F.col("event_id").alias("arrival"), (F.col("user_id") % 4).alias("worker"), epoch.alias("epoch"), (F.col("user_id") % 100).alias("key"), F.col("value").alias("grad"))


PUSH_SQL = "pushes AS (SELECT event_id AS arrival, user_id % 4 AS worker, CAST(floor(event_id / 50) AS BIGINT) - user_id % 17 AS epoch, user_id % 100 AS key, value AS grad FROM events)"


@query(f"WITH {PUSH_SQL}, s AS (SELECT *, max(epoch) OVER (ORDER BY arrival) AS newest FROM pushes) SELECT key, count(*) AS n, round(sum(grad), 3) AS grad FROM s WHERE epoch + 10 >= newest GROUP BY key")
def late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Pushes not more than ten epochs behind the newest that had arrived. The running maximum is taken in blocks of
    arrivals, in blocks of those, and over the maxima of the latter, so that no task holds all rows or all blocks."""
    p = pushes(spark, d).withColumn("block", F.floor(F.col("arrival") / 10000))
    tops = p.groupBy("block").agg(F.max("epoch").alias("top")).withColumn("part", F.floor(F.col("block") / 10000))
    parts = tops.groupBy("part").agg(F.max("top").alias("top"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.max("top").over(earlier(Window.partitionBy(F.lit(0)).orderBy("part"))).alias("far"))
    near = F.max("top").over(earlier(Window.partitionBy("part").orderBy("block")))
    tops = tops.withColumn("near", near).join(parts, "part").select("block", F.greatest("near", "far").alias("before"))
    inside = Window.partitionBy("block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    s = p.join(tops, "block").withColumn("newest", F.greatest(F.max("epoch").over(inside), F.coalesce("before", F.lit(-(1 << 60)))))
    return s.filter("epoch + 10 >= newest").groupBy("key").agg(N().alias("n"), F.round(F.sum("grad"), 3).alias("grad"))


@query(f"WITH {PUSH_SQL} SELECT worker, max(epoch) AS epoch, (SELECT max(epoch) FROM pushes) - max(epoch) AS behind FROM pushes GROUP BY worker")
def staleness_per_worker(spark: SparkSession, d: str) -> DataFrame:
    w = pushes(spark, d).groupBy("worker").agg(F.max("epoch").alias("epoch"))
    return w.select("worker", "epoch", (F.max("epoch").over(Window.partitionBy(F.lit(0))) - F.col("epoch")).alias("behind"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id AS node, min(ts) AS start, count(*) AS beats FROM s GROUP BY user_id, s""")
def heartbeat_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Unbroken spells of a node's beats: a silence of ten hours ends one."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    s = e.groupBy(F.session_window("t", "10 hours").alias("w"), "user_id").agg(N().alias("beats"))
    return s.select(F.col("user_id").alias("node"), F.col("w.start").cast("timestamp_ntz").alias("start"), "beats")
