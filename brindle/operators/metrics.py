"""Scores of predictions: log-loss, accuracy, precision and recall, area under the curve, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalar as S


def logloss_accuracy(scored: DataFrame) -> DataFrame:
    """(n, logloss, accuracy) of (label, p). Rows with a null in either don't count."""
    s = scored.filter("label IS NOT NULL AND p IS NOT NULL")
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double")
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(S.log_loss(F.col("p"), F.col("label"))).alias("logloss"), F.avg(hit).alias("accuracy"))


def precision_recall(scored: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of (label, p) at one half; no positives found: precision 1, none there: recall 1."""
    yes = F.col("p") >= 0.5
    c = scored.agg(
        F.count_if(yes & (F.col("label") == 1)).alias("tp"), F.count_if(yes & (F.col("label") == 0)).alias("fp"), F.count_if(~yes & (F.col("label") == 1)).alias("fn")
    )
    c = c.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))).withColumn(
        "recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))
    )
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def auc(scored: DataFrame, bits: int = 24) -> DataFrame:
    """(positives, negatives, auc) of (label, p), with scores in 2^bits - 1 buckets and trapezoids between them.

    Buckets are counted with partial aggregation. Prefix sums run in two levels: within
    ranges of 4096 buckets, and over the at most 4096 range totals, so that no task sorts
    all buckets. 0 if a class is empty.
    """
    n = (1 << bits) - 1
    bucket = F.least(F.greatest(F.floor(F.col("p") * n), F.lit(0)), F.lit(n - 1)).cast("bigint")
    s = scored.filter("label IS NOT NULL AND p IS NOT NULL").select(bucket.alias("b"), "label")
    h = s.groupBy("b").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    h = h.withColumn("r", F.floor(F.col("b") / 4096))
    ranges = h.groupBy("r").agg(F.sum("pos").alias("rp"))
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("rp").over(over), F.lit(0)).alias("above"))
    inside = Window.partitionBy("r").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(ranges, "r").withColumn("cum", F.col("above") + F.sum("pos").over(inside))
    area = F.sum(F.col("neg").cast("double") * (2.0 * F.col("cum") - F.col("pos")) / 2.0)
    out = h.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), area.alias("area"))
    return out.select("positives", "negatives", F.coalesce(F.try_divide("area", F.col("positives").cast("double") * F.col("negatives")), F.lit(0.0)).alias("auc"))


def adaboost_reweight(votes: DataFrame, rounds: DataFrame) -> DataFrame:
    """(row_id, learner, weight) for the next round: weights by exp(-alpha) where the learner was right, exp(alpha) where it
    was wrong, to a sum of 1 a learner. votes as for ``adaboost_round``, rounds its result: a row a learner."""
    alpha = F.least("alpha", F.lit(50.0))
    moved = votes.join(F.broadcast(rounds.select("learner", "alpha")), "learner").select("row_id", "learner", (F.col("weight") * F.exp(F.when(F.col("correct"), -alpha).otherwise(alpha))).alias("w"))
    total = moved.groupBy("learner").agg(F.sum("w").alias("total"))
    return moved.join(F.broadcast(total), "learner").select("row_id", "learner", (F.col("w") / F.col("total")).alias("weight"))


def adaboost_round(votes: DataFrame) -> DataFrame:
    """(learner, err, alpha) of (row_id, learner, correct, weight): weighted error, and 1/2 ln((1 - e) / e), 1000 under 1e-4."""
    e = votes.groupBy("learner").agg((F.sum(F.when(~F.col("correct"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("err"))
    return e.withColumn("alpha", F.when(F.col("err") < 1e-4, F.lit(1000.0)).otherwise(F.log((1 - F.col("err")) / F.greatest("err", F.lit(1e-12))) / 2))
