"""Online learning and liveness on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import optim
from brindle.functions import scalar as S


def push_gradients(stream: DataFrame, state_dir: str, checkpoint: str, lr_alpha: float = 0.15) -> None:
    """Follow-the-leader logistic weights over a stream of (row_id, label, fid, val), until what is there is read.

    Every micro-batch reads the parameter table of the batch before, adds its summed
    gradients and writes a table of its own under its number: a batch that is run again
    writes the same table again, so each row counts once.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{state_dir}/{number - 1}"
        held = spark.read.parquet(before) if number else spark.createDataFrame([], "fid bigint, w double, n double, z double")
        held = batch.select("fid").distinct().join(held, "fid", "full").select("fid", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w", "n", "z")])
        x = batch.join(held.select("fid", "w"), "fid")
        p = x.groupBy("row_id", "label").agg(S.sigmoid(F.sum(F.col("w") * F.col("val"))).alias("p"))
        g = batch.join(p.select("row_id", "p"), "row_id").groupBy("fid").agg(F.sum((F.col("p") - F.col("label")) * F.col("val")).alias("g"))
        new = held.join(g, "fid", "left")
        step = optim.ftrl(F.col("w"), F.col("n"), F.col("z"), F.col("g"), alpha=lr_alpha, l1=0.1)
        new.select("fid", *[F.when(F.col("g").isNull(), F.col(c)).otherwise(step[c]).alias(c) for c in ("w", "n", "z")]).write.mode("overwrite").parquet(f"{state_dir}/{number}")
        spark.createDataFrame([(number,)], "number bigint").write.mode("overwrite").parquet(f"{state_dir}/last")

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, state_dir: str) -> DataFrame:
    """The parameter table of the last batch."""
    number = spark.read.schema("number bigint").parquet(f"{state_dir}/last").first()["number"]
    return spark.read.parquet(f"{state_dir}/{number}")


def matched(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Inner join of two streams (user_id, event_id, ts): events of the right no more than ``within`` before those of the left.

    Watermarks and the bound on times let the state of either side be dropped.
    """
    one = left.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("t")).withWatermark("t", late)
    two = right.select(F.col("user_id").alias("user"), F.col("event_id").alias("before_id"), F.col("ts").cast("timestamp").alias("before")).withWatermark("before", late)
    near = (F.col("user_id") == F.col("user")) & (F.col("before") <= F.col("t")) & (F.col("before") >= F.col("t") - F.expr(f"INTERVAL {within}"))
    return one.join(two, near).select("event_id", "before_id")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; what comes later than the watermark is dropped."""
    t = stream.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return t.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def liveness(stream: DataFrame, silence: str = "10 hours", late: str = "1 hour") -> DataFrame:
    """Unbroken spells of each node's beats."""
    t = stream.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    s = t.groupBy(F.session_window("t", silence).alias("w"), F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("beats"))
    return s.select("node", F.col("w.start").alias("start"), "beats")
