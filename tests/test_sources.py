"""Readers and writers give back what they were given."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import ads


def test_sparse_rows_and_models_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, 3, 7, 0.5), (1, 1, 1, 4, 9, 2.0), (2, 0, 0, 3, 7, 1.0)], ads.SPARSE)
    ads.write_sparse_text(rows, f"{tmp_path}/rows")
    got = ads.read_sparse_text(spark, f"{tmp_path}/rows").select("label", "pos", "field", "fid", "val").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 3, 7, 1.0), (1, 0, 3, 7, 0.5), (1, 1, 4, 9, 2.0)]
    params = spark.createDataFrame([(1, 0.0, [0.0, 0.5]), (2, 0.3, [0.0, 0.0]), (3, 0.0, [0.0, 0.0]), (4, 0.0, [])], "fid bigint, w double, v array<double>")
    ads.write_model(params, f"{tmp_path}/model")
    assert sorted(r["fid"] for r in ads.read_model(spark, f"{tmp_path}/model").collect()) == [1, 2]
    ads.write_scores(spark.createDataFrame([(1, 0.25, "x")], "row_id bigint, p double, more string"), f"{tmp_path}/scores")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/scores").collect()] == [(1, 0.25)]


def test_vectors_mixtures_and_vocabularies_come_back(spark, tmp_path):
    v = spark.createDataFrame([("a", [0.5, -1.25]), ("b", [3.0, 1e-9]), (None, [1.0]), ("c", None)], "name string, x array<double>")
    ads.write_vectors(v, f"{tmp_path}/vectors", "name", "x")
    assert sorted((r["name"], r["x"]) for r in ads.read_vectors(spark, f"{tmp_path}/vectors").collect()) == [("a", [0.5, -1.25]), ("b", [3.0, 1e-9])]
    model = [(0, 0.25, [1.0], [0.5]), (1, 0.75, [2.0], [0.25])]
    ads.write_mixture(model, spark, f"{tmp_path}/mixture")
    assert ads.read_mixture(spark, f"{tmp_path}/mixture") == model
    (tmp_path / "vocab.txt").write_text("0 the 90\n1 new york 40\n2 sea 40\nbroken\n")
    assert [tuple(r) for r in ads.read_vocab(spark, str(tmp_path / "vocab.txt"), 2).orderBy("wid").collect()] == [(0, "the", 90), (1, "new york", 40)]
    (tmp_path / "worse.txt").write_text("0 a 1\n1 b 2\n")
    with pytest.raises(ValueError):
        ads.read_vocab(spark, str(tmp_path / "worse.txt"))


def test_two_streams_meet(spark, small, tmp_path):
    from brindle.streaming import online

    e = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    e.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/events")
    out = online.matched(stream.filter("event_type = 'purchase'"), stream.filter("event_type = 'view'"), "24 hours")
    out.writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("before_id"), F.col("ts").alias("before"))
    want = e.filter("event_type = 'purchase'").join(v, "user_id").filter("before <= ts AND before >= ts - INTERVAL 24 HOURS").count()
    assert spark.table("met").count() == want > 0
