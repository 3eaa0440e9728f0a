"""Per-key results and eager joins against brute force."""

import random

from pyspark.sql import functions as F

from brindle.operators.skew import eager_join_aggregate, top_row_per_key

ROWS = "k bigint, v double, r bigint, other string"


def brute_top(rows):
    best = {}
    for k, v, r, _ in rows:
        if k is not None and v is not None:
            old = best.get(k)
            if old is None or v > old[0] or (v == old[0] and r < old[1]):
                best[k] = (v, r)
    return best


def test_top_row_with_a_hot_key_ties_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7] * 5 + [None, *range(20)]), rng.choice([None, 1.0, 2.0, rng.random()]), i % 300, "x") for i in range(3000)]
    got = {x["k"]: (x["v"], x["r"]) for x in top_row_per_key(spark.createDataFrame(rows, ROWS), "k", "v", "r").collect()}
    assert got == brute_top(rows)


def test_top_row_of_nothing_and_of_clashing_names(spark):
    assert top_row_per_key(spark.createDataFrame([], ROWS), "k", "v", "r").count() == 0
    # columns that bear the operator's inner names
    df = spark.createDataFrame([(1, 2.0, 3, 9, 9), (1, 5.0, 4, 9, 9)], "k bigint, n double, top bigint, v int, bound_key int")
    got = top_row_per_key(df, "k", "n", "top").collect()
    assert [(x["k"], x["n"], x["top"], x["n_rows"], x["n_ties"]) for x in got] == [(1, 5.0, 4, 2, 1)]


def test_top_row_takes_nan_as_largest(spark):
    df = spark.createDataFrame([(1, float("nan"), 5, ""), (1, 9.0, 2, "")], ROWS)
    assert top_row_per_key(df, "k", "v", "r").first()["r"] == 5


def test_top_row_never_sends_a_hot_keys_rows_to_one_task(spark):
    df = spark.range(50_000).select(F.lit(1).cast("bigint").alias("k"), (F.col("id") % 10).cast("double").alias("v"), F.col("id").alias("r"))
    top = top_row_per_key(df, "k", "v", "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 1 and plan.count("partial_max") >= 1 and "Window" not in plan
    top.collect()
    assert "ReusedExchange" in top._jdf.queryExecution().executedPlan().toString()
    assert top_row_per_key(df, "k", "v", "r").first()["r"] == 9


def test_eager_join_equals_the_join(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.choice([1] * 4 + [2, 3, None]), rng.choice([None, rng.random()]), rng.choice("ab")) for _ in range(400)], "k int, x double, g string")
    b = spark.createDataFrame([(rng.choice([1] * 4 + [2, 4, None]), rng.random(), rng.choice("cd")) for _ in range(300)], "k int, y double, h string")
    got = eager_join_aggregate(a, b, "k", {"sx": F.col("x")}, {"sy": F.col("y")}, ["g"], ["h"]).collect()
    want = a.join(b, "k").groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()
    key = lambda r: (r["g"], r["h"])
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x["n_pairs"] == y["n"] and abs(x["sx"] - y["sx"]) < 1e-6 and abs(x["sy"] - y["sy"]) < 1e-6
    assert eager_join_aggregate(a.limit(0), b, "k").count() == 0


def test_counts_of_a_key_hot_on_both_sides_do_not_overflow(spark):
    """Five thousand million rows of one key on either side, as states that are already compact."""
    big = spark.createDataFrame([(1, 5_000_000_000)], "k int, n bigint")
    many = F.sequence(F.lit(1), F.lit(3))
    a = big.select("k", F.explode(many).alias("i"))
    out = eager_join_aggregate(a, a, "k", {"s": F.lit(4e18)}, {"t": F.lit(4e18)}).first()
    assert out["n_pairs"] == 9 and abs(out["s"] - 36e18) < 1e6
    product = big.select((F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)").alias("p")).first()["p"]
    assert int(product) == 25 * 10**18
