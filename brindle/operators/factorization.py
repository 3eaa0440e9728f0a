"""Logistic regression and factorization machines: forward pass, gradients and full-batch training.

rows are (row_id, label, field, fid, val), parameters (fid, w, v ARRAY<DOUBLE>). A row's
sums, a feature's gradient sums and the update are aggregates and projections; Spark's
partial aggregation takes the place of shared gradients, and a hot feature's rows are
combined where they are read. Features without parameters add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import optim
from brindle.functions import scalar as S
from brindle.session import written


def initial(fids: DataFrame, k: int) -> DataFrame:
    """Id-hashed parameters with empty optimizer state for a table of fids."""
    u = lambda f: (S.hash_unit(F.col("fid") + 100000 * (f + 1)) - 0.5) / (k**0.5)
    zero = F.lit(0.0)
    return fids.select("fid").distinct().select(
        "fid",
        (S.hash_unit(F.col("fid")) - 0.5).alias("w"),
        F.array(*[u(f) for f in range(k)]).cast("array<double>").alias("v"),
        zero.alias("acc_w"),
        F.array(*[zero] * k).cast("array<double>").alias("acc_v"),
    )


def forward(rows: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """(row_id, label, logit, p, s ARRAY): score of each row, and the factor sums that the gradient needs."""
    x = rows.join(params.select("fid", "w", "v"), "fid")
    val = F.col("val")
    sums = [F.sum(F.col("v")[f] * val).alias(f"s{f}") for f in range(k)]
    squares = [F.sum(F.pow(F.col("v")[f] * val, 2)).alias(f"q{f}") for f in range(k)]
    t = x.groupBy("row_id", "label").agg(F.sum(F.col("w") * val).alias("wx"), *sums, *squares)
    pair = sum((F.pow(F.col(f"s{f}"), 2) - F.col(f"q{f}") for f in range(k)), F.lit(0.0)) / 2
    logit = F.col("wx") + pair
    s = F.array(*[F.col(f"s{f}") for f in range(k)]) if k else F.array().cast("array<double>")
    return t.select("row_id", "label", logit.alias("logit"), S.sigmoid(logit).alias("p"), s.alias("s"))


def gradients(rows: DataFrame, params: DataFrame, k: int, l2: float = 1e-3) -> DataFrame:
    """(fid, gw, gv): gradient sums, each row's own decay included.

    A row's features are gathered with their parameters while its sums are taken (a row is
    small), so rows and parameters are joined once and shuffled by row and by feature once.
    """
    val, v = F.col("val"), F.col("v")
    x = rows.join(params.select("fid", "w", "v"), "fid")
    sums = [F.sum(v[f] * val).alias(f"s{f}") for f in range(k)] + [F.sum(F.pow(v[f] * val, 2)).alias(f"q{f}") for f in range(k)]
    t = x.groupBy("row_id", "label").agg(F.sum(F.col("w") * val).alias("wx"), *sums, F.collect_list(F.struct("fid", "val", "w", "v")).alias("features"))
    logit = F.col("wx") + sum((F.pow(F.col(f"s{f}"), 2) - F.col(f"q{f}") for f in range(k)), F.lit(0.0)) / 2
    t = t.select((S.sigmoid(logit) - F.col("label")).alias("e"), *[f"s{f}" for f in range(k)], F.inline("features"))
    e = F.col("e")
    gv = [F.sum(e * val * (F.col(f"s{f}") - v[f] * val) + F.lit(l2) * v[f]) for f in range(k)]
    return t.groupBy("fid").agg(F.sum(e * val + F.lit(l2) * F.col("w")).alias("gw"), (F.array(*gv) if k else F.array().cast("array<double>")).alias("gv"))


def step(params: DataFrame, grads: DataFrame, k: int, lr: float, batch: int) -> DataFrame:
    """Adagrad over weights and factors; a feature without a gradient keeps its state."""
    x = params.join(grads, "fid", "left")
    w = optim.adagrad(F.col("w"), F.col("acc_w"), F.col("gw"), lr, batch)
    v = [optim.adagrad(F.col("v")[f], F.col("acc_v")[f], F.col("gv")[f], lr, batch) for f in range(k)]
    arr = lambda cols: (F.array(*cols) if cols else F.array()).cast("array<double>")
    return x.select("fid", w["w"].alias("w"), arr([c["w"] for c in v]).alias("v"), w["acc"].alias("acc_w"), arr([c["acc"] for c in v]).alias("acc_v"))


def train(rows: DataFrame, k: int, epochs: int, lr: float = 0.1, l2: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """Parameters after full-batch epochs, and the log-loss before each. Parameters are written after every epoch, so the plan stays short."""
    batch = max(1, rows.select("row_id").distinct().count())
    params, losses = written(initial(rows, k), "params"), []
    for _ in range(epochs):
        loss = forward(rows, params, k).agg(F.avg(S.log_loss(F.col("p"), F.col("label")))).first()[0]
        losses.append(loss if loss is not None else 0.0)
        params = written(step(params, gradients(rows, params, k, l2), k, lr, batch), "params")
    return params, losses


def ffm_initial(rows: DataFrame, k: int) -> DataFrame:
    """(fid, field, v): a vector of every feature for every field."""
    u = lambda f: (S.hash_unit(F.col("fid") + 10000 * (F.col("field") + 1) + 1000000 * (f + 1)) - 0.5) / (k**0.5)
    # fields are the columns of a form, all of them; each feature is exploded over their list
    names = sorted(r[0] for r in rows.select("field").filter("field IS NOT NULL").distinct().collect())
    all_fields = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<int>")
    return rows.select("fid").distinct().select("fid", F.explode(all_fields).alias("field")).select("fid", "field", F.array(*[u(f) for f in range(k)]).cast("array<double>").alias("v"))


def row_pairs(rows: DataFrame) -> DataFrame:
    """(row_id, label, fi, fid_i, fj, fid_j, xx) for the pairs of a row's features, in the order of (field, fid).

    A row's features are gathered (a row is small) and paired inside it.
    """
    gathered = rows.groupBy("row_id", "label").agg(F.sort_array(F.collect_list(F.struct("field", "fid", "val"))).alias("f"))
    f, n = F.col("f"), F.size("f")
    pair = lambda i: F.transform(F.slice(f, i + 1, n), lambda b: F.struct(f[i - 1]["field"].alias("fi"), f[i - 1]["fid"].alias("fid_i"), b["field"].alias("fj"), b["fid"].alias("fid_j"), (f[i - 1]["val"] * b["val"]).alias("xx")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), pair))
    return gathered.select("row_id", "label", F.inline(pairs))


def ffm_forward(pairs: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """(row_id, label, logit, p) of field-aware factorization without a linear part."""
    a = params.select(F.col("fid").alias("fid_i"), F.col("field").alias("fj"), F.col("v").alias("a"))
    b = params.select(F.col("fid").alias("fid_j"), F.col("field").alias("fi"), F.col("v").alias("b"))
    x = pairs.join(a, ["fid_i", "fj"]).join(b, ["fid_j", "fi"])
    term = sum((F.col("a")[f] * F.col("b")[f] for f in range(k)), F.lit(0.0)) * F.col("xx")
    t = x.groupBy("row_id", "label").agg(F.sum(term).alias("logit"))
    return t.withColumn("p", S.sigmoid(F.col("logit")))


def ffm_step(pairs: DataFrame, params: DataFrame, k: int, lr: float, l2: float = 1e-3) -> DataFrame:
    """One plain gradient step of the field-aware vectors, each row's own decay included, mean over rows.

    A row's pairs are gathered with their vectors while it is scored, so pairs and vectors are
    joined once; a pair gives the gradients of both of its vectors.
    """
    n = max(1, pairs.select("row_id").distinct().count())
    a = params.select(F.col("fid").alias("fid_i"), F.col("field").alias("fj"), F.col("v").alias("a"))
    b = params.select(F.col("fid").alias("fid_j"), F.col("field").alias("fi"), F.col("v").alias("b"))
    x = pairs.join(a, ["fid_i", "fj"]).join(b, ["fid_j", "fi"])
    term = sum((F.col("a")[f] * F.col("b")[f] for f in range(k)), F.lit(0.0)) * F.col("xx")
    t = x.groupBy("row_id", "label").agg(F.sum(term).alias("logit"), F.collect_list(F.struct("fid_i", "fj", "fid_j", "fi", "xx", "a", "b")).alias("pairs"))
    t = t.select((S.sigmoid(F.col("logit")) - F.col("label")).alias("e"), F.inline("pairs"))
    e = F.col("e") * F.col("xx")
    side = lambda fid, field, own, other: F.struct(F.col(fid).alias("fid"), F.col(field).alias("field"), *[(e * F.col(other)[f] + F.lit(l2) * F.col(own)[f]).alias(f"g{f}") for f in range(k)])
    both = t.select(F.inline(F.array(side("fid_i", "fj", "a", "b"), side("fid_j", "fi", "b", "a"))))
    g = both.groupBy("fid", "field").agg(*[F.sum(f"g{f}").alias(f"g{f}") for f in range(k)])
    y = params.join(g, ["fid", "field"], "left")
    return y.select("fid", "field", F.array(*[F.col("v")[f] - F.lit(lr / n) * F.coalesce(f"g{f}", F.lit(0.0)) for f in range(k)]).alias("v"))


def ffm_train(rows: DataFrame, k: int, epochs: int, lr: float = 2.0) -> tuple[DataFrame, list[float]]:
    pairs, params, losses = row_pairs(rows), written(ffm_initial(rows, k), "ffm"), []
    for _ in range(epochs):
        losses.append(ffm_forward(pairs, params, k).agg(F.avg(S.log_loss(F.col("p"), F.col("label")))).first()[0])
        params = written(ffm_step(pairs, params, k, lr), "ffm")
    return params, losses
