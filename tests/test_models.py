"""Gradients by finite differences, EM and boosting by monotony, networks by falling losses, the stream by its batch twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.operators import boosting, deep, embedding, factorization, forest, graph, knn, metrics, mixtures, nets
from brindle.plans.models import _cluster_rows, _gbm, _start
from brindle.sources import ads
from brindle.streaming import online


def test_fm_gradient_matches_differences(spark, small):
    rows = ads.ad_long(spark, small).filter("row_id < 60").cache()
    k, p0 = 2, factorization.initial(rows, 2).cache()
    loss = lambda p: factorization.forward(rows, p, k).agg(F.sum(S.log_loss(F.col("p"), F.col("label")))).first()[0]
    g = {r["fid"]: r for r in factorization.gradients(rows, p0, k, l2=0.0).collect()}
    for fid in sorted(g)[:2]:
        for what, grad in (("w", g[fid]["gw"]), ("v", g[fid]["gv"][1])):
            e = 1e-4
            def moved(s, fid=fid, what=what):
                hit = F.col("fid") == fid
                return p0.withColumn("w", F.col("w") + F.when(hit & F.lit(what == "w"), s).otherwise(0.0)).withColumn(
                    "v", F.transform("v", lambda v, i: v + F.when(hit & (i == 1) & F.lit(what == "v"), s).otherwise(0.0))
                )
            assert (loss(moved(e)) - loss(moved(-e))) / (2 * e) == pytest.approx(grad, abs=1e-3)


def test_fm_identity_equals_pair_sum(spark, small):
    rows = ads.ad_long(spark, small).filter("row_id < 40")
    p = factorization.initial(rows, 3)
    par = {r["fid"]: r for r in p.collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r["row_id"], []).append(r)
    for r in factorization.forward(rows, p, 3).collect():
        f = by[r["row_id"]]
        z = sum(par[a["fid"]]["w"] * a["val"] for a in f)
        z += sum(np.dot(par[a["fid"]]["v"], par[b["fid"]]["v"]) * a["val"] * b["val"] for i, a in enumerate(f) for b in f[i + 1 :])
        assert r["logit"] == pytest.approx(z)


def test_training_losses_fall(spark, small):
    rows = ads.ad_long(spark, small).cache()
    _, losses = factorization.train(rows, 2, 3)
    assert losses[-1] < losses[0]
    _, losses = factorization.ffm_train(rows, 2, 3)
    assert losses[-1] <= losses[0]


def test_mixture_likelihood_never_falls(spark, small):
    _, lls = mixtures.mixture_train(_cluster_rows(spark, small).cache(), _start(), 4)
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:], strict=False))


def test_quantiser_error_falls(spark, small):
    _, errors = mixtures.quantiser_train(ads.dense(spark, small).cache(), 64, 4, 8, 4)
    assert errors[-1] < errors[0]


def test_boosting_reduces_loss_and_predict_agrees(spark, small):
    x = ads.dense(spark, small).filter("row_id < 120").cache()
    f = _gbm(spark, small)[1].cache()
    rows = x.select("row_id", (F.col("label") % 3).alias("label"))
    forest, losses, margins = boosting.train(rows, f, 3, 2, 2)
    assert losses[1] < losses[0]
    a = {r["row_id"]: r["m"] for r in margins.collect()}
    for r in boosting.predict(rows, f, forest, 3).collect():
        assert r["m"] == pytest.approx(a[r["row_id"]])


def test_binary_boosting_over_samples(spark, small):
    x = ads.dense(spark, small).filter("row_id < 200").cache()
    f = _gbm(spark, small)[1].cache()
    rows = x.select("row_id", (F.col("x")[0] > 0).cast("int").alias("label"))
    forest_, losses, margins = boosting.train(rows, f, 1, 3, 2, row_share=0.7, feature_share=0.9)
    assert losses[-1] < losses[0] and margins.count() == rows.count()
    a = {r["row_id"]: r["m"] for r in margins.collect()}
    assert all(r["m"] == pytest.approx(a[r["row_id"]]) for r in boosting.predict(rows, f, forest_, 1).collect())


def test_graph_gradients_match_differences(spark):
    rows = spark.createDataFrame([(0.3, -0.7, 1.0), (1.2, 0.4, 0.0), (-0.5, 0.9, 1.0)], "a double, b double, label double")
    x, w, b = graph.source("a", "b"), graph.trainable("w", [0.4, -0.2]), graph.trainable("b", [0.1])
    for kind in ("sigmoid", "tanh", "relu", "identity"):
        h = graph.activation(graph.add(graph.matmul(w, x), b), kind)
        for loss in (graph.logistic_loss(graph.multiply(h, b), graph.source("label")), graph.square_loss(h, graph.source("label"))):
            p = {"w": [0.4, -0.2], "b": [0.1]}
            _, g, n = graph.gradients(rows, loss, p)
            assert n == 3
            for name, k in (("w", 1), ("b", 0)):
                moved = lambda e, name=name, k=k: {m: [v + (e if (m, i) == (name, k) else 0) for i, v in enumerate(vs)] for m, vs in p.items()}
                up, down = (graph.gradients(rows, loss, moved(e))[0] for e in (1e-5, -1e-5))
                assert (up - down) / 2e-5 == pytest.approx(g[name][k], abs=1e-5)
    params, losses = graph.train(rows, loss, 4, 0.2)
    assert losses[-1] < losses[0] and set(params) == {"w", "b"}
    assert graph.train(rows.limit(0), loss, 2, 0.1)[1] == []
    w.inputs.append(h)
    with pytest.raises(ValueError):
        graph.evaluate(h)


NETS = {
    "cnn": (lambda: nets.cnn(8, 3), nets.softmax_loss, "label"),
    "rnn": (lambda: nets.rnn(8, 8, 5, 3), nets.softmax_loss, "label"),
    "vae": (lambda: [nets.Dense(64, 6, "tanh"), nets.Dense(6, 64)], nets.rebuild_loss, "x"),
}


@pytest.mark.parametrize("name", NETS)
def test_network_gradients_match_differences(name):
    make, loss, target = NETS[name]
    rng = np.random.default_rng(0)
    net, x = make(), rng.normal(size=(4, 64))
    t = x if target == "x" else np.array([0, 1, 2, 1])
    _, g = nets.gradients(net, x, t, loss)
    for p, gp in zip(nets.params(net), g, strict=True):
        for at in rng.choice(p.size, min(4, p.size), replace=False):
            i = np.unravel_index(at, p.shape)
            old, e = p[i], 1e-5
            p[i] = old + e
            up = nets.gradients(net, x, t, loss)[0]
            p[i] = old - e
            down = nets.gradients(net, x, t, loss)[0]
            p[i] = old
            assert (up - down) / (2 * e) == pytest.approx(gp[i], rel=1e-3, abs=1e-4)


def test_networks_learn(spark, small):
    rows = ads.dense(spark, small).filter("row_id < 200").cache()
    for net, loss, target in ((nets.cnn(8, 10), nets.softmax_loss, "label"), (nets.rnn(8, 8, 8, 10), nets.softmax_loss, "label"), (nets.vae(64, 16, 4), nets.rebuild_loss, "x")):
        losses = nets.train(rows, net, loss, 4, lr=0.05, target=target)
        assert losses[-1] < losses[0]
    assert nets.train(rows.limit(0), nets.cnn(8, 10), nets.softmax_loss, 2) == []


def test_minibatches_dropout_and_held_out_rows(spark, small):
    rows = ads.dense(spark, small).withColumn("label", (F.col("x")[0] > 0).cast("int")).withColumn("x", F.transform("x", lambda v: v * 8)).cache()
    net = [nets.Dense(64, 16, "tanh"), nets.Dropout(0.2), nets.Dense(16, 10)]
    losses = nets.train(rows, net, nets.softmax_loss, 3, parts=3, held_out=0.2)
    assert len(losses) == 3 and losses[-1] < losses[0]
    a = {r["row_id"]: r["y"] for r in nets.predict(rows, net).collect()}
    assert len(a) == rows.count() and all(len(y) == 10 for y in a.values())
    drop = nets.Dropout(0.5)
    x = np.ones((200, 30))
    assert (drop.forward(x) == x).all()
    drop.training = True
    y = drop.forward(x)
    assert set(np.unique(y)) == {0.0, 2.0} and abs(y.mean() - 1) < 0.05 and (drop.backward(x)[0] == y).all()


@pytest.mark.parametrize("kind", ["nfm", "wide_deep"])
def test_deep_models_learn_weights_and_vectors(spark, small, kind):
    k = 2
    rows = ads.ad_long(spark, small).filter("row_id < 80").cache()
    shape = deep.nfm(k) if kind == "nfm" else deep.wide_deep(k, [0, 1, 2, 3])
    net = [nets.Dense(shape.width, 4, "sigmoid"), nets.Dense(4, 1)]
    p0 = factorization.initial(rows, k).cache()
    grads, g, loss, n = deep.step(rows, p0, k, shape, net, l2=0.0)
    assert n == 80
    by = {r["fid"]: r for r in grads.collect()}
    value = lambda p: deep.step(rows, p, k, shape, net, l2=0.0)[2]
    fid, e = sorted(by)[1], 1e-4
    for what, want in (("w", by[fid]["gw"]), ("v", by[fid]["gv"][1])):
        move = lambda s, what=what: p0.withColumn("w", F.col("w") + F.when((F.col("fid") == fid) & F.lit(what == "w"), s).otherwise(0.0)).withColumn(
            "v", F.transform("v", lambda v, i: v + F.when((F.col("fid") == fid) & (i == 1) & F.lit(what == "v"), s).otherwise(0.0))
        )
        assert (value(move(e)) - value(move(-e))) / (2 * e) == pytest.approx(want, abs=1e-3)
    net[1].p[0][2, 0] += e
    up = value(p0)
    net[1].p[0][2, 0] -= 2 * e
    down = value(p0)
    net[1].p[0][2, 0] += e
    assert (up - down) / (2 * e) == pytest.approx(g[2][2, 0], abs=1e-3)
    params, net, losses = deep.train(rows, k, shape, net, 3)
    assert losses[-1] < losses[0] and params.join(p0.select("fid", F.col("v").alias("v0")), "fid").filter("v <> v0").count() > 0
    assert deep.predict(rows, params, k, shape, net).filter("p > 0 AND p < 1").count() == 80
    assert deep.train(rows.limit(0), k, shape, net, 2)[2] == []


def test_forest_holds_every_vector_and_finds_its_neighbours(spark, small, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE", 200)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 16)) + rng.normal(size=(12, 16)).repeat(100, axis=0) * 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "row_id bigint, x array<double>")
    trees = forest.fit(rows, 8)
    held = forest.placed(rows, trees).groupBy("tree").agg(F.countDistinct("row_id").alias("n")).collect()
    assert [r["n"] for r in held] == [1200] * 8
    got = {(r["query"], r["row_id"]) for r in forest.nearest(rows, rows.filter("row_id % 20 = 0"), trees, 5).collect()}
    want = set()
    for q in range(0, 1200, 20):
        s = x @ x[q]
        want |= {(q, int(j)) for j in [j for j in np.argsort(-s) if j != q][:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert forest.nearest(rows.limit(0), rows.limit(0), forest.fit(rows.limit(0), 2), 5).count() == 0


def test_huffman_is_prefix_free_and_short():
    codes, paths = embedding.huffman([50, 20, 20, 5, 3, 2])
    assert all(not b.startswith(a) for i, a in enumerate(codes) for j, b in enumerate(codes) if i != j)
    assert len(codes[0]) < len(codes[-1]) and all(len(c) == len(p) for c, p in zip(codes, paths, strict=True))
    assert embedding.huffman([3]) == (["0"], [[0]])


def test_words_used_together_come_close(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [int(v) for v in rng.integers(0, 5, 40) + 5 * (i % 2)]) for i in range(60)]
    vectors, losses = embedding.cbow_train(spark.createDataFrame(docs, "doc_id bigint, wids array<int>"), [240] * 10, dim=8, epochs=5, negatives=4, lr=0.02)
    assert losses[-1] < losses[0] and np.allclose((vectors**2).sum(axis=1), 1)
    s = vectors @ vectors.T
    assert s[:5, :5].mean() > s[:5, 5:].mean() and s[5:, 5:].mean() > s[:5, 5:].mean()
    assert embedding.cbow_train(spark.createDataFrame([(1, [1, 2])], "doc_id bigint, wids array<int>"), [1, 1, 1], dim=4)[1] == []


def test_forest_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)) + rng.normal(size=(8, 16)).repeat(50, axis=0) * 4
    forest, ids, hit = embedding.build_forest(np.arange(400), x, 8), np.arange(400), 0
    for q in range(0, 400, 20):
        c = embedding.query_forest(forest, x[q], 80)
        exact = set(ids[np.argsort(((x - x[q]) ** 2).sum(axis=1))[:10]])
        hit += len(exact & set(c.tolist()))
    assert hit / 200 >= 0.8


def test_hebbian_finds_the_leading_component():
    rng = np.random.default_rng(1)
    cov = np.cov(rng.normal(size=(500, 4)) @ np.diag([4, 2, 1, 0.5]), rowvar=False)
    w = embedding.hebbian(cov, 1)[0]
    assert abs(w @ np.linalg.eigh(cov)[1][:, -1]) == pytest.approx(1, abs=1e-3)


def test_auc_equals_the_rank_formula(spark):
    rng = np.random.default_rng(2)
    p, y = rng.random(500).round(2), rng.integers(0, 2, 500)
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, label int")
    assert metrics.auc(df).first()["auc"] == pytest.approx(want)
    assert metrics.auc(df.filter("label = 1")).first()["auc"] == 0.0


def test_quantile_round_trip(spark):
    df = spark.range(1, 100).select((F.col("id") / 100.0).alias("p"))
    worst = df.select(F.max(F.abs(S.normal_cdf(S.inverse_cdf(F.col("p"))) - F.col("p")))).first()[0]
    assert worst < 1e-6


def test_topk_takes_nothing_from_empty_tables(spark):
    e = spark.createDataFrame([], "row_id bigint, x array<double>")
    assert knn.topk_scores(e, e, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0])], "row_id bigint, x array<double>")
    assert [(r["query"], r["row_id"]) for r in knn.topk_scores(one, one.filter("row_id = 1"), 3).collect()] == [(1, 3)]


def test_stream_equals_its_batches(spark, tmp_path):
    rows = [(i, i % 2, 0, 0, i % 5, 1.0) for i in range(60)]
    schema = "row_id bigint, label int, pos int, field int, fid bigint, val double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    online.push_gradients(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    got = {r["fid"]: r["w"] for r in online.latest(spark, str(tmp_path / "state")).collect()}
    # one batch from zero weights: n and z from the summed gradient, as in the formula
    for fid in range(5):
        g = sum(0.5 - label for r, label, *_, f, _ in rows if f == fid)
        z, n = g, g * g
        want = 0.0 if abs(z) <= 0.1 else -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.15 + 1)
        assert got[fid] == pytest.approx(want)


def test_windowed_stream_equals_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = online.windowed_counts(stream, late="2 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_sparse_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 0, 2, 30, 0.5), (0, 1, 1, 3, 40, 1.0)], ads.SPARSE)
    ads.write_sparse_text(rows, str(tmp_path / "t"))
    back = ads.read_sparse_text(spark, str(tmp_path / "t")).drop("row_id").collect()
    assert sorted(map(tuple, back)) == [(1, 0, 2, 30, 0.5), (1, 1, 3, 40, 1.0)]
    bad = spark.createDataFrame([(1, "1 2:3 x:1:2 4:5:6"), (2, "nope 1:1:1"), (3, None), (4, "0")], "id bigint, t string")
    assert [tuple(r) for r in ads.scan_sparse_text(bad, "id", "t").collect()] == [(1, 1, 0, 4, 5, 6.0)]
