"""Gaussian mixtures, topic models, k-means and product quantisation as EM over aggregates.

Model tables are small (components, topics by words, code words); data rows are read where
they lie and reduced with partial aggregation, one row a component, topic, word or code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import vec as V

Gauss = tuple[int, float, list[float], list[float]]


def doubles(x: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def logpdf(x: Column, weight: float, mu: list[float], sigma2: list[float]) -> Column:
    """Log of weight times a diagonal normal density."""
    d = F.zip_with(F.zip_with(x, doubles(mu), lambda a, m: (a - m) * (a - m)), doubles(sigma2), lambda q, s: q / s)
    const = math.log(max(weight, 1e-300)) - 0.5 * (sum(math.log(s) for s in sigma2) + len(mu) * math.log(2 * math.pi))
    return F.lit(const) - V.total(d) / 2


def log_densities(rows: DataFrame, model: list[Gauss]) -> DataFrame:
    """rows with lp, the components' log densities."""
    return rows.withColumn("lp", F.array(*[logpdf(F.col("x"), w, mu, s2) for _, w, mu, s2 in model]))


def responsibilities(rows: DataFrame, model: list[Gauss]) -> DataFrame:
    """rows with r, the components' shares, and ll, the log-likelihood."""
    m = log_densities(rows, model).withColumn("ll", V.logsumexp(F.col("lp")))
    return m.withColumn("r", F.transform("lp", lambda v: F.exp(v - F.col("ll")))).drop("lp")


def mixture_step(rows: DataFrame, model: list[Gauss], floor: float = 0.01) -> tuple[list[Gauss], float]:
    """One EM step: the new components and the log-likelihood of the old ones."""
    k, dim = len(model), len(model[0][2])
    r = responsibilities(rows, model)
    flat = r.select(F.posexplode("r").alias("c", "r"), "x")
    # moments about the old means, which keep the difference of squares small
    centre = F.element_at(F.array(*[doubles(m[2]) for m in model]), F.col("c") + 1)
    flat = flat.withColumn("y", V.sub(F.col("x"), centre))
    s = flat.groupBy("c").agg(
        F.sum("r").alias("n"), *[F.sum(F.col("r") * F.col("y")[j]).alias(f"a{j}") for j in range(dim)], *[F.sum(F.col("r") * F.col("y")[j] * F.col("y")[j]).alias(f"b{j}") for j in range(dim)]
    )
    got = {x["c"]: x for x in s.collect()}
    ll = r.agg(F.sum("ll")).first()[0] or 0.0
    total = sum(x["n"] for x in got.values()) or 1.0
    out = []
    for c in range(k):
        ident, weight, mu, s2 = model[c]
        x = got.get(c)
        if x is None or x["n"] <= 1e-12:
            out.append((ident, 0.0, mu, s2))
            continue
        a, b = [x[f"a{j}"] / x["n"] for j in range(dim)], [x[f"b{j}"] / x["n"] for j in range(dim)]
        out.append((ident, x["n"] / total, [m + v for m, v in zip(mu, a, strict=True)], [max(floor, q - v * v) for q, v in zip(b, a, strict=True)]))
    return out, ll


def mixture_train(rows: DataFrame, model: list[Gauss], epochs: int, tolerance: float = 1e-3) -> tuple[list[Gauss], list[float]]:
    """EM until the log-likelihood moves by tolerance at most, which never falls."""
    lls: list[float] = []
    for _ in range(epochs):
        model, ll = mixture_step(rows, model)
        if lls and abs(ll - lls[-1]) <= tolerance:
            lls.append(ll)
            break
        lls.append(ll)
    return model, lls


def plsa_step(counts: DataFrame, dz: DataFrame, zw: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """New p(z|d) and p(w|z) of k topics from counts (doc_id, wid, n), dz (doc_id, pz ARRAY) and zw (wid, pw ARRAY).

    Both model tables hold a topic array a row, so the join multiplies no rows.
    """
    j = plsa_joined(counts, dz, zw)
    sums = [F.sum(F.col("n") * F.col("q")[z]).alias(f"q{z}") for z in range(k)]
    arr = F.array(*[F.col(f"q{z}") for z in range(k)])
    by_doc = j.groupBy("doc_id").agg(F.sum("n").alias("nd"), *sums).select("doc_id", V.scale(arr, F.lit(1.0) / F.col("nd")).alias("pz"))
    by_word = j.groupBy("wid").agg(*sums).select("wid", arr.alias("s"))
    totals = by_word.agg(*[F.sum(F.col("s")[z]).alias(f"t{z}") for z in range(k)]).first()
    inv = doubles([1.0 / max(totals[f"t{z}"] or 0.0, 1e-300) for z in range(k)])
    return by_doc, by_word.select("wid", F.zip_with("s", inv, lambda a, b: a * b).alias("pw"))


def plsa_joined(counts: DataFrame, dz: DataFrame, zw: DataFrame) -> DataFrame:
    """counts with joint, p(w|z) p(z|d) by topic, and q, p(z|d,w)."""
    j = counts.join(dz, "doc_id").join(zw, "wid").withColumn("joint", V.hadamard(F.col("pz"), F.col("pw")))
    return j.withColumn("q", V.scale(F.col("joint"), F.lit(1.0) / F.greatest(V.total(F.col("joint")), F.lit(1e-300))))


def plsa_loglik(counts: DataFrame, dz: DataFrame, zw: DataFrame) -> float:
    j = plsa_joined(counts, dz, zw)
    return j.agg(F.sum(F.col("n") * F.log(F.greatest(V.total(F.col("joint")), F.lit(1e-300))))).first()[0] or 0.0


def parts(rows: DataFrame, dim: int, count: int) -> DataFrame:
    """(row_id, part, y): vectors cut into equal parts."""
    width = dim // count
    return rows.select("row_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: F.slice("x", p * width + 1, width))).alias("part", "y"))


def encode(cut: DataFrame, book: dict[int, list[list[float]]]) -> DataFrame:
    """(row_id, part, y, code, d2): the nearest code word of each part, ties to the smaller code. The book is a constant of the plan."""
    books = F.array(*[F.array(*[doubles(w) for w in book[p]]) for p in sorted(book)])
    d = F.transform(F.element_at(books, F.col("part") + 1), lambda w, i: F.struct(F.round(V.l2_distance_sq(F.col("y"), w), 12).alias("d2"), i.alias("code")))
    return cut.withColumn("m", F.array_min(d)).select("row_id", "part", "y", F.col("m.code").alias("code"), F.col("m.d2").alias("d2"))


def quantiser_step(cut: DataFrame, book: dict[int, list[list[float]]]) -> tuple[dict[int, list[list[float]]], float]:
    """One k-means step of all parts at once, and the total error before it. An empty code takes a shifted copy of its part's fullest."""
    width = len(book[0][0])
    e = encode(cut, book)
    s = e.groupBy("part", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("err"), *[F.avg(F.col("y")[j]).alias(f"m{j}") for j in range(width)]).collect()
    new = {p: [list(w) for w in ws] for p, ws in book.items()}
    full = {p: max((x for x in s if x["part"] == p), key=lambda x: x["n"], default=None) for p in book}
    seen = set()
    for x in s:
        seen.add((x["part"], x["code"]))
        new[x["part"]][x["code"]] = [x[f"m{j}"] for j in range(width)]
    for p, ws in book.items():
        for c in range(len(ws)):
            if (p, c) not in seen and full[p] is not None:
                new[p][c] = [full[p][f"m{j}"] * (1 + 1e-3 * ((j + c) % 2 * 2 - 1)) + 1e-6 * (c + 1) for j in range(width)]
    return new, sum(x["err"] for x in s)


def quantiser_train(rows: DataFrame, dim: int, count: int, words: int, steps: int = 10) -> tuple[dict[int, list[list[float]]], list[float]]:
    """Code books of all parts from the rows of lowest id, and the error before each step."""
    cut = parts(rows, dim, count)
    start = [r["x"] for r in rows.orderBy("row_id").limit(words).collect()]
    width = dim // count
    book = {p: [x[p * width : (p + 1) * width] for x in start] for p in range(count)}
    errors: list[float] = []
    for _ in range(steps if start else 0):
        book, err = quantiser_step(cut, book)
        errors.append(err)
        if len(errors) > 1 and errors[-2] - err <= 1e-9 * max(1.0, err):
            break
    return book, errors


def covariance(rows: DataFrame, dim: int) -> tuple[list[float], list[list[float]]]:
    """Mean and covariance of (x) by one aggregate of dim^2 sums."""
    x = F.col("x")
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(dim)]).first()
    mean = [one[f"m{i}"] or 0.0 for i in range(dim)]
    y = rows.select(V.sub(x, doubles(mean)).alias("y"))
    outer = y.select(F.array(*[F.col("y")[i] * F.col("y")[j] for i in range(dim) for j in range(i, dim)]).alias("o"))
    cells = [(i, j) for i in range(dim) for j in range(i, dim)]
    flat = outer.select(F.posexplode("o").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("v")).collect()
    cov = [[0.0] * dim for _ in range(dim)]
    for r in flat:
        i, j = cells[r["c"]]
        cov[i][j] = cov[j][i] = r["v"]
    return mean, cov
