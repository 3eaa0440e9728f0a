"""Registered queries against their SQL, and p2 and p3 against brute force over the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pytest

from brindle.llm import eval_leaks, plans
from tests.llm.test_texts import srt


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    cur = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = plans.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def usable(spark, small):
    rows = {}
    for r in spark.read.parquet(f"{small}/points.parquet").select("row_id", "x").collect():
        if r["x"] is not None and len(r["x"]) == 32 and all(v is not None and np.isfinite(v) for v in r["x"]):
            rows[r["row_id"]] = r["x"]
    ids = np.array(sorted(rows))
    return ids, np.array([rows[i] for i in ids])


def test_p2_groups_are_compact_and_single(spark, small):
    ids, x = usable(spark, small)
    got = plans.p2_found(spark, small).toPandas()
    assert not got.duplicated("row_id").any() and set(got["row_id"]) <= set(ids)
    at = {i: n for n, i in enumerate(ids)}
    means = {c: x[[at[i] for i in p["row_id"]]].mean(axis=0) for c, p in got.groupby("cluster")}
    for c, p in got.groupby("cluster"):
        own = x[[at[i] for i in p["row_id"]]]
        d = {k: np.linalg.norm(own - m, axis=1) for k, m in means.items()}
        assert all((d[c] <= d[k]).all() for k in means)


def test_p3_pairs(spark, small):
    ids, x = usable(spark, small)
    want = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        for j in [j for j in np.lexsort((ids, d)) if j != i][:5]:
            if d[j] <= 2.0:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    got = plans.p3_found(spark, small).toPandas()
    assert set(zip(got["row_a"], got["row_b"], strict=True)) == want and len(got) == len(want)


def test_p7_containers_hold_every_token(spark, small):
    packed = plans.p7_containers(spark, small).toPandas()
    assert packed.groupby("container")["tokens"].sum().max() <= plans.CAPACITY
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").collect()
    assert packed["tokens"].sum() == sum(len(r["text"].encode()) + 1 for r in docs if r["text"] is not None)


def eval_items(spark, small):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/eval_items.parquet").orderBy("item_id").select("item_id", "text").collect()]


def spoken_words(text):
    return [w for w in text.split() if any(c.isalnum() for c in w)]


def test_p8_recall_on_a_thousand_passages(spark, small):
    """Passages of 12 to 20 words of any place in any item, whole, and with two words damaged."""
    rng, items = random.Random(8), eval_items(spark, small)
    index = eval_leaks.build_index(items, 12)
    found = {0: 0, 2: 0}
    for _ in range(1000):
        n = rng.randrange(len(index.ids))
        w = spoken_words(" ".join(index.words[n]))
        size = min(len(w), rng.randint(12, 20))
        p = rng.randint(0, len(w) - size)
        for damaged in found:
            words = w[p : p + size]
            for k in rng.sample(range(size), damaged):
                v = words[k]
                words[k] = rng.choice([v.upper(), v.replace("l", "I"), v.replace("e", "c", 1), v[: len(v) // 2] + " " + v[len(v) // 2 :]])
            text = srt([" ".join(words[i : i + 5]) for i in range(0, size, 5)])
            found[damaged] += any(index.ids[m] == index.ids[n] and kind == "verbatim" for m, kind, *_ in eval_leaks.find(index, text, 12, 24))
    assert found[0] >= 995 and found[2] >= 985


def test_p8_items_asked_again_are_found(spark, small):
    """Items whose numbers, names and units are all replaced, each by one value throughout."""
    rng, items = random.Random(9), eval_items(spark, small)
    index = eval_leaks.build_index(items, 12)
    wanted = hit = 0
    for n in range(len(index.ids)):
        kinds, toks, swap, words = index.kinds(index.toks[n]), index.toks[n], {}, list(index.words[n])
        for k, (kind, t) in enumerate(zip(kinds, toks, strict=True)):
            if kind[:1] == b"#":
                at = index.at[n][k]
                new = swap.setdefault(t, str(100 + len(swap)) if kind == b"#n" else "Q" + "".join(rng.choices("agmnpuvwxz", k=7)))
                words[at] = new + (words[at][-1] if words[at][-1] in ".,:;?!" else "")
        if len(toks) >= 24:
            wanted += 1
            hit += any(m == n and kind == "asked again" for m, kind, *_ in eval_leaks.find(index, srt([" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]), 12, 24))
    assert wanted > 100 and hit >= 0.95 * wanted


def test_p8_does_not_depend_on_the_block(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/eval_items.parquet")
    whole = {tuple(r) for r in eval_leaks.leaks(docs, items).collect()}
    monkeypatch.setattr(eval_leaks, "BLOCK", 90)
    assert {tuple(r) for r in eval_leaks.leaks(docs, items).collect()} == whole and whole
