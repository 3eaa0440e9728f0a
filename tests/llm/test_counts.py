"""Term frequencies, most frequent values and packing against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import heavy_hitters, packing
from brindle.llm.term_frequency import term_frequencies

ROWS = "row_id bigint, field int, fid bigint, n string"


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2]), rng.choice([5] * 20 + [None, *range(60)]), "x") for _ in range(2500)]
    rows += rows[:200]
    occ, rec = Counter(), defaultdict(set)
    for r, a, b, _ in rows:
        if a is not None and b is not None:
            occ[a, b] += 1
            if r is not None:
                rec[a, b].add(r)
    total = len({r for r, *_ in rows if r is not None})
    got = {(x["field"], x["fid"]): (x["occurrences"], x["records"], x["mark"]) for x in term_frequencies(spark.createDataFrame(rows, ROWS), "row_id", ["field", "fid"]).collect()}
    want = {k: (n, len(rec[k]), "rare" if len(rec[k]) < 3 else "common" if len(rec[k]) > total / 2 else None) for k, n in occ.items()}
    assert got == want


def test_terms_of_nothing_and_of_clashing_names(spark):
    assert term_frequencies(spark.createDataFrame([], ROWS), "row_id", ["field", "fid"]).count() == 0
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3)], "r bigint, t0 bigint, n bigint")
    assert [tuple(x) for x in term_frequencies(df, "r", ["n", "t0"]).collect()] == [(3, 2, 2, 1, "rare")]


@pytest.mark.parametrize("limit", [50, 4_000_000])
def test_top_values_are_exact(spark, limit):
    rng = np.random.default_rng(3)
    values = [int(v) if v % 17 else None for v in rng.zipf(1.3, 20_000) % 3000]
    df = spark.createDataFrame([(v, "x") for v in values], "fid bigint, n string").repartition(6)
    want = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [tuple(r) for r in heavy_hitters.top_values(df, "fid", 20, limit).collect()] == want


def test_small_nodes_are_merged(spark, monkeypatch):
    monkeypatch.setattr(heavy_hitters, "MERGED", 3)
    values = [i % 40 for i in range(2000)] + list(range(1000, 2500)) + [7] * 9 + [11] * 5
    df = spark.createDataFrame([(v,) for v in values], "fid bigint").repartition(8)
    want = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [tuple(r) for r in heavy_hitters.top_values(df, "fid", 12, 100).collect()] == want


def test_top_values_of_few_ties_strings_and_nothing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    assert [tuple(r) for r in heavy_hitters.top_values(df, "s", 2).collect()] == [("c", 2), ("a", 1)]
    assert heavy_hitters.top_values(df, "s", 10).count() == 3
    assert heavy_hitters.top_values(df.limit(0), "s", 10).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(30, 60))
def test_a_container_is_as_full_as_can_be(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    first = max(lengths)
    chosen = packing.fullest(counts, capacity, first)
    assert chosen[0] == first and not (Counter(chosen) - Counter(lengths))
    reach = {first}
    rest = list(lengths)
    rest.remove(first)
    for x in rest:
        reach |= {s + x for s in reach if s + x <= capacity}
    assert sum(chosen) == max(reach)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(50, 120), st.integers(1, 60))
def test_packing_keeps_every_item_and_the_capacity(lengths, capacity, pool):
    bins = packing.pack_lengths(np.array(lengths, dtype=np.int64), capacity, pool)
    assert len(bins) == len(lengths) and (bins >= 0).all()
    if lengths:
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= capacity and (fill > 0).all()


def test_pack_cuts_only_what_exceeds(spark):
    texts = ["é" * 10, "", None, "x" * 249, "x" * 99, "y" * 100, "x" * 99]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int").coalesce(1)
    got = packing.pack(df, "doc_id", packing.byte_tokens(F.col("text")), 100).collect()
    by = defaultdict(list)
    for r in got:
        by[r["item"]].append((r["piece"], r["start"], r["tokens"]))
    assert sorted(by[3]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and sorted(by[5]) == [(0, 0, 100), (1, 100, 1)]
    assert by[0] == [(0, 0, 21)] and by[1] == [(0, 0, 1)] and 2 not in by
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["tokens"]
    assert max(fill.values()) <= 100 and sum(fill.values()) == 21 + 1 + 250 + 100 + 101 + 100
    assert packing.pack(df.limit(0), "doc_id", packing.byte_tokens(F.col("text")), 100).count() == 0


def test_fill_is_high(spark):
    df = spark.range(20_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(4000)) + 200).alias("size"))
    packed = packing.pack(df, "id", F.col("size"), 8192, shards=4)
    assert packed.count() == 20_000
    assert packing.fill_report(packed, 8192).first()["fill"] > 0.995
