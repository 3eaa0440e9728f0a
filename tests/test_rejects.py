"""Loading of ad lines against a plain state machine."""

import random
import re

import pytest

from brindle.sources.rejects import load_ad_lines, rejects, triples


def plain_fields(line):
    """Fields under RFC 4180, or None."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        buf, j = buf + '"', j + 2
                        continue
                    break
                buf, j = buf + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != ",":
                return None
            fields.append(buf)
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            fields.append(line[i:j])
        if j >= len(line):
            return fields
        i = j + 1


def plain_reason(line):
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    f = plain_fields(line)
    if f is None:
        return "quoting"
    toks = [t for t in re.split(" +", f[2].strip(" ")) if t] if len(f) == 4 else []
    if len(f) != 4 or any(t.count(":") != 2 for t in toks):
        return "column_count"
    ok = re.fullmatch(r"[0-9]{1,18}", f[0]) and re.fullmatch("[01]", f[1]) and toks
    for t in toks:
        a, b, c = t.split(":")
        ok = ok and re.fullmatch("[0-9]+", a) and int(a) <= 39 and re.fullmatch("[0-9]+", b) and int(b) <= 9223372036854775807
        ok = ok and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", c) and float(c) not in (float("inf"), float("-inf"))
    return None if ok else "bad_value"


CASES = [
    "", None, '"', '""', "a,b,c,d", "1,0,1:2:3,x", "1,0,1:2:3,", "1,0,1:2:3,x\r", "1,0,1:2:3,x\r\r", "1,0,1:2:3,x\ny", '1,0,1:2:3,"x\ny"', '1,0,"1:2:3","a,""b"""', '1,0,1:2:3,"x"y',
    '1,0,1:2:3,x"y', "1,0,,x", "1,0,   ,x", "1,0,  1:2:3   4:5:6 ,x", "1,0,1:2,x", "1,0,1:2:3:4,x", "1,0,1:2:3", "1,0,1:2:3,x,y", "1,0,40:1:1,x", "1,0,039:01:1,x", "1,0,1:9223372036854775808:1,x",
    "1,0,1:9223372036854775807:1,x", "1,0,1:2:1e999,x", "1,0,1:2:1e-999,x", "1,0,1:2:.5,x", "1,0,1:2:5.,x", "1,0,1:2:+5,x", "1,0,1:2:nan,x", "1,0,1:４:5,x", "1234567890123456789,0,1:2:3,x", "1,2,1:2:3,x",
    " 1,0,1:2:3,x", "1,0,1:2:3\t4:5:6,x", "1,0,::,x", "\n", "\r", "1,0,1:2:3, ", "1;0;1:2:3;x",
]


def test_reasons(spark):
    rng = random.Random(4)
    lines = list(CASES)
    for _ in range(3000):
        base = list(rng.choice(['12,1,3:4:0.5 5:6:7,side rail', '12,1,"3:4:0.5 5:6:7","side, ""rail"""', "7,0,39:1:-2E3,x\r"]))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(base) + 1)
            base[p : p + rng.randint(0, 1)] = rng.choice(['"', ",", ":", " ", "\n", "\r", "e", "9", "-", "."])
        lines.append("".join(base))
    got = {r["line_id"]: r["reason"] for r in rejects(load_ad_lines(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string"))).collect()}
    for i, line in enumerate(lines):
        assert got.get(i) == plain_reason(line), repr(line)


def test_values_order_and_long_lines(spark):
    long = "5,1," + " ".join(f"{i % 40}:{i}:{i / 4}" for i in range(60_000)) + ",long"
    rows = [(1, long, "x"), (2, None, "x"), (3, '9,0,"7:8:1e2 1:2:-3",p', "x"), (3, '9,0,"7:8:1e2 1:2:-3",p', "x")]
    loaded = load_ad_lines(spark.createDataFrame(rows, "line_id bigint, line string, reason string"))
    t = triples(loaded)
    assert t.filter("line_id = 1").count() == 60_000
    assert [tuple(r)[4:] for r in t.filter("line_id = 1 AND pos = 59999").collect()] == [(59_999, 39, 59_999, 14_999.75)]
    assert sorted(tuple(r)[4:] for r in t.filter("line_id = 3").collect()) == [(0, 7, 8, 100.0)] * 2 + [(1, 1, 2, -3.0)] * 2
    assert [(r["line_id"], r["reason"]) for r in rejects(loaded).collect()] == [(2, "column_count")]


@pytest.mark.parametrize("line", [None, ""])
def test_only_empty_lines(spark, line):
    loaded = load_ad_lines(spark.createDataFrame([(1, line)], "line_id bigint, line string"))
    assert rejects(loaded).first()["reason"] == "column_count" and triples(loaded).count() == 0


def test_empty_table(spark):
    assert load_ad_lines(spark.createDataFrame([], "line_id bigint, line string")).count() == 0
