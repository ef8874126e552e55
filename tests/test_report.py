"""Short reports against a reader that goes through the lines one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symlattice.plans import report

KINDS = ["function", "object", "a symbol b"]


def crc(lines, limit):
    out, held, k = [], [], 0

    def put():
        out.extend(x for block in held[:limit] for x in block)
        if len(held) > limit:
            out.extend([f"... {len(held) - limit} omitted; {len(held)} symbols have only CRC changes", ""])
        held.clear()

    while k < len(lines):
        three = lines[k : k + 3]
        if lines[k] and lines[k][0] != " " and " symbol " not in lines[k]:
            put()
            out.append(lines[k])
        elif len(three) == 3 and re.match(report.SYMBOL_CHANGED, three[0]) and re.match(report.CRC_CHANGED, three[1]) and three[2] == "":
            held.append(three)
            k += 2
        else:
            out.append(lines[k])
        k += 1
    put()
    return out


def groups(lines):
    out, held, k = [], {}, 0

    def put():
        for which, kind in sorted(held, key=lambda x: (x[0] == "added", x[1])):
            names = held[which, kind]
            out.extend([f"{len(names)} {kind} symbol(s) {which}", *(f"  {n}" for n in names), ""])
        held.clear()

    while k < len(lines):
        m = re.match(report.SYMBOL_CAME_OR_WENT, lines[k])
        if m and lines[k + 1 : k + 2] == [""]:
            held.setdefault((m[3], m[1]), []).append(m[2])
            k += 1
        else:
            put()
            out.append(lines[k])
        k += 1
    put()
    return out


def moves(lines):
    out, held, of, k = [], [], None, 0

    def put():
        if held:
            pad = " " * of[0]
            out.extend([f"{pad}member {held[0]} changed" if len(held) == 1 else f"{pad}{len(held)} members ({held[0]} .. {held[-1]}) changed", f"{pad}  offset changed by {of[1]}"])
        held.clear()

    while k < len(lines):
        a, b = re.match(report.MEMBER_CHANGED, lines[k]), k + 2 < len(lines) and re.match(report.OFFSET_CHANGED, lines[k + 1])
        if a and b and len(a[1]) + 2 == len(b[1]) and len(lines[k + 2]) - len(lines[k + 2].lstrip(" ")) <= len(a[1]):
            now = len(a[1]), int(b[3]) - int(b[2])
            if now != of:
                put()
                of = now
            held.append(a[2])
            k += 2
        else:
            put()
            out.append(lines[k])
            k += 1
    put()
    return out


def some_lines(rng, n):
    out = []
    while len(out) < n:
        kind, name = rng.choice(KINDS), f"'f{rng.randrange(9)}'"
        pad = " " * rng.choice([0, 2, 2, 4])
        out += rng.choice(
            [
                [f"{kind} symbol {name} changed", "  CRC changed from 0x1 to 0x2", ""],
                [f"{kind} symbol {name} changed", "  CRC changed from 0x1 to 0x2", "  binding changed from a to b", ""],
                [f"{kind} symbol {name} was {rng.choice(['added', 'removed'])}", ""],
                [f"{kind} symbol {name} was removed"],
                [f"type {name} changed", "  byte size changed from 1 to 2"],
                [f"{pad}member {name} changed", f"{pad}  offset changed from {rng.choice([0, 8])} to {rng.choice([8, 16])}"],
                [f"{pad}member {name} changed", f"{pad}  offset changed from 0 to 8", f"{pad}  type changed"],
                [""],
            ]
        )
    return out[: n]


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "rank long, line string").repartition(3)


def read(df):
    rows = sorted(map(tuple, df.select("rank", "line").collect()))
    assert [r for r, _ in rows] == list(range(len(rows)))
    return [x for _, x in rows]


@pytest.mark.parametrize(("n", "limit", "bucket"), [(0, 1, 4), (1, 0, 4), (2, 1, 2), (300, 2, 5), (400, 0, 7), (400, 3, 1 << 16)])
def test_short_report(spark, n, limit, bucket):
    lines = some_lines(random.Random(n + bucket), n)
    one = report.without_crc_changes(table(spark, lines), limit, bucket)
    assert read(one) == crc(lines, limit)
    two = report.with_symbols_grouped(one, bucket)
    assert read(two) == groups(crc(lines, limit))
    assert read(report.with_moves_merged(two, bucket)) == moves(groups(crc(lines, limit)))


def test_running_over_many_levels(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 == 0, F.col("id")))
    got = report.running(df, "s", F.col("x"), F.sum, 100, 3, "id")
    got = report.running(got, "m", F.col("x"), F.max, 100, 3, "id")
    for r in got.collect():
        assert r["m"] == r["id"] // 3 * 3 and r["s"] == sum(range(0, r["id"] + 1, 3))


def test_comparison_lines(spark):
    df = spark.createDataFrame([(0, "a", None), (1, None, "b"), (2, "a", "a"), (3, "a", "b")], "k int, old string, new string")
    got = [r[0] for r in df.orderBy("k").select(report.comparison_line(F.lit("type"), F.col("old"), F.col("new"))).collect()]
    assert got == ["type 'a' was removed", "type 'b' was added", "type 'a' changed", "type changed from 'a' to 'b'"]
