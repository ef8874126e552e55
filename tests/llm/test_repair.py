import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from symlattice.llm import repair as r

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, edits) of all, by Dijkstra over costs and edits together, and what they give."""
    goal = len(rows)
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, said = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == goal and last in ("", "a"):
            return cost, audit, said
        follows = lambda x: x == "s" and not last or x == "u" and last != "u" or x == "a" and last == "u"
        for role in ("user", "assistant"):
            if follows(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*said, f"{role}:")))
        if i < goal:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, said))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if follows(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*said, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if follows(to[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to[0], (*said, f"{to}:{text}")))


def brute(rows):
    out, after = {}, damaged(rows)
    for conv in {x[0] for x in rows}:
        mine = sorted((x[1:] for x in after if x[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = {t for t, _, _ in mine if t is not None}
        seen, faults = set(), []
        for _, role, text in mine:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [role[:1] for _, role, _ in mine]
        cost, audit, said = cheapest([(role, text, f) for (_, role, text), f in zip(mine, faults, strict=True)])
        count = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def found(spark, rows):
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit("x"), "segment": F.lit(1), "how": F.lit(None)})
    got = [tuple(x) for x in r.repair(odd.repartition(3)).collect()]
    assert len({x[0] for x in got}) == len(got)
    return {x[0]: x[1:] for x in got}


def conversations(rng, n, length):
    text = lambda: rng.choice(["", "  ", "Hi.", "no end", "x!\n ", "what?", "é。", None])
    role = lambda: rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "admin"])
    return [(rng.choice([c, c, c, None]) if c % 7 == 0 else c, rng.choice([t, t, t, None, t // 2]), role(), text() if rng.random() < 0.5 else f"{c} {t}.") for c in range(n) for t in range(rng.randint(1, length))]


@pytest.mark.parametrize("segment", [4096, 3])
def test_against_dijkstra(spark, segment, monkeypatch):
    """segment 3: prices are folded over the ends of many segments."""
    monkeypatch.setattr(r, "SEGMENT", segment)
    rows = conversations(random.Random(segment), 120, 14)
    assert found(spark, rows) == brute(rows)


def test_prices_and_ties():
    rng = random.Random(5)
    for _ in range(300):
        letters = "".join(rng.choice("suaxSUAX1234") for _ in range(rng.randint(1, 9)))
        role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        rows = [(role[c.lower().translate(str.maketrans("1234", "suax"))], "t", "blank" if c.isupper() else "truncated" if c.isdigit() else "") for c in letters]
        assert r.whole(letters) == cheapest(rows)[:2]


def test_one_long_conversation_and_empty_tables(spark):
    assert found(spark, []) == {}
    rows = [(1, t, ("user", "assistant")[t % 2 or t % 11 == 0], f"{t}." if t % 5 else "same.") for t in range(9000)] + [(2, 0, "user", "a."), (3, 7, None, None)]
    got, (want,) = found(spark, rows), [brute(rows)]
    assert got == want


def test_no_rows_left(spark):
    gone = [(c, 0, "user", "x.") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and set(found(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
