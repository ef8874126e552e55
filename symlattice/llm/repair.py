"""Repair of damaged conversations by the auction algorithm for shortest paths.

A conversation's rows and the role last said span a lattice: node (i, q) has i
rows behind it and q of nothing yet, system, user or assistant. Arcs keep,
rerole or delete the next row, or insert an empty one, at integer costs.
Prices start low and are never above any arc's cost plus the price at its end.
The path grows along a tight arc, and where there is none the price
of its last node rises to the least such sum and the path contracts by that
node. Origins are taken from the last rows to the first; a path that meets a
settled node is done and settles its own nodes. The prices are then distances:
tight arcs make up all cheapest repairs, and the first of them in ASCII order
is traced.

Rows are put in order over range partitions, so that no task holds a whole
conversation. Long ones are cut into segments whose costs from state to state
are folded into prices at their ends, 16 numbers for thousands of rows, and
each is then traced by itself. Only the digest of a repaired conversation,
which SHA-256 makes sequential, streams through one task, row by row.

Rows of one turn are in order of role and text; a null turn comes first; a null
id is a conversation of its own (in checksums nulls are a space); a null role or
text is a space. Repeated rows are rows of their own. A role other than system,
user and assistant counts by its first letter; without one it can't be kept.
Empty tables have no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlattice.session import checkpoint

#: Rows of a segment.
SEGMENT = 4096
#: What a repair costs; a kept or reroled row that is truncated costs 1 more.
INSERT, REROLE, DELETE = 2, 2, 3

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_ENDS = (_NOTHING, _ASSISTANT)  # of a legal conversation
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # what may be said after each state; system only first
_FAR = 1 << 60
_LEGAL = {"su", "ua", "au"}


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults of five kinds in some of the rows, by a checksum of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def in_order(rows: DataFrame) -> DataFrame:
    """rows with ``at``, which numbers them by conversation, turn, role and text over range partitions, as a table. A tie-breaker lets even equal rows part."""
    dealt = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    ordered = dealt.repartitionByRange("conv_id", "turn", "role", "text", "__tie").sortWithinPartitions("conv_id", "turn", "role", "text", "__tie")
    return checkpoint(ordered.drop("__tie").withColumn("at", F.monotonically_increasing_id()))


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault) of rows in order; fault: blank, duplicate, truncated or null."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    light = rows.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), said.alias("said"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    # only what is said twice meets its rows again: a third of all rows may say the same, but each of them is compared with one first place
    first = light.groupBy("conv_id", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("__conv"), F.col("said").alias("__said"), "first")
    met = light.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("said") == F.col("__said")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return met.select("conv_id", "turn", "at", "initial", fault.alias("fault"))


# ---- the lattice of a segment: a letter for each row


def _letter(initial: Column, fault: Column) -> Column:
    """The row's initial, and how it may be treated: freely (sua, x: any other), only deleted (S...), at a cost if it stays (1234)."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault == "truncated", F.translate(known, "suax", "1234")).when(fault.isNotNull(), F.upper(known)).otherwise(known)


_STATE = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT, "1": _SYSTEM, "2": _USER, "3": _ASSISTANT}


@lru_cache(64)
def _arcs(letter: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state, the (edit, cost, node) of a row with this letter, none after the last, in ASCII order of edits; nodes count from the row's first, four to a row."""
    out = []
    for q in range(4):
        arcs = [("I", INSERT, _NEXT[q])]
        if letter:
            arcs.append(("D", DELETE, 4 + q))
        if letter and not letter.isupper():
            more, said = int(letter.isdigit()), _STATE.get(letter)
            if said == _NEXT[q] or said == _SYSTEM and q == _NOTHING:
                arcs.append(("K", more, 4 + said))
            arcs.append(("R", REROLE + more, 4 + _NEXT[q]))
        out.append(tuple(sorted(arcs)))
    return tuple(out)


def _lost(letters: str, tail: list[int]) -> list[int]:
    """The nodes that reach no end of a finite price."""
    able, out = [p < _FAR for p in tail], []
    for i in range(len(letters) - 1, -1, -1):
        arcs, now = _arcs(letters[i]), [False] * 4 + able
        for _ in range(4):
            now[:4] = [any(now[to] for _, _, to in arcs[q]) for q in range(4)]
        able = now[:4]
        out += [4 * i + q for q in range(4) if not able[q]]
    return out


def prices(letters: str, ends: list[int], last: bool) -> list[int]:
    """The price of every node, its distance to what follows the segment: ends has the price of each state there.

    Insertions after the last row belong to the next segment, unless this one
    is the last. A row's nodes start at the least price after it, which no arc
    undercuts; nodes that reach no end have no finite price and are settled.
    """
    n, tail = len(letters), list(ends)
    if last:  # a role at a time: what insertions reach
        for _ in range(4):
            tail = [min(p, INSERT + tail[_NEXT[q]]) for q, p in enumerate(tail)]
    price, settled = [0] * (4 * n) + tail, [False] * (4 * n) + [True] * 4
    if max(tail) >= _FAR:
        for node in _lost(letters, tail):
            price[node], settled[node] = _FAR, True
    for row in range(4 * n - 4, -1, -4):
        arcs, least = _arcs(letters[row // 4]), min(price[row + 4 : row + 8])
        for origin in range(row, row + 4):
            if not settled[origin]:
                price[origin] = least
        for origin in range(row, row + 4):
            path = [origin]
            while not settled[node := path[-1]]:
                best, to = min((c + price[row + j], row + j) for _, c, j in arcs[node - row])
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for node in path:
                settled[node] = True
    return price


def trace(letters: str, price: list[int], ends: list[int], last: bool, q: int) -> tuple[str, int]:
    """The first in ASCII order of the cheapest edits from a state through the segment, and the state that they lead to: by tight arcs, which all lead on as prices are distances."""
    edits, node, n = [], q, 4 * len(letters)
    while node < n or last and price[node] != ends[node - n]:
        row = node - node % 4
        edit, _, to = next(x for x in _arcs(letters[row // 4] if row < n else "")[node - row] if price[node] == x[1] + price[row + x[2]])
        edits.append(edit)
        node = row + to
    return "".join(edits), node - n


_GOAL = [0 if q in _ENDS else _FAR for q in range(4)]


@lru_cache(20_000)
def whole(letters: str) -> tuple[int, str]:
    """The cost and the edits of a conversation of one segment."""
    price = prices(letters, _GOAL, True)
    return price[0], trace(letters, price, _GOAL, True, _NOTHING)[0]


@lru_cache(256)
def costs(letters: str, last: bool) -> list[int]:
    """Of a segment: the 16 costs from each state before to each after."""
    if last:  # what follows is over; only the first of the ends is asked for
        return [x for p in prices(letters, _GOAL, True)[:4] for x in (p, _FAR, _FAR, p)]
    to = [prices(letters, [0 if p == q else _FAR for p in range(4)], False)[:4] for q in range(4)]
    return [to[q][p] for p in range(4) for q in range(4)]


def _illegal(letters: str) -> int:
    plain = letters.lower().translate(str.maketrans("1234", "suax"))
    return sum(x + y not in _LEGAL for x, y in zip(plain, plain[1:], strict=False))


# ---- conversations


def edits(faults: DataFrame) -> DataFrame:
    """(conv_id, segment, first, cost, audit, start, illegal) of every segment: its first place, its edits and the state before them; cost only in a conversation's first segment."""
    letter = _letter(F.col("initial"), F.col("fault"))
    # places are numbered within range partitions; a segment lies within one
    cut = F.shiftright("at", 33) * (1 << 33) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / SEGMENT) * SEGMENT
    held = faults.groupBy("conv_id", cut.cast("long").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("at", letter.alias("letter")))).alias("rows"))  # SEGMENT at most
    segments = checkpoint(held.select("conv_id", "segment", F.col("rows")[0]["at"].alias("first"), F.concat_ws("", "rows.letter").alias("letters")))
    ends = segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("segment").alias("final")).select(F.col("conv_id").alias("__conv"), "n", "final")
    of = segments.join(ends, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    kind = segments.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, segment long, first long, cost long, audit string, start int, illegal long"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column(3).to_pylist()
            found = [whole(x) for x in letters]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string()), pa.array([0] * len(found), pa.int32()), pa.array([_illegal(x) for x in letters], pa.int64())], names=["conv_id", "segment", "first", "cost", "audit", "start", "illegal"])

    columns = ["conv_id", "segment", "first", "letters"]
    out = of.filter("n = 1").select(*columns).mapInArrow(short, shape)
    return out.unionByName(_long(of.filter("n > 1").select(*columns, "final"), shape))


def _long(segments: DataFrame, shape: str) -> DataFrame:
    """edits of conversations of several segments: costs between their ends, prices there, a trace from each state, then the one that is taken."""
    costing = F.udf(lambda letters, last: costs(letters, last), "array<long>")
    priced = segments.select("conv_id", "segment", "letters", costing("letters", F.col("segment") == F.col("final")).alias("costs"))
    n = lambda x: F.lit(x)
    # from the last segment back: the price of each state before a segment, 16 numbers for each
    before = lambda c, tail: F.transform(F.sequence(n(0), n(3)), lambda p: F.array_min(F.transform(F.sequence(n(0), n(3)), lambda q: F.get(c, p * 4 + q) + F.get(tail, q))))
    goal = F.array(*(F.lit(x).cast("long") for x in _GOAL))
    line = priced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "costs"))).alias("line"))
    after = F.aggregate(F.reverse("line"), F.array(goal), lambda acc, x: F.concat(F.array(F.transform(before(x["costs"], F.get(acc, n(0))), lambda v: F.least(v, n(_FAR)))), acc))
    line = line.withColumn("after", after).withColumns({"segments": F.col("line.segment"), "ends": F.slice("after", 2, F.size("line")), "prices": F.slice("after", 1, F.size("line"))})
    placed = line.select("conv_id", F.explode(F.arrays_zip("segments", "ends", "prices")).alias("x")).select(F.col("conv_id").alias("__conv"), F.col("x.segments").alias("__segment"), F.col("x.ends").alias("ends"), F.col("x.prices").alias("prices"))

    def traces(letters, ends, last):
        price = prices(letters, ends, last)
        return [trace(letters, price, ends, last, q) if price[q] < _FAR else ("", -1) for q in range(4)]

    tracing = F.udf(traces, "array<struct<audit:string,to:int>>")
    counting = F.udf(_illegal, "long")
    held = segments.join(placed, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("segment") == F.col("__segment")))
    traced = checkpoint(held.select("conv_id", "segment", "first", F.get("prices", n(0)).alias("cost"), tracing("letters", "ends", F.col("segment") == F.col("final")).alias("ways"), counting("letters").alias("illegal"), F.substring("letters", 1, 1).alias("head"), F.substring("letters", -1, 1).alias("foot")))
    # forward: the state before each segment, and what is illegal where two meet
    plain = lambda c: F.translate(F.lower(c), "1234", "suax")
    way = traced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", F.col("ways.to").alias("to"), "head", "foot"))).alias("line"))
    states = F.aggregate("line", F.array(n(0)), lambda acc, x: F.concat(acc, F.array(F.get(x["to"], F.element_at(acc, -1)))))
    bad = F.transform("line", lambda x, i: F.when((i > 0) & ~F.concat(plain(F.get("line", i - 1)["foot"]), plain(x["head"])).isin(*_LEGAL), 1).otherwise(0))
    way = way.withColumns({"states": F.slice(states, 1, F.size("line")), "bad": bad, "segments": F.col("line.segment")})
    taken = way.select("conv_id", F.posexplode(F.arrays_zip("segments", "states", "bad")).alias("nth", "x")).select(F.col("conv_id").alias("__conv"), F.col("x.segments").alias("__segment"), F.col("x.states").alias("start"), F.col("x.bad").alias("bad"), "nth")
    out = traced.join(taken, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("segment") == F.col("__segment")))
    cost = F.when(F.col("nth") == 0, F.col("cost"))
    return out.select("conv_id", "segment", "first", cost.alias("cost"), F.get("ways", F.col("start"))["audit"].alias("audit"), F.col("start").cast("int").alias("start"), (F.col("illegal") + F.col("bad")).alias("illegal")).to(T._parse_datatype_string(shape))


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's repaired rows; its rows and their edits stream through one task, a row at a time."""
    tokens = edited.select("conv_id", "first", F.posexplode(F.expr(r"regexp_extract_all(concat(audit, 'E'), 'I*[DKRE]', 0)")).alias("nth", "edit"))
    # an edit stands just before its row; what follows a segment's last row, just before the next segment's first
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = tokens.select("conv_id", (F.col("first") + F.col("nth")).alias("at"), F.when(F.col("edit").endswith("E"), 0).otherwise(1).alias("order"), "edit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "at", F.lit(2).alias("order"), F.lit(None).cast("string").alias("edit"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = None
        state, edit, some = _NOTHING, "", False
        names = {_USER: b"user", _ASSISTANT: b"assistant"}

        def said(role: bytes, text: bytes) -> None:
            nonlocal some
            sha.update(b"\n" + role + b":" + text if some else role + b":" + text)
            some = True

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind_), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for b in batches:
            kind_ = b.column(0).type
            for conv, token, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield closed()
                    now, sha, state, some = (conv,), hashlib.sha256(), _NOTHING, False
                if token is not None:
                    for _ in range(token.count("I")):
                        state = _NEXT[state]
                        said(names[state], b"")
                    edit = token[-1]
                elif edit == "K":
                    state = {"s": _SYSTEM, "u": _USER}.get(role[0], _ASSISTANT)
                    said(role.encode(), text.as_py().encode())
                elif edit == "R":
                    state = _NEXT[state]
                    said(names[state], text.as_py().encode())
        if now is not None:
            yield closed()

    both = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "order")
    return both.select("conv_id", "edit", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text), as the module says: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    rows = in_order(damage(turns))
    faults = checkpoint(faulted(rows))
    edited = checkpoint(edits(faults))
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    distinct = faults.groupBy("conv_id", "turn").agg(*(count(k) for k in ("blank", "duplicate", "truncated")))
    spans = distinct.groupBy("conv_id").agg(*(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = edited.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.concat_ws("", F.array_sort(F.collect_list(F.struct("segment", "audit")))["audit"]).alias("audit"))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    for part in (spans, parts, repaired(rows, edited)):
        every = every.join(part, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
