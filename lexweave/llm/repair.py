"""Conversation structure repair by depth-first branch-and-bound.

The roles of a repaired conversation begin with at most one system turn and go
on in pairs of user and assistant, or it has no turns.  Edits of a row: Keep (0),
Rerole to user or assistant (2), Delete (3); Insert an empty user or assistant
turn (2) anywhere.  Blank and duplicate rows must go; a truncated row that stays
costs 1 more.  Of the cheapest edits the ones whose initials sort first win.

A row's first fault counts: blank (no character but white space), duplicate (an
earlier row of the conversation has the same role and text), truncated (the last
such character ends no sentence).

Search.  A node is a row and a state: nothing yet (0), after a system turn (S),
a user turn (U) or an assistant turn (A).  The stack is explicit, children are
taken by bound, then by initial.  The suffix bound of U and A solves the rest of
the rows as if no system turn could be kept; S is bounded as A, and 0 as A less
the price of one deletion, which a kept system turn may save.  A prefix is cut off if
the node's table has one of smaller cost or of the same cost and smaller
initials, or if its bound exceeds the incumbent, or equals it with initials that
sort later; so the last incumbent is proved best.

Scale.  A conversation may hold a third of all rows: it is ordered by a range
partitioning and cut into segments of at most ``SEGMENT`` rows, searched apart
for every state they may begin and end in.  The segments of a conversation then
stream by, keeping the best (cost, edits) for each state; of the edits so far
only the links between surviving segments are held.

Rows are ordered by turn (null first), role, text; equal rows are neighbours.  A
null conv_id is a conversation of its own.  Null roles and texts count as empty
and so are blank; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

SEGMENT = 256
RANGE_CHARS = 64  # of a text that deal rows of one turn and role out to ranges
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
FAR = 1 << 60  # no way; bounds near it mean the same
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: state that a kept role initial leads to
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: state that an inserted or renamed turn leads to
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NO_INITIAL, COPY = "-", "\0"

Row = tuple[str, int, int]  # role initial, fault, further equal rows
Found = tuple[int, str]  # cost, edits


class Repaired(NamedTuple):
    """summary: (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit), for every conversation of the rows.  turns: (conv_id, place, edit,
    turn, role, text), the repaired conversations; an inserted turn has no turn."""

    summary: DataFrame
    turns: DataFrame


def _steps(row: Row, state: int) -> Iterable[tuple[str, int, int]]:
    """(edit, cost, next state) of a row."""
    initial, fault, _ = row
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        more = fault == TRUNCATED
        if (state, initial) in MOVES:
            yield "K", KEEP + more, MOVES[state, initial]
        yield "R", REROLE + more, NEXT[state]


def suffix_bounds(rows: list[Row], goals: frozenset[int]) -> list[tuple[int, int]]:
    """Least cost from (row, U) and (row, A) to one of the goals, without system turns."""
    reach = {s: 0 if s in goals else FAR for s in (USER, ASSISTANT)}

    def inserted() -> tuple[int, int]:
        u, a = reach[USER], reach[ASSISTANT]
        return min(u, a + INSERT), min(a, u + INSERT)

    out = [inserted()]
    for row in reversed(rows):
        u, a = out[-1]
        after = {USER: u, ASSISTANT: a}
        reach = {s: min(cost + after[to] for _, cost, to in _steps(row, s)) + DELETE * row[2] for s in (USER, ASSISTANT)}
        out.append(inserted())
    return out[::-1]


def cheapest(rows: list[Row], entry: int = START, goals: frozenset[int] = frozenset((START, ASSISTANT))) -> Found | None:
    """The best (cost, edits) from the state ``entry`` to one of ``goals``."""
    bounds, n = suffix_bounds(rows, goals), len(rows)
    deletions = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        deletions[i] = deletions[i + 1] + DELETE * (1 + rows[i][2])

    def bound(i: int, state: int) -> int:
        u, a = bounds[i]
        if state == USER:
            return u
        if state == ASSISTANT:
            return a
        low = a if state == SYSTEM else a - DELETE
        if state in goals:
            low = min(low, deletions[i])
        elif state == START and SYSTEM in goals:
            low = min(low, deletions[i] - DELETE)
        return max(0, low)

    best: Found | None = None
    table: dict[tuple[int, int], Found] = {}
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]
    while stack:
        i, state, cost, edits = stack.pop()
        low = cost + bound(i, state)
        if low >= FAR >> 1 or best is not None and (low > best[0] or low == best[0] and edits > best[1][: len(edits)]):
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, edits):
            continue
        table[i, state] = (cost, edits)
        if i == n and state in goals and (best is None or (cost, edits) < best):
            best = (cost, edits)
        children = [("I", cost + INSERT, i, NEXT[state])]
        if i < n:
            equal = rows[i][2]  # copies must go, and deletions sort before insertions
            children += [(edit + "D" * equal, cost + more + DELETE * equal, i + 1, to) for edit, more, to in _steps(rows[i], state)]
        children.sort(key=lambda c: (c[1] + bound(c[2], c[3]), c[0]), reverse=True)
        stack += [(j, to, total, edits + edit) for edit, total, j, to in children]
    return best


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to their best edits for each pair of states, and what is counted."""
    names = ["ck", "segment", "first", "letters", "paths", "facts"]
    path = pa.struct([("entry", pa.int8()), ("exit", pa.int8()), ("cost", pa.int64()), ("edits", pa.string())])
    fact = pa.struct([(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "distinct")] + [("head", pa.string()), ("tail", pa.string())])
    for batch in batches:
        out = []
        for seg in batch.to_pylist():
            rows = [(r["initial"], r["fault"], r["copies"] - 1) for r in seg["rows"]]
            if seg["opens"] and seg["closes"]:
                pairs = [(START, frozenset((START, ASSISTANT)))]
            else:
                goals = [frozenset((START, ASSISTANT))] if seg["closes"] else [frozenset((s,)) for s in range(4)]
                pairs = [(entry, goal) for entry in ((START,) if seg["opens"] else range(4)) for goal in goals]
            found = [(entry, goal, cheapest(rows, entry, goal)) for entry, goal in pairs]
            paths = [{"entry": e, "exit": min(g), "cost": f[0], "edits": f[1]} for e, g, f in found if f is not None]
            counts = [0, 0, 0, 0]
            for initial, fault, equal in rows:
                counts[fault] += 1
                counts[BLANK if fault == BLANK else DUPLICATE] += equal
            initials = [r[0] for r in rows]
            illegal = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(r[2] for r in rows)
            turns = [r["turn"] for r in seg["rows"] if r["turn"] is not None]
            letters = "".join(initial + COPY * equal for initial, _, equal in rows)
            out.append((seg["ck"], seg["segment"], seg["first"], letters, paths, dict(
                blank=counts[BLANK], duplicate=counts[DUPLICATE], truncated=counts[TRUNCATED], illegal=illegal,
                low=turns[0] if turns else None, high=turns[-1] if turns else None, distinct=len(set(turns)), head=initials[0], tail=initials[-1])))
        if out:
            cols = list(zip(*out))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(path), fact]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


class _Chain:
    """Best edits of a conversation's segments so far, for each state.

    Edits are compared by short stand-ins: after each segment the few survivors
    get letters in their order, and one that continues another keeps its
    letter and what follows, so stand-ins compare as the edits do."""

    def __init__(self) -> None:
        self.live: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}
        self.facts = dict(blank=0, duplicate=0, truncated=0, illegal=0, distinct=0, low=None, high=None, tail=None)

    def add(self, seg: dict) -> None:
        new: dict[int, tuple[int, str, tuple]] = {}
        for p in seg["paths"]:
            if p["entry"] in self.live:
                cost, stand_in, link = self.live[p["entry"]]
                found = (cost + p["cost"], stand_in + p["edits"])
                if p["exit"] not in new or found < new[p["exit"]][:2]:
                    new[p["exit"]] = (*found, (link, seg["segment"], seg["first"], seg["letters"], p["entry"], p["edits"]))
        self.live, base, letter = {}, None, "@"
        for state, (cost, stand_in, link) in sorted(new.items(), key=lambda x: x[1][1]):
            if base is None or not stand_in.startswith(base):
                base, letter = stand_in, chr(ord(letter) + 1)
            self.live[state] = (cost, letter + stand_in[len(base) :], link)
        f, g = self.facts, seg["facts"]
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            f[name] += g[name]
        if f["tail"] is not None:
            f["illegal"] += (f["tail"] + g["head"]) not in ("su", "ua", "au")
        f["distinct"] -= g["low"] is not None and g["low"] == f["high"]
        f["low"] = g["low"] if f["low"] is None else f["low"]
        f["high"] = f["high"] if g["high"] is None else g["high"]
        f["tail"] = g["tail"]

    def close(self, ck: str) -> Iterator[tuple]:
        """A row for each segment with its turns, and one for the conversation."""
        cost, _, link = self.live[START]  # the last segment's goals go by their smallest state
        chain = []
        while link is not None:
            link, *part = link
            chain.append(part)
        place, audit = 0, []
        for segment, first, letters, state, edits in reversed(chain):
            audit.append(edits)
            turns, left, at = [], iter(letters), first
            for edit in edits:
                letter = next(left) if edit != "I" else ""
                if edit != "D":
                    state = MOVES[state, letter] if edit == "K" else NEXT[state]
                    turns.append({"place": place, "edit": edit, "pos": None if edit == "I" else at, "role": None if edit == "K" else ROLES[state]})
                    place += 1
                # copies follow their row and have no place of their own
                at += edit != "I" and letter != COPY
            yield ck, segment, turns, None
        f = self.facts
        gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["distinct"]
        yield ck, None, None, dict(gaps=gaps, blank=f["blank"], duplicate=f["duplicate"], truncated=f["truncated"], illegal=f["illegal"], cost=cost, audit="".join(audit))


_TURNS = "array<struct<place: long, edit: string, pos: long, role: string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = f"ck string, segment long, turns {_TURNS}, summary struct<{', '.join(f'{c}: long' for c in _COUNTS)}, audit: string>"
_FACTS = "struct<blank: long, duplicate: long, truncated: long, illegal: long, low: long, high: long, distinct: long, head: string, tail: string>"
_SEARCHED = f"ck string, segment long, first long, letters string, paths array<struct<entry: byte, exit: byte, cost: long, edits: string>>, facts {_FACTS}"
_HELD = 200  # rows written at once


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to the turns that each keeps, and a summary of each conversation."""
    turn = pa.struct([("place", pa.int64()), ("edit", pa.string()), ("pos", pa.int64()), ("role", pa.string())])
    kinds = [pa.string(), pa.int64(), pa.list_(turn), pa.struct([(c, pa.int64()) for c in _COUNTS] + [("audit", pa.string())])]

    def finished() -> Iterator[tuple]:
        ck, chain = None, None
        for batch in batches:
            for seg in batch.to_pylist():
                if chain is not None and seg["ck"] != ck:
                    yield from chain.close(ck)
                    chain = None
                if chain is None:
                    ck, chain = seg["ck"], _Chain()
                chain.add(seg)
        if chain is not None:
            yield from chain.close(ck)

    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["ck", "segment", "turns", "summary"])

    for row in finished():
        rows.append(row)
        if len(rows) == _HELD:
            yield batch_of()
            rows = []
    if rows:
        yield batch_of()


def _fault(text: Column, is_later: Column) -> Column:
    return (F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(is_later, DUPLICATE)
            .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0))


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> Repaired:
    """Runs jobs while it is called."""
    spark = rows.sparkSession
    id_type = rows.schema[conv_id].dataType
    given = rows.select(
        F.coalesce(F.concat(F.lit("v"), F.col(conv_id).cast("string")), F.lit("n")).alias("ck"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    equal = given.groupBy("ck", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("_h", F.md5("text"))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = equal.groupBy("ck", "role", "_h").agg(F.min(when).alias("_first"))
    initial = F.when(F.col("role").rlike(r"(?s)\A[^\x00]"), F.substring("role", 1, 1)).otherwise(NO_INITIAL)
    marked = equal.join(seen, ["ck", "role", "_h"]).select("ck", "turn", "role", "text", "copies", initial.alias("initial"), _fault(F.col("text"), when > F.col("_first")).alias("fault"))
    at = scratch_path(spark, "ordered")
    marked.repartitionByRange("ck", F.asc_nulls_first("turn"), "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(
        "ck", F.asc_nulls_first("turn"), "role", "text").withColumn("pos", F.monotonically_increasing_id()).write.parquet(at)
    ordered = spark.read.parquet(at)

    narrow = ordered.select("ck", F.expr(f"pos div {segment}").alias("segment"), "pos", "initial", "fault", "copies", "turn")
    segments = narrow.groupBy("ck", "segment").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "initial", "fault", "copies", "turn"))).alias("rows"))
    spans = narrow.groupBy("ck").agg(F.min("segment").alias("_low"), F.max("segment").alias("_high"))
    segments = segments.join(spans, "ck").select("ck", "segment", "first", "rows", (F.col("segment") == F.col("_low")).alias("opens"), (F.col("segment") == F.col("_high")).alias("closes"))
    at = scratch_path(spark, "plan")
    segments.mapInArrow(_searched, _SEARCHED).repartition("ck").sortWithinPartitions("ck", "segment").mapInArrow(_chained, _PLAN).write.parquet(at)
    plan = spark.read.parquet(at)

    own_id = F.when(F.col("ck") != "n", F.substring(F.col("ck"), 2, 1 << 30).cast(id_type)).alias("conv_id")
    summary = plan.where("summary is not null").select(own_id, "summary.*").select("conv_id", *_COUNTS[:-1], "cost", "audit")
    turns = plan.where("turns is not null").select("ck", F.explode("turns").alias("t")).select("ck", "t.*").withColumnRenamed("role", "_new")
    kept = turns.where("pos is not null").join(ordered.select("pos", "turn", "role", "text"), "pos").select(own_id, "place", "edit", "turn", F.coalesce("_new", "role").alias("role"), "text")
    made = turns.where("pos is null").select(own_id, "place", "edit", F.lit(None).cast("long").alias("turn"), F.col("_new").alias("role"), F.lit("").alias("text"))
    return Repaired(summary, kept.unionByName(made))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of a conversation's ``role:text``, joined
    by line ends, streamed turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, now, conv = [], [], None, None
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for this, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or this != conv:
                    if now is not None:
                        ids.append(conv)
                        hashes.append(now.hexdigest())
                    now, conv = hashlib.sha256(), this
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
            ids, hashes = [], []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    streamed = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return streamed.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
