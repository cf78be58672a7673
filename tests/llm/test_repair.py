"""Conversation repair against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import queries, repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SOME = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault of every (role, text) of a conversation."""
    out, seen = [], set()
    for role, text in rows:
        last = SOME.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def shortest(rows):
    """(cost, audit, turns) by a search over (row, role initials as a pattern state),
    cheapest and then first by initials."""
    kinds = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, turns
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        full = {"u": "user", "a": "assistant"}
        new = after[-1]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*turns, (full[new], ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, turns))
            if kinds[i] in ("", "truncated"):
                more = kinds[i] == "truncated"
                if role[:1] and role[0] in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*turns, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new, (*turns, (full[new], text))))


def expected(rows):
    """rows: (turn, role, text), in order."""
    kinds = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    cost, audit, kept = shortest([r[1:] for r in rows])
    assert GOOD.match("".join(r[0] for r, _ in kept))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


ROLES = ["system", "user", "assistant", "tool", "sys", ""]
TEXTS = ["Done.", "Why?", "cut off", " ", "", "Well. then", "Ok!\n", "again."]
ITEM = st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS))


@settings(max_examples=400, deadline=None)
@given(st.lists(ITEM, max_size=14))
def test_search_is_optimal(rows):
    marks = {"": 0, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}
    mine = repair.cheapest([(role[:1] or repair.NO_INITIAL, marks[f], 0) for (role, _), f in zip(rows, faults(rows))])
    assert mine == shortest(rows)[:2]


def test_search_stays_small():
    """A whole segment of ties: the table and the bounds keep the search near linear."""
    for letters in ("u", "s", "ua", "uas", "t", "us", "uuaa"):
        rows = [(letters[i % len(letters)], 0 if i % 5 else repair.TRUNCATED, 0) for i in range(2 * repair.SEGMENT)]
        for entry in range(4):
            for goal in range(4):
                repair.cheapest(rows, entry, frozenset((goal,)))


def sample(seed: int):
    rng = random.Random(seed)
    rows = [(5, None, "user", "Hi."), (5, None, "user", "Hi."), (5, None, None, None), (None, 2, "user", "So."), (None, 1, "assistant", "a."), (6, None, "tool", " "),
            (7, 0, "user", "x" * 100_000), (7, 1, "assistant", "y. " * 50_000), (7, 1, "assistant", "y. " * 50_000)]
    for conv in range(10, 60):
        rows += [(conv, rng.choice([None, *range(12)]), rng.choice([*ROLES, None]), rng.choice([*TEXTS, None, f"t{rng.random()}."])) for _ in range(rng.randrange(1, 12))]
    rows += [(8, i // 2, rng.choice(ROLES[:4]), f"{rng.randrange(400)}{rng.choice('.!,')}") for i in range(1200)]
    return rows + [(9, 3, "user", "same.")] * 700


@pytest.mark.parametrize("segment", [3, 64, repair.SEGMENT])
def test_repair(spark, segment):
    rows = sample(segment)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("ck", "pos", "place", "segment", "copies", "_h"):
        df = df.withColumn(name, F.lit(0))
    made = repair.repair(df.repartition(5), segment=segment)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(made.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty)) for r in made.summary.collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    assert got == {conv: expected(sorted(group, key=order)) for conv, group in by.items()}
    assert sorted(r.place for r in made.turns.where("conv_id = 8").collect()) == list(range(made.turns.where("conv_id = 8").count()))


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    made = repair.repair(df)
    assert made.summary.count() == 0 and repair.digests(made.turns).count() == 0


def test_named_query(spark, tmp_path):
    rows = [r for r in sample(1) if r[0] != 8] + [(c, t, ("user", "assistant")[t % 2], f"{c} says {t}.") for c in range(100, 160) for t in range(6)] + [(4, 1, "user", "x.")] * 2
    rows += [(c, 0, None, None) for c in range(200, 240)]  # some lose all their rows
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = {}
    for conv, turn, role, text in rows:
        group = by.setdefault(conv, [])
        hurt = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if hurt == 4 else role, "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text)
        group += [] if hurt == 0 else [row, row] if hurt == 3 else [row]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = queries.op11(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r[n] for n in names) for r in out} == {c: expected(sorted(g, key=order)) for c, g in by.items()} and len(out) == len(by)
    assert not all(by.values())
