"""Lexical search and source mixing against plain Python."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from harness import compare, connect
from lexweave.llm import lexical, mixing, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Multiset of (item_id, rank, doc_id, score)."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = [r.text for r in docs.collect() if r.text]
    rows = [(i, " ".join(t.split()[i : i + 30])) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "?!"), (93, "Alpha3 beta ALPHA3 nothing"), (93, "Alpha3 beta ALPHA3 nothing"), (93, "omega5 mu2"), (None, "x one two"), (94, texts[3]), (95, "日本語 ßtraße")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("ik", F.lit(1)).withColumn("doc_id", F.lit(2)).withColumn("rank", F.lit(3))


@pytest.mark.parametrize("how", [{}, {"chunk": 8, "block": 2, "set_terms": 40, "sample": 2}, {"chunk": 5, "block": 1, "k": 3, "sample": 3}])
def test_search_is_exact(spark, docs, items, how):
    many = docs.unionByName(docs.where("doc_id in (1, 8, 12)").withColumn("doc_id", F.col("doc_id") + 100))
    got = lexical.search(many, items, **how)
    want = ranked([(r.doc_id, r.text) for r in many.collect()], [(r.item_id, r.text) for r in items.collect()], how.get("k", lexical.TOP))
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == want


def test_search_of_nothing(spark, docs, items, empty):
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0


def test_blocks_are_skipped(spark):
    """On documents in groups, bounds of many blocks are below the threshold, and the result is exact."""
    import numpy as np

    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 40, 4096))
    words = [sorted(set((g * 50 + rng.integers(0, 50, 20)).tolist() + rng.integers(0, 2000, 3).tolist())) for g in group]
    impacts = np.zeros((2000, 4096), np.int32)
    for d, w in enumerate(words):
        impacts[w, d] = rng.integers(100, 900, len(w))
    rows = [{"ik": i, "terms": [{"term": int(t), "w": int(rng.integers(500, 4000))} for t in words[d]]} for i, d in enumerate(rng.integers(0, 4096, 30))]
    made = lexical._Items(rows, {})
    full = impacts[made.vocabulary]
    none = np.zeros(0, np.int64)
    found, floor, seen = [(none, none.astype(bool), none)] * 30, made.floor.copy(), np.zeros(2, np.int64)
    for again in range(2):  # the second time with the thresholds of the first
        seen[:], found[:] = 0, [(none, none.astype(bool), none)] * 30
        lexical._search_stretch(made, full, np.arange(4096), np.zeros(4096, bool), found, floor, 10, lexical.BLOCK, seen)
    for i, (t, w) in enumerate(zip(made.terms, made.weights)):
        score = w @ full[t].astype(np.int64)
        assert found[i][0].tolist() == np.lexsort((np.arange(4096), -score))[:10].tolist()
    assert seen[1] < 0.8 * seen[0]


def filled(sizes, weights, share, most):
    """Targets by resharing what is above the caps, in exact numbers."""
    left, out, open_ = Fraction(share) * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        above = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not above:
            return out | {s: float(level * w) for s, w in open_.items()}
        for s in above:
            out[s], left = float(most * sizes[s]), left - most * sizes[s]
            del open_[s]
    return out


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix(spark, docs, block):
    hot = docs.where("doc_id = 4").withColumn("source", F.lit("big"))
    many = docs.unionByName(hot).withColumn("rid", F.lit(1)).withColumn("slot", F.lit(1)).withColumn("no", F.lit("x"))
    rows = many.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)

    made = mixing.mix(many, block=block)
    out = mixing.taken(made).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in out) == Counter((r.doc_id, size(r.text), sizes[r.source]) for r in rows)
    assert all(r.taken <= 2 * r.size for r in out)
    for s in made.sources.collect():
        assert abs(s.target - want[s.source]) < 1e-6 * max(s.target, 1) and s.source_size == sizes[s.source] and abs(s.words - s.target) <= 0.5
    words = {r.source: r.words for r in made.sources.collect()}
    by = Counter()
    source_of = {r.rid: r.source for r in made.docs.collect()}
    plan = sorted(made.schedule.collect(), key=lambda r: (r.slot, r.place))
    for r in plan:
        by[source_of[r.rid]] += r.last - r.first
        assert 0 <= r.first < r.last and 0 <= r.place and r.place + r.last - r.first <= block
    assert {s: n for s, n in words.items() if n} == dict(by)
    # a slot is one source's; slots are filled from the start without gaps; no word comes twice in a pass
    slots, used = {}, Counter()
    for r in plan:
        s, end = slots.get(r.slot, (source_of[r.rid], 0))
        assert s == source_of[r.rid] and r.place == end
        slots[r.slot] = (s, end + r.last - r.first)
        used.update((r.rid, r["pass"], w) for w in range(r.first, r.last))
    assert max(used.values()) == 1 and sorted(slots) == list(range(len(slots)))
    again = mixing.taken(mixing.mix(many.repartition(3), block=block)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_schedule_is_even(spark):
    """Any run of slots holds each source about as often as its share says."""
    df = spark.createDataFrame([(i, f"s{i % 5}", "w " * (40 * (i % 5 + 1))) for i in range(500)], "doc_id long, source string, text string")
    made = mixing.mix(df, block=8)
    no = {r.rid: r.source for r in made.docs.collect()}
    at = {r.slot: no[r.rid] for r in made.schedule.collect()}
    total, share = len(at), Counter(at.values())
    for start in range(0, total - 200, 97):
        part = Counter(at[k] for k in range(start, start + 200))
        assert all(abs(part[s] - 200 * n / total) < 6 for s, n in share.items())


def test_many_sources(spark, docs, monkeypatch):
    plain = Counter(map(tuple, mixing.mix(docs, block=16).schedule.drop("rid").collect()))
    monkeypatch.setattr(mixing, "LOOKUP", 1)  # the way without an array of sources
    assert Counter(map(tuple, mixing.mix(docs, block=16).schedule.drop("rid").collect())) == plain
    for n in (1, 2, 3, 10, 89):
        assert sorted(r.at for r in mixing.points(spark, n).collect()) == list(range(n))
    big = (1 << 31) + 1
    step = mixing.golden_step(big)
    part = mixing.points(spark, big).where("slot in (0, 1, 2147483000)").collect()
    assert {r.slot: r.at for r in part} == {s: s * step % big for s in (0, 1, 2147483000)}


def test_mix_of_nothing(spark, empty, docs):
    assert mixing.taken(mixing.mix(empty)).count() == 0
    rows = mixing.taken(mixing.mix(docs.where("text is null"))).collect()
    assert len(rows) == 2 and all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in rows)


@pytest.mark.parametrize("name", ["op12_blocked_search", "op13_source_schedule"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == []
