"""Dependency paths, span permutations and bootstrap intervals on small tables."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from lexweave.operators import permute, style


def test_dependency_paths(spark):
    deep = [("deep", i, i - 1, "dep", f"T{i}") for i in range(1, 41)]  # a chain of forty
    rows = [("a", 1, 2, "nsubj", "NOUN"), ("a", 2, 0, "root", "VERB"), ("a", 3, 1, "amod", "ADJ"), ("a", 4, 9, "obj", "NOUN"), ("a", 5, 4, "det", "DET"),
            ("b", 1, 2, "x", "A"), ("b", 2, 1, "y", "B"), ("b", 3, 2, "z", "C"), ("b", 4, 4, "self", "D"), ("b", 5, None, "root", "E"), ("b", 6, 5, None, "F"),
            ("c", 1, 0, "root", "VERB"), ("c", 1, 0, "aux", "AUX"), *deep]
    df = spark.createDataFrame(rows, "s string, index int, head int, deprel string, upos string")
    got = {(r.s, r["index"]): (r.path, r.steps) for r in style.dependency_paths(df, ["s"]).collect()}
    assert got["a", 3] == ("root-VERB>nsubj-NOUN>amod-ADJ", 3) and got["a", 2] == ("root-VERB", 1)
    assert all(got[k] == (None, None) for k in [("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 4)])  # missing heads and cycles
    assert got["b", 6] == ("root-E>-F", 2) and got["c", 1] == ("aux-AUX", 1)
    assert got["deep", 40] == (">".join(f"dep-T{i}" for i in range(1, 41)), 40) and len(got) == 12 + 40
    n = {r.feature: r.n for r in style.path_counts(df.where("s <> 'deep'").withColumn("u", F.lit(1)), ["u"], ["s"]).collect()}
    assert n["malformed"] == 6 and sum(n.values()) == 12
    assert style.dependency_paths(df.limit(0), ["s"]).count() == 0


def test_span_permutation(spark):
    rng = random.Random(4)
    values = {None: [rng.random() for _ in range(30)], "b": [float(5 <= i < 9) + 0.1 * rng.random() for i in range(25)], "whole": [1.0, 2.0], "gap": [1.0, 2.0, 3.0, 4.0]}
    span = {None: range(26, 30), "b": range(5, 9), "whole": range(2), "gap": (0, 2)}
    rows = [(g, i, v, i in span[g]) for g, vs in values.items() for i, v in enumerate(vs)] + [("b", 99, None, True)]
    df = spark.createDataFrame(rows, "g string, i int, v double, inside boolean")
    got = {r.g: r for r in permute.span_permutation(df.repartition(4), ["g"], ["i"], "v", F.col("inside"), 1000).collect()}
    assert set(got) == {None, "b"}
    for g, r in got.items():
        vs, size, first = values[g], len(span[g]), span[g][0]
        gap = lambda k: (lambda w: w / size - (sum(vs) - w) / (len(vs) - size))(sum(vs[(k + j) % len(vs)] for j in range(size)))
        others = [gap(k) for k in range(len(vs)) if k != first]
        extreme = sum(abs(x) >= abs(gap(first)) - 1e-9 for x in others)
        assert (r.rows, r.span, r.shifts, r.as_extreme) == (len(vs), size, len(others), extreme) and abs(r.difference - gap(first)) < 1e-8
        assert r.p_value == (1 + extreme) / (1 + len(others))
    few = permute.span_permutation(df, ["g"], ["i"], "v", F.col("inside"), 7).collect()
    assert {r.shifts for r in few} == {7}


def test_poisson_bootstrap(spark):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], rng.gauss(10, 2)) for i in range(400)] + [(900, "a", None), (901, None, 3.0), (902, None, 5.0)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = {r.g: r for r in permute.poisson_bootstrap(df.repartition(3), ["g"], ["i"], "v", 40).collect()}
    assert set(got) == {"a", "b", None} and got["a"].n == 200
    for g in "ab":
        vs = [v for _, k, v in rows if k == g and v is not None]
        exact = statistics.stdev(vs) / len(vs) ** 0.5
        assert 0.6 * exact < got[g].stderr < 1.6 * exact and got[g].low < statistics.mean(vs) < got[g].high
    # one replicate by hand
    from lexweave.operators.permute import _POISSON

    def weight(i, r):
        u = int(hashlib.md5(f"boot|{r // 8}|{i}".encode()).hexdigest()[4 * (r % 8) : 4 * (r % 8) + 4], 16) / 65536
        return sum(u >= p for p in _POISSON)

    means = []
    for r in range(40):
        w = [(weight(i, r), v) for i, k, v in rows if k == "a" and v is not None]
        means.append(sum(a * v for a, v in w) / sum(a for a, _ in w))
    assert abs(statistics.stdev(means) - got["a"].stderr) < 1e-9 and abs(sorted(means)[0] - got["a"].low) < 1e-9


def test_null_model_by_hand(spark, monkeypatch):
    """Draws and counts as in plain Python; no table of rows holds a hash or a second node."""
    pairs = sorted({(i * i % 11, i * 7 % 13) for i in range(60)})
    parent = {i: i % 3 for i in range(11)} | {5: None}
    tables = []
    monkeypatch.setattr(permute, "written", lambda df, keep=permute.written: tables.append(df.columns) or keep(df))
    inc = spark.createDataFrame([*pairs, (4, None)], "place long, person long")
    groups = spark.createDataFrame(list(parent.items()), "place long, parent long")
    digest = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    full = inc.where("person is not null")
    got = {(r.rep, r.place, r.person) for r in permute.shuffled_incidence(full, "place", "person", 4).collect()}
    assert [set(c) for c in tables] == [{"rep", "place", "_id"}, {"rep", "person", "_id"}]
    draws = {rep: set(zip((a for a, b in sorted(pairs, key=lambda x: digest("slot", rep, *x))), (b for a, b in sorted(pairs, key=lambda x: digest("card", rep, *x[::-1]))))) for rep in range(4)}
    assert got == {(rep, *x) for rep, d in draws.items() for x in d}
    want = {}
    for rep, d in {-1: set(pairs), **draws}.items():
        for a, b in d:
            if parent[a] is not None:
                want[rep, a] = want.get((rep, a), 0) + any(c != a and e == b and parent[c] == parent[a] for c, e in d)
    rows = spark.createDataFrame([(r, *x) for r, d in {-1: set(pairs), **draws}.items() for x in d] * 2 + [(-1, 4, None)], "rep int, place long, person long")
    assert {(r.rep, r.place): r.shared for r in permute.shared_in_group(rows, groups, "place", "person", "parent").collect()} == want
