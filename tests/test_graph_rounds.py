"""Weighted betweenness, communities and bridges against plain Python."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions.numbers import haversine
from lexweave.operators import communities, geo, graph, graph_iter, pairs, paths, tours


def frame(spark, edges):
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long")


def neighbours(edges):
    adj = {}
    for (a, b), w in edges.items():
        adj.setdefault(a, {})[b] = w
        adj.setdefault(b, {})[a] = w
    return adj


def brandes(adj, length, sources=None):
    total = dict.fromkeys(adj, 0.0)
    for s in sources or adj:
        dist, sigma, before, order, heap, done = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in adj[u].items():
                e = round(d + length(w), 9)
                if v not in dist or e < dist[v]:
                    dist[v], sigma[v], before[v] = e, sigma[u], [u]
                    heapq.heappush(heap, (e, v))
                elif e == dist[v] and v not in done:
                    sigma[v] += sigma[u]
                    before[v].append(u)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += sigma[u] / sigma[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    n = len(adj)
    return {v: x * (n / len(sources or adj)) / ((n - 1) * (n - 2)) for v, x in total.items()}


LENGTHS = {"hops": (lambda: None, lambda w: 1.0), "weight": (lambda: F.col("weight"), float), "inverse": (lambda: 1.0 / F.col("weight"), lambda w: round(1.0 / w, 9))}


@pytest.mark.parametrize("kind", LENGTHS)
def test_betweenness(spark, kind):
    column, length = LENGTHS[kind]
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(24), 2))): rng.choice([1, 1, 2, 3, 7]) for _ in range(45)} | {(100, 101): 2, (101, 102): 5}
    # a detour of three light edges beside one heavy edge: hops and lengths disagree
    edges |= {(30, 31): 1, (31, 32): 1, (32, 33): 1, (30, 33): 9, (33, 34): 1, (34, 35): 2, (33, 35): 3, (0, 30): 1}
    adj = neighbours(edges)
    want = brandes(adj, length)
    got = {r.node: r.betweenness for r in paths.betweenness(frame(spark, edges), 1000, length=column()).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    if kind != "hops":
        hops = brandes(adj, lambda w: 1.0)
        assert any(abs(hops[v] - want[v]) > 0.01 for v in want)


def test_paths_of_nothing(spark):
    g = frame(spark, {(1, 2): 3}).limit(0)
    assert paths.betweenness(g, 5).count() == 0 and tours.bridges(g).count() == 0 and communities.louvain(g).labels.count() == 0
    with pytest.raises(ValueError):
        paths.betweenness(frame(spark, {(1, 2): 0}), 5, length=F.col("weight"))
    assert [(r.d, r.sigma) for r in paths.distances(frame(spark, {(1, 2): 3}), spark.createDataFrame([(1,)], "s long"), F.col("weight")).orderBy("d").collect()] == [(0.0, 1.0), (3.0, 1.0)]


def modularity(edges, label):
    m = sum(edges.values())
    strength = {}
    for (a, b), w in edges.items():
        for x in (a, b):
            strength[label[x]] = strength.get(label[x], 0) + w
    return sum(w for (a, b), w in edges.items() if label[a] == label[b]) / m - sum((s / (2 * m)) ** 2 for s in strength.values())


def test_louvain_known_partition(spark):
    """A ring of cliques, and two cliques joined by one edge."""
    edges = {}
    for c in range(12):
        edges |= {(a + 10 * c, b + 10 * c): 2 for a, b in itertools.combinations(range(5), 2)}
        edges[tuple(sorted((10 * c, (10 * c + 11) % 120)))] = 1
    found = communities.louvain(frame(spark, edges))
    label = {r.node: r.label for r in found.labels.collect()}
    groups = [{v for v in label if v // 10 == c} for c in range(12)]
    assert all(len({label[v] for v in g}) == 1 for g in groups) and all(label[v] == min(w for w in label if label[w] == label[v]) for v in label)
    assert found.quality == sorted(found.quality) and abs(found.quality[-1] - modularity(edges, label)) < 1e-9
    assert found.quality[-1] >= modularity(edges, {v: v // 10 for v in label}) - 1e-9


def test_louvain_beats_labels(spark):
    rng = random.Random(1)
    edges = {}
    for _ in range(900):
        a, b = rng.sample(range(150), 2)
        if a // 15 == b // 15 or rng.random() < 0.12:
            edges[tuple(sorted((a, b)))] = rng.randint(1, 4)
    g = frame(spark, edges)
    found = communities.louvain(g)
    label = {r.node: r.label for r in found.labels.collect()}
    assert label.keys() == neighbours(edges).keys()
    assert all(x < y for x, y in zip(found.quality, found.quality[1:-1])) and abs(found.quality[-1] - modularity(edges, label)) < 1e-9
    spread = {r.node: r.label for r in graph_iter.label_communities(g, rounds=6).collect()}
    assert found.quality[-1] >= modularity(edges, spread) - 1e-9
    assert graph.modularity(g, found.labels).first()[0] == pytest.approx(found.quality[-1])


def test_forest_and_tour(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(60), 2))): 1 for _ in range(70)} | {(90, 91): 1}
    tree, names = tours.spanning_forest(frame(spark, edges))
    root = {r.node: r.root for r in names.collect()}
    comp = {r.node: r.component for r in graph_iter.components(frame(spark, edges)).collect()}
    assert {(root[a] == root[b]) for a, b in edges} == {True} and len(set(root.values())) == len(set(comp.values()))
    taken = {(r.src, r.dst) for r in tree.collect()}
    assert taken <= set(edges) and len(taken) == len(root) - len(set(root.values()))
    for top in set(root.values()):
        arcs = sorted((-r.after, r.u, r.v) for r in tours.euler_tour(tree, names).where(F.col("root") == top).collect())
        walk = [(u, v) for _, u, v in arcs]
        assert walk[0][0] == walk[-1][1] == top and all(a[1] == b[0] for a, b in zip(walk, walk[1:])) and len(set(walk)) == len(walk)


def brute_bridges(edges):
    adj = neighbours(edges)
    out = set()
    for a, b in edges:
        seen, todo = {a}, [a]
        while todo:
            u = todo.pop()
            new = [v for v in adj[u] if v not in seen and {u, v} != {a, b}]
            seen.update(new)
            todo += new
        if b not in seen:
            out.add((a, b))
    return out


def test_bridges(spark):
    rng = random.Random(45)
    edges = {tuple(sorted(rng.sample(range(70), 2))): 1 for _ in range(75)}
    assert {(r.src, r.dst) for r in tours.bridges(frame(spark, edges)).collect()} == brute_bridges(edges)


def test_bridges_of_a_long_path(spark, monkeypatch):
    """Rounds grow with the logarithm of the length: 10,000 nodes in a row, the
    last 100 of them closed to a ring."""
    rounds = []
    monkeypatch.setattr(tours, "written", lambda df, keep=tours.written: rounds.append(1) or keep(df))
    g = spark.range(9999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(9900, 9999)], "src long, dst long"))
    assert sorted(r.src for r in tours.bridges(g).collect()) == list(range(9900))
    assert len(rounds) < 120


def test_betweenness_over_small_blocks(spark, monkeypatch):
    """A hub's edges lie in several blocks, and sources in several parts; names are strings."""
    for name, value in {"BLOCK_EDGES": 12, "LIST": 3, "ROWS": 2, "TASKS": 12, "STEPS": 100}.items():
        monkeypatch.setattr(paths, name, value)
    rng = random.Random(5)
    edges = {(0, i): rng.choice([1, 2, 3]) for i in range(1, 13)} | {(i, i + 1): 1 for i in range(1, 12)}
    want = brandes(neighbours(edges), float)
    g = frame(spark, edges).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "weight")
    got = {r.node: r.betweenness for r in paths.betweenness(g, 1000, length=F.col("weight")).collect()}
    assert got.keys() == {f"n{v}" for v in want} and all(abs(got[f"n{v}"] - want[v]) < 1e-9 for v in want)


def test_small_rows_with_many_pairs_stay_spread(spark):
    """The adaptive planner sees a few kilobytes, not the square of a group."""
    df = spark.range(400).select((F.col("id") % 4).alias("ctx"), F.col("id").alias("item"))
    for made in (pairs.pairs_within(df, ["ctx"], "item"), pairs.pairs_within(df, ["ctx"], "item", block_rows=20), pairs.pairs_between(df, df.withColumnRenamed("item", "other"), ["ctx"], block_rows=20)):
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    points = df.select(F.col("item").alias("id"), (F.lit(37.0) + F.col("item") / 400).alias("lat"), (F.lit(22.0) + F.col("ctx") / 4).alias("lon"))
    near = geo.within_radius(points, points, "id", 15.0)
    plain = points.crossJoin(points.toDF("id_b", "lat_b", "lon_b")).where("id <> id_b").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).where("km <= 15")
    assert near.count() == plain.count() > 0


def test_clustering_forms_no_wedge_rows(spark, monkeypatch):
    """Wheels and a dense part, against plain Python, without pairs of a node's edges."""
    rng = random.Random(8)
    rows = {("hub", f"r{i}"): 1 + i % 3 for i in range(40)} | {(f"r{i}", f"r{i + 1}"): 2 for i in range(0, 38, 2)}
    rows |= {(f"x{i}", f"x{j}"): rng.randrange(1, 9) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.6}
    rows = {(min(e), max(e)): w for e, w in rows.items()}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src string, dst string, weight long")
    monkeypatch.setattr(graph, "pairs_within", None)
    nbr = {}
    for a, b in rows:
        nbr.setdefault(a, set()).add(b)
        nbr.setdefault(b, set()).add(a)
    top, weight = max(rows.values()), lambda a, b: rows[min(a, b), max(a, b)]
    want = {}
    for a, near in nbr.items():
        hits = [(b, c) for b in near for c in near if b < c and c in nbr[b]]
        g = sum((weight(a, b) * weight(a, c) * weight(b, c) / top**3) ** (1 / 3) for b, c in hits)
        k = len(near)
        want[a] = (k, len(hits), round(2 * len(hits) / (k * (k - 1)) if k > 1 else 0.0, 6), round(2 * g / (k * (k - 1)) if k > 1 else 0.0, 6))
    got = {r.node: (r.degree, r.triangles, round(r.clustering, 6), round(r.weighted_clustering, 6)) for r in graph.clustering(edges).collect()}
    assert got == want and sum(n for _, n, _, _ in want.values()) > 100
    assert graph.clustering(edges.where("weight > 100")).count() == 0


def test_rounds_hold_numbers_not_names(spark, monkeypatch):
    """Named nodes give the same bridges and cores; no round's table has a name in it."""
    rng = random.Random(4)
    plain = {(a, b): 1 for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.11} | {(a, a + 1): 1 for a in range(30, 36)}
    named = spark.createDataFrame([(f"name {a:03}", f"name {b:03}", 1) for a, b in plain], "src string, dst string, weight long")
    kinds = []
    for module in (tours, graph_iter):
        monkeypatch.setattr(module, "written", lambda df, keep=module.written: kinds.extend(t for _, t in df.dtypes) or keep(df))
    found = {(r.src, r.dst) for r in tours.bridges(named).collect()}
    core = {r.node: r.core for r in graph_iter.core_numbers(named).collect()}
    assert kinds and not any("string" in k for k in kinds)
    assert found == {(f"name {a:03}", f"name {b:03}") for a, b in brute_bridges(plain)} and found
    assert core == {f"name {r.node:03}": r.core for r in graph_iter.core_numbers(frame(spark, plain)).collect()}
