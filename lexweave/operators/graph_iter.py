"""Iterative graph operators as rounds of joins.

Each round cuts its lineage with a reliable checkpoint or a table in the shared
folder, so plans stay short and a lost executor only repeats the current round.
Convergence is a count on the cut table.  Joins meet an edge table with a node table of unique keys, so a
hub skews only the edge side, which the adaptive skew join splits.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written
from . import cells
from .graph import both_ways, long_names, nodes_of, short_names


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the component is named by its smallest node.

    Hook-and-shortcut rounds: a node's root and the root's root move to the
    smallest label seen across any edge, so the number of rounds grows with
    the logarithm of the longest path.
    """
    links = written(both_ways(edges.withColumn("weight", F.lit(1))).select("node", "nbr"))
    all_nodes = nodes_of(edges, nodes)
    state = written(all_nodes.select("node", F.col("node").alias("f"), F.col("node").alias("g")))
    while True:
        seen = links.join(state.select(F.col("node").alias("nbr"), F.col("g").alias("m")), "nbr").groupBy("node").agg(F.min("m").alias("m"))
        s = state.join(seen, "node", "left").withColumn("m", F.least("g", F.coalesce("m", "g")))
        moves = s.select(F.inline(F.array(
            F.struct(F.col("node").alias("node"), F.col("m").alias("f")),
            F.struct(F.col("f").alias("node"), F.col("m").alias("f")))))
        parent = written(moves.groupBy("node").agg(F.min("f").alias("f")))
        grand = parent.select(F.col("node").alias("f"), F.col("f").alias("g2"))
        new = written(parent.join(grand, "f").join(state.select("node", F.col("g").alias("old")), "node").select(
            "node", "f", F.col("g2").alias("g"), (F.col("g2") != F.col("old")).alias("moved")))
        state = new.select("node", "f", "g")
        if new.where("moved").isEmpty():
            break
    return state.select("node", F.col("g").alias("component"))


def _grown(done: DataFrame, frontier: DataFrame, round_no: int) -> DataFrame:
    """Visited rows plus a frontier that is already cut: a short union, folded
    into one checkpoint every few rounds."""
    both = done.unionByName(frontier)
    return written(both) if round_no % 6 == 0 else both


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.join(comp.groupBy("component").agg(F.count("*").alias("size")), "component")


def largest_component(comp: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties to the smallest name)."""
    top = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return comp.join(top.select("component"), "component", "left_semi").select("node")


def core_subgraph(edges: DataFrame, keep_nodes: DataFrame) -> DataFrame:
    """Edges of the largest component, restricted to ``keep_nodes``, and then
    of the largest component of what is left; isolated nodes fall away."""

    def induced(e: DataFrame, nodes: DataFrame) -> DataFrame:
        return e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(
            nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")

    main = induced(edges, largest_component(components(edges)))
    core = cut(induced(main, keep_nodes))
    return induced(core, largest_component(components(core)))


def pagerank(
    edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85,
    rounds: int = 500, tol: float = 1e-6, check_every: int = 5,
) -> DataFrame:
    """Weighted PageRank of an undirected graph.

    Only isolated nodes dangle; they all carry the same rank, which follows a
    scalar recurrence on the driver, so no round needs a global sum.  Rounds go
    on until the ranks change by less than ``tol`` per node; if they don't within
    ``rounds``, that is an error.
    """
    everyone = written(nodes_of(edges, nodes))
    n = everyone.count()
    strength = written(both_ways(edges).groupBy("node").agg(F.sum("weight").cast("double").alias("s")))
    alone = everyone.join(strength, "node", "left_anti")
    n_alone = alone.count()
    links = cells.grid(edges)
    state = written(cells.packed(links, strength.join(links.nodes, "node").select("no", F.lit(1.0 / n).alias("rank"), (1 / F.col("s")).alias("per")), ["rank", "per"]))
    lone = 1.0 / n
    for i in range(1, rounds + 1):
        base = alpha * (n_alone * lone) / n + (1 - alpha) / n

        def settle(v: list[np.ndarray], y: np.ndarray, base: float = base) -> list[np.ndarray]:
            new = base + alpha * y
            return [new, v[1], np.array([np.abs(new - v[0]).sum()])]

        state = written(cells.advanced(links, state, ["rank", "per"], lambda v: v[0] * v[1], settle, ["rank", "per", "moved"]))
        lone = base
        if i % check_every == 0 or i == rounds:
            moved = cells.summed(state, "moved")
            if moved < n * tol:
                break
            if i == rounds:
                raise RuntimeError(f"ranks still change by {moved} after {rounds} rounds")
    return cells.unpacked(links, state, "rank").unionByName(alone.withColumn("rank", F.lit(lone)))


def eigenvector(edges: DataFrame, rounds: int = 1000, tol: float = 1e-9, check_every: int = 10) -> DataFrame:
    """Weighted eigenvector centrality by power iteration on A + I, unit length.

    Iterates are scaled by a constant (the largest strength), so normalising
    once at the end is enough.  Rounds go on until the unit vector moves by less
    than ``tol`` in ``check_every`` rounds; if it doesn't within ``rounds``, that
    is an error.
    """
    strength = written(both_ways(edges).groupBy("node").agg(F.sum("weight").cast("double").alias("s")))
    scale = float(strength.agg(F.max("s")).first()[0] or 1.0)
    links = cells.grid(edges)
    one = strength.join(links.nodes, "node").select("no", F.lit(1.0).alias("x"), F.lit(0.0).alias("old"))
    state = written(cells.packed(links, one, ["x", "old"]))

    def settle(v: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        x = (y + v[0]) / scale
        return [x, v[1], np.array([x @ x])]

    for i in range(1, rounds + 1):
        state = written(cells.advanced(links, state, ["x", "old"], lambda v: v[0], settle, ["x", "old", "square"]))
        if i % check_every and i < rounds:
            continue
        norm = float(np.sqrt(cells.summed(state, "square"))) or 1.0
        # the last unit vector starts the next rounds, so numbers stay near 1
        state = written(cells.mapped(state, ["x", "old"], lambda v, norm=norm: [v[0] / norm, v[0] / norm, np.array([((v[0] / norm - v[1]) ** 2).sum()])], ["x", "old", "moved"]))
        moved = float(np.sqrt(cells.summed(state, "moved")))
        if i > check_every and moved < tol:
            break
        if i > check_every and i >= rounds:
            raise RuntimeError(f"the vector still moves by {moved} after {rounds} rounds")
    return cells.unpacked(links, state, "x").withColumnRenamed("x", "eigenvector")


def hop_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Hops from the nearest source; unreachable nodes are absent."""
    links = written(both_ways(edges.withColumn("weight", F.lit(1))).select("node", "nbr"))
    frontier = written(sources.select("node").distinct())
    done = frontier.withColumn("hops", F.lit(0))
    for hop in itertools.count(1):
        nxt = links.join(frontier, "node", "left_semi").select(F.col("nbr").alias("node")).distinct()
        frontier = written(nxt.join(done, "node", "left_anti"))
        if frontier.isEmpty():
            break
        done = _grown(done, frontier.withColumn("hops", F.lit(hop)), hop)
    return done


def local_reach(edges: DataFrame, targets: DataFrame, cutoff: int) -> DataFrame:
    """(target, node, hops) up to ``cutoff`` hops around each target."""
    links = both_ways(edges.withColumn("weight", F.lit(1))).select("node", "nbr")
    frontier = targets.select(F.col("node").alias("target"), "node").distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, cutoff + 1):
        nxt = frontier.join(links, "node").select("target", F.col("nbr").alias("node")).distinct()
        frontier = written(nxt.join(seen, ["target", "node"], "left_anti"))
        seen = written(seen.unionByName(frontier.withColumn("hops", F.lit(hop))))
    return seen


def reach_counts(reach: DataFrame, cutoff: int) -> DataFrame:
    counts = [F.count_if(F.col("hops") == h).alias(f"at_{h}") for h in range(1, cutoff + 1)]
    return reach.groupBy(F.col("target").alias("node")).agg(*counts)


def nearest_hub(reach: DataFrame, hubs: DataFrame) -> DataFrame:
    """Closest other hub within reach (ties to the smallest name)."""
    near = reach.where("hops > 0").join(hubs.select("node"), "node", "left_semi")
    return near.groupBy("target").agg(F.min(F.struct("hops", "node")).alias("m")).select(
        F.col("target").alias("node"), F.col("m.node").alias("hub"), F.col("m.hops").alias("hops"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """k-core numbers: each node repeatedly takes the h-index of its
    neighbours' values, starting from the degree, until nothing changes.

    The h-index works on counts of distinct neighbour values, which are few
    even for a hub.
    """
    edges, names = short_names(edges)
    links = written(both_ways(edges).select("node", "nbr"))
    state = written(links.groupBy("node").agg(F.count("*").alias("k")))
    w = Window.partitionBy("node").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)

    def lower(now: DataFrame) -> DataFrame:
        votes = links.join(now.select(F.col("node").alias("nbr"), F.col("k").alias("v")), "nbr").join(now, "node")
        hist = votes.groupBy("node", F.least("v", "k").alias("v")).agg(F.count("*").alias("c"))
        return hist.withColumn("at_least", F.sum("c").over(w)).groupBy("node").agg(F.max(F.least("v", "at_least")).alias("k"))

    while True:
        # two rounds per checkpoint: values only fall, so equality after both means done
        moved = written(lower(lower(state)).join(state.withColumnRenamed("k", "old"), "node"))
        done = moved.where("k <> old").isEmpty()
        state = moved.select("node", "k")
        if done:
            break
    return long_names(state.select("node", F.col("k").alias("core")), names, "node")


def bridge_fraction(edges: DataFrame, bridge_edges: DataFrame) -> DataFrame:
    """Share of each node's edges that are bridges."""
    flagged = edges.select("src", "dst").join(bridge_edges.withColumn("b", F.lit(1)), ["src", "dst"], "left").fillna(0, ["b"])
    ends = flagged.select(F.explode(F.array("src", "dst")).alias("node"), "b")
    return ends.groupBy("node").agg((F.sum("b") / F.count("*")).alias("bridge_fraction"))


def label_communities(edges: DataFrame, rounds: int) -> DataFrame:
    """Communities by weighted label propagation.

    Every round one half of the nodes (by hash) takes the label with the
    largest summed weight among its neighbours, its own label counting one;
    ties go to the larger label.  Halves avoid the oscillation of a fully
    synchronous update.  ``rounds`` is part of the definition: labels may go on
    changing, and the result is the labels after that many rounds.  Deterministic, but not the partition a modularity
    optimiser would give.
    """
    links = cells.grid(edges)
    half = F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 4), 16, 10).cast("int") % 2
    # numbers are in the order of the names, so their ties are the names' ties
    state = links.nodes.select("no", F.col("no").alias("label"), half.cast("double").alias("half"))
    for i in range(rounds):

        def heaviest(no, own, half, row, label, w, turn: int = i % 2):
            mine = label == own[row]
            lonely = np.setdiff1d(np.arange(len(no)), row[mine], assume_unique=True)
            row, label, w = (np.concatenate(c) for c in ((row, lonely), (label, own[lonely]), (w + mine, np.ones(len(lonely)))))
            most, to = np.zeros(len(no)), np.zeros(len(no), np.int64)
            np.maximum.at(most, row, w)
            top = w == most[row]
            np.maximum.at(to, row[top], label[top])
            return {"no": no, "label": np.where(half == turn, to, own), "half": half}

        state = written(cells.choices(links, state, [], ["half"], heaviest, "no long, label long, half double"))
    names = links.nodes.select(F.col("no").alias("label"), F.col("node").alias("_name"))
    return state.join(links.nodes, "no").join(names, "label").select("node", F.col("_name").alias("label"))
