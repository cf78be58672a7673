"""Graph construction and measures that need no iteration.

A graph is an edge table (src, dst, weight) with src < dst and one row per
unordered pair.  Self loops are dropped when it is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import written
from .pairs import pairs_within
from .scan import ordered_scan, quantiles, top_per_group


def cooccurrence(mentions: DataFrame, context: str, node: str, multiplicity: bool = False, ranged: bool = False) -> DataFrame:
    """Edges between nodes that share a context; ``ranged`` by src, for consumers
    that pack neighbouring edges.

    With ``multiplicity`` every pair of mentions counts, so two mentions of one
    node count twice; otherwise a context counts once per pair.  Mentions are
    collapsed to (context, node, count) before any pair is formed.
    """
    members = mentions.groupBy(F.col(context).alias("ctx"), F.col(node).alias("node")).agg(F.count("*").alias("m"))
    pairs = pairs_within(members, ["ctx"], "node", ["m"])
    if ranged:
        pairs = pairs.select("node_a", "node_b", *(["m_a", "m_b"] if multiplicity else [])).repartitionByRange("node_a")
    weight = F.sum(F.col("m_a") * F.col("m_b")) if multiplicity else F.count("*")
    return pairs.groupBy(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).agg(weight.alias("weight"))


def simple_graph(edges: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Typed multi-edges (src, dst, relation) to weighted undirected edges."""
    rel = F.coalesce("relation", F.lit(""))
    keep = edges.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
    if exclude:
        keep = keep.where(~rel.isin(*exclude))
    return keep.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.count("*").alias("weight"), F.array_sort(F.collect_set("relation")).alias("relations"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge once from either end: (node, nbr, weight)."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("weight").alias("weight")),
                F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("weight").alias("weight")),
            )
        )
    )


def nodes_of(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Endpoints, plus nodes to keep although isolated."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends.union(extra.select("node")) if extra is not None else ends).distinct()


def short_names(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges between numbers instead of names, for rounds that shuffle both ends
    again and again, and (node, no); edges without string names stay, with None."""
    if not isinstance(edges.schema["src"].dataType, StringType):
        return edges, None
    names = written(nodes_of(edges).withColumn("no", F.monotonically_increasing_id()))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    at = [names.select(F.col("node").alias(c), F.col("no").alias(f"_{c}")) for c in ("src", "dst")]
    short = edges.join(at[0], "src").join(at[1], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)
    return written(short), names


def long_names(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """Rows with numbers in ``columns`` turned into names again."""
    for c in columns if names is not None else ():
        back = names.select(F.col("no").alias(c), F.col("node").alias("_name"))
        rows = rows.join(back, c).select(*[F.col("_name").alias(c) if x == c else F.col(x) for x in rows.columns])
    return rows


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """degree, strength and degree centrality per node."""
    d = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    if nodes is not None:
        d = nodes.join(d, "node", "left").fillna(0, ["degree", "strength"])
        n = nodes.agg(F.count("*")).scalar()
    else:
        n = d.agg(F.count("*")).scalar()
    return d.withColumn("degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(0.0))


def siblings(places: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, nbr) for places of one parent, in both directions."""
    p = pairs_within(places.where(F.col(parent).isNotNull()).select(parent, F.col(node).alias("node")), [parent], "node")
    return p.select(F.inline(F.array(
        F.struct(F.col("node_a").alias("node"), F.col("node_b").alias("nbr")),
        F.struct(F.col("node_b").alias("node"), F.col("node_a").alias("nbr")))))


def parent_edges(places: DataFrame, node: str, parent: str, relation: str = "somewhere_in_or_near") -> DataFrame:
    """A typed edge from each place to a parent that is itself a place."""
    known = places.select(F.col(node).alias(parent))
    return places.where(F.col(parent) != F.col(node)).join(known, parent, "left_semi").select(
        F.col(node).alias("src"), F.col(parent).alias("dst"), F.lit(relation).alias("relation"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, degree, no) numbered from 1 by degree, and edges (low, high,
    weight) of these numbers, low < high."""
    deg = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree")).withColumn("_one", F.lit(1).cast("long"))
    nodes = written(ordered_scan(deg, [], ["degree", "node"], {"no": ("sum", "_one")}).select("node", "degree", "no"))
    kind = "int" if nodes.count() < 2**31 else "long"
    nodes = nodes.withColumn("no", F.col("no").cast(kind))
    ends = edges.select("src", "dst", "weight").join(nodes.select(F.col("node").alias("src"), F.col("no").alias("_s")), "src").join(
        nodes.select(F.col("node").alias("dst"), F.col("no").alias("_d")), "dst")
    return nodes, written(ends.select(F.least("_s", "_d").alias("low"), F.greatest("_s", "_d").alias("high"), "weight"))


def triangles(links: DataFrame) -> DataFrame:
    """Every triangle a < b < c of numbered edges once, with its three weights.

    Edges point from the endpoint of lower degree to the higher one, which
    bounds the number of a node's higher neighbours by the square root of twice
    the edge count.  No wedge is a row: a node sends the list of its higher
    neighbours along each edge, cut to those above the edge's end, and the end
    keeps those that it has too.  Weights are looked up for triangles only.
    """
    up = links.groupBy("low").agg(F.array_sort(F.collect_list("high")).alias("_up"))
    sent = up.select(F.col("low").alias("a"), "_up", F.posexplode("_up").alias("_i", "b")).where(F.col("_i") + 1 < F.size("_up"))
    sent = sent.select("a", "b", F.slice("_up", F.col("_i") + 2, F.size("_up")).alias("_rest"))
    both = sent.join(up.select(F.col("low").alias("b"), "_up"), "b").select("a", "b", F.array_intersect("_rest", "_up").alias("_both"))
    found = both.where(F.size("_both") > 0).select("a", "b", F.explode("_both").alias("c"))
    for x, y in ("ab", "ac", "bc"):
        found = found.join(links.select(F.col("low").alias(x), F.col("high").alias(y), F.col("weight").alias(f"w_{x}{y}")), [x, y])
    return found.select("a", "b", "c", "w_ab", "w_ac", "w_bc")


def clustering(edges: DataFrame) -> DataFrame:
    """Triangles, unweighted and weighted clustering per node.

    The weighted form averages the geometric mean of the three weights, each
    divided by the largest weight in the graph.
    """
    top = edges.agg(F.max("weight").cast("double")).scalar()
    nodes, links = numbered(edges)
    mean = F.cbrt(F.col("w_ab") / top * F.col("w_ac") / top * F.col("w_bc") / top)
    per = triangles(links).select(F.explode(F.array("a", "b", "c")).alias("no"), mean.alias("g")).groupBy("no").agg(
        F.count("*").alias("triangles"), F.sum("g").alias("_g"))
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return nodes.join(per, "no", "left").select(
        "node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.when(possible > 0, F.coalesce("triangles", F.lit(0)) / possible).otherwise(0.0).alias("clustering"),
        F.when(possible > 0, F.coalesce("_g", F.lit(0.0)) / possible).otherwise(0.0).alias("weighted_clustering"))


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends' community (ls, ld)."""
    return edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(
        labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of a partition."""
    e = labelled_edges(edges, labels)
    m = edges.agg(F.sum("weight")).scalar()
    per = e.select(F.inline(F.array(
        F.struct(F.col("ls").alias("label"), F.col("weight").alias("k"), F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0).alias("inside")),
        F.struct(F.col("ld").alias("label"), F.col("weight").alias("k"), F.lit(0).cast("long").alias("inside")))))
    c = per.groupBy("label").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
    return c.agg(F.sum(F.col("inside") / m - F.pow(F.col("k") / (2.0 * m), F.lit(2))).alias("modularity"))


def community_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, internal edges and internal weight per community."""
    inside = labelled_edges(edges, labels).where("ls = ld").groupBy(F.col("ls").alias("label")).agg(
        F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return labels.groupBy("label").agg(F.count("*").alias("size")).join(inside, "label", "left").fillna(0, ["edges", "weight"])


def community_members(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Top members per community by strength, degree, then name."""
    d = degrees(edges).join(labels, "node")
    return top_per_group(d, ["label"], [F.desc("strength"), F.desc("degree"), F.desc("node")], k).select("label", "rn", "node", "strength", "degree")


def cross_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge weight between different communities."""
    e = labelled_edges(edges, labels).where("ls <> ld")
    return e.groupBy(F.least("ls", "ld").alias("a"), F.greatest("ls", "ld").alias("b")).agg(F.sum("weight").alias("weight"))


def cartography(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Within-module degree z-score and participation coefficient, both on
    unweighted neighbours."""
    per = both_ways(edges).join(labels.select(F.col("node").alias("nbr"), F.col("label").alias("nl")), "nbr").groupBy("node", "nl").agg(F.count("*").alias("k"))
    own = per.join(labels, "node")
    node = own.groupBy("node", "label").agg(
        F.sum("k").alias("degree"), F.coalesce(F.sum(F.when(F.col("nl") == F.col("label"), F.col("k"))), F.lit(0)).alias("within"),
        F.sum(F.col("k").cast("double") * F.col("k")).alias("_sq"))
    node = labels.join(node, ["node", "label"], "left").fillna(0, ["degree", "within", "_sq"])
    module = node.groupBy("label").agg(F.avg("within").alias("_m"), F.stddev_pop("within").alias("_s"))
    return node.join(module, "label").select(
        "node", "label",
        F.when(F.col("_s") > 0, (F.col("within") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("within_z"),
        F.when(F.col("degree") > 0, 1 - F.col("_sq") / F.pow("degree", F.lit(2))).otherwise(0.0).alias("participation"))


def hubs(measures: DataFrame, columns: Sequence[str], quantile: float) -> DataFrame:
    """Nodes at or above the floor-index quantile on any of the measures."""
    cond: Column = F.lit(False)
    for c in columns:
        threshold = quantiles(measures, [], c, {"t": quantile}, floor_index=True).select("t").scalar()
        cond = cond | (F.col(c) >= threshold)
    return measures.where(cond).select("node")


def ego(edges: DataFrame, centre, k: int) -> tuple[DataFrame, DataFrame]:
    """The centre's k strongest neighbours and the links among all of them."""
    nbrs = both_ways(edges).where(F.col("node") == centre).orderBy(F.desc("weight"), F.asc("nbr")).limit(k)
    members = nbrs.select("nbr").union(nbrs.select("node")).distinct()
    links = edges.join(members.withColumnRenamed("nbr", "src"), "src", "left_semi").join(
        members.withColumnRenamed("nbr", "dst"), "dst", "left_semi")
    return nbrs, links


def class_contexts(mentions: DataFrame, node: str, context: str, cls: str, values: Sequence[str]) -> DataFrame:
    """Contexts per node and class, and the dominant class of the first two."""
    distinct = mentions.select(F.col(node).alias("node"), context, cls).distinct()
    a, b = values[0], values[1]
    c = distinct.groupBy("node").agg(*[F.count_if(F.col(cls) == v).alias(v) for v in values])
    return c.withColumn("dominant", F.when(F.col(a) > F.col(b), a).when(F.col(b) > F.col(a), b).otherwise("balanced"))


def bridge_scores(betweenness: DataFrame, classes: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes of both classes by betweenness × (1 + ln(1 + n)) × balance."""
    n = F.col(a) + F.col(b)
    score = F.col("betweenness") * (1 + F.log1p(n)) * (2.0 * F.least(a, b) / n)
    return betweenness.join(classes.where((F.col(a) > 0) & (F.col(b) > 0)), "node").withColumn("bridge_score", score)


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node and edge counts, density and total weight."""
    n = nodes.agg(F.count("*")).scalar()
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"))
    return e.select(
        n.alias("nodes"), "edges", F.when(n > 1, 2.0 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "total_weight")
