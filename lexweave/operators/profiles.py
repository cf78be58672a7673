"""Sparse count profiles of nodes: entropy, cosine and Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy(profile: DataFrame, node: str, n: str) -> DataFrame:
    """Shannon entropy (bits): log2 N - sum n log2 n / N, one aggregate."""
    c = F.col(n).cast("double")
    total = F.sum(c)
    h = F.log2(total) - F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / total
    return profile.groupBy(node).agg(F.when(total > 0, F.greatest(F.lit(0.0), h)).otherwise(0.0).alias("entropy"))


def norms(profile: DataFrame, node: str, n: str) -> DataFrame:
    return profile.groupBy(node).agg(F.sqrt(F.sum(F.col(n).cast("double") * F.col(n))).alias("norm"))


def cosine_to_reference(profile: DataFrame, reference: DataFrame, node: str, item: str, n: str) -> DataFrame:
    """Cosine of each node's profile with one reference profile."""
    ref = reference.select(item, F.col(n).cast("double").alias("_ref"))
    length = ref.agg(F.sqrt(F.sum(F.col("_ref") * F.col("_ref")))).scalar()
    c = F.col(n).cast("double")
    dot = profile.join(ref, item, "left").groupBy(node).agg(
        F.sum(c * F.coalesce("_ref", F.lit(0.0))).alias("_dot"), F.sqrt(F.sum(c * c)).alias("_norm"))
    den = F.col("_norm") * length
    return dot.select(node, F.when(den > 0, F.col("_dot") / den).otherwise(0.0).alias("cosine"))


def cosine_pairs(profile: DataFrame, pairs: DataFrame, item: str, n: str) -> DataFrame:
    """Cosine of the profiles (node, item, n) of given pairs (a, b); empty profiles give 0."""
    p = profile.select("node", item, F.col(n).cast("double").alias("c"))
    dots = (
        pairs.join(p.select(F.col("node").alias("a"), item, F.col("c").alias("_x")), "a")
        .join(p.select(F.col("node").alias("b"), item, F.col("c").alias("_y")), ["b", item])
        .groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    )
    lens = norms(p, "node", "c")
    return (
        pairs.join(dots, ["a", "b"], "left")
        .join(lens.select(F.col("node").alias("a"), F.col("norm").alias("_na")), "a", "left")
        .join(lens.select(F.col("node").alias("b"), F.col("norm").alias("_nb")), "b", "left")
        .select("a", "b", F.coalesce(F.col("_dot") / (F.col("_na") * F.col("_nb")), F.lit(0.0)).alias("cosine"))
    )


def jaccard(members: DataFrame, pairs: DataFrame, empty: float = 0.0) -> DataFrame:
    """Jaccard of the item sets (node, item) of given pairs (a, b).  The union
    comes from the set sizes; pairs of unknown nodes drop out."""
    sizes = members.groupBy("node").agg(F.count("*").alias("s"))
    shared = (
        pairs.join(members.select(F.col("node").alias("a"), "item"), "a")
        .join(members.select(F.col("node").alias("b"), "item"), ["b", "item"])
        .groupBy("a", "b").agg(F.count("*").alias("shared"))
    )
    k = F.coalesce("shared", F.lit(0))
    union = F.col("sa") + F.col("sb") - k
    return (
        pairs.join(sizes.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        .join(shared, ["a", "b"], "left")
        .select("a", "b", k.alias("shared"), F.when(union > 0, k / union).otherwise(F.lit(empty)).alias("jaccard"))
    )
