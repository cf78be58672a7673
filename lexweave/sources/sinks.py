"""Keyed writes expressed as DataFrame operations, and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""')


def write_graph_json(nodes: DataFrame, links: DataFrame, components: DataFrame, folder: str) -> None:
    """Graph export as three JSON-lines folders; no document is built in one task."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    links.write.mode("overwrite").json(f"{folder}/links")
    components.write.mode("overwrite").json(f"{folder}/components")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last version of every key wins.  A ``max`` of a struct combines map-side,
    so a key with very many versions does not gather in one task."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys and c not in version]
    best = both.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("r"))
    return best.select(*keys, "r.*").select(*both.columns)


def upsert_keep(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Like upsert, but a null in the newer row keeps the older value."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys and c != version]
    return both.groupBy(*keys).agg(
        F.max(version).alias(version),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rest],
    ).select(*both.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh)


def replace_scope(new: DataFrame, path: str, scope: Sequence[str]) -> None:
    """Replace only the scopes present in ``new``; other partitions stay."""
    (
        new.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*scope)
        .parquet(path)
    )


def replace_unreviewed(
    old: DataFrame, new: DataFrame, keys: Sequence[str], reviewed: Column
) -> DataFrame:
    """Replace everything but reviewed rows, which block new rows of their key."""
    kept = old.where(reviewed)
    return kept.unionByName(new.join(kept.select(*keys), list(keys), "left_anti"))


def update_from(old: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPDATE … FROM: matched rows take the new non-null values."""
    cols = [c for c in values.columns if c not in keys]
    v = values.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = old.join(v, list(keys), "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns]
    )


def canonical_entities(sources: Sequence[DataFrame], keys: Sequence[str], rank: str) -> DataFrame:
    """One row per entity from several wide sources: best-ranked source first,
    each attribute from the best source that has it."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != rank]
    return both.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in rest]
    )
