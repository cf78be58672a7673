"""Merging, collapsing and auditing label records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import md5_key


def merge_records(records: DataFrame, policy: str) -> DataFrame:
    """Fold (key, ord, label, preferred) records into one label per key.

    The fold runs in ``ord``: equal labels keep the first record; on a conflict
    ``drop`` removes the key for good, ``prefer`` keeps whichever side comes
    from the preferred source and drops the key when neither does.

    Its outcome depends only on the first record and on the first record whose
    label differs, so two map-side ``min_by`` aggregates replace a fold over
    each key's whole list.
    """
    keep = records.where(F.col("key").isNotNull() & (F.col("key").cast("string") != ""))
    first = keep.groupBy("key").agg(F.min_by(F.struct("label", "preferred"), "ord").alias("a"))
    rival = (
        keep.join(first.select("key", F.col("a.label").alias("_l")), "key")
        .where(F.col("label") != F.col("_l"))
        .groupBy("key")
        .agg(F.min_by(F.struct("label", "preferred"), "ord").alias("b"))
    )
    both = first.join(rival, "key", "left")
    label = (
        F.when(F.col("b").isNull(), F.col("a.label"))
        .when(F.lit(policy == "prefer") & F.col("a.preferred"), F.col("a.label"))
        .when(F.lit(policy == "prefer") & F.col("b.preferred"), F.col("b.label"))
    )
    return both.select("key", label.alias("label"), F.col("b").isNotNull().alias("conflict")).where(
        F.col("label").isNotNull())


def merge_counters(records: DataFrame, policy: str) -> DataFrame:
    merged = merge_records(records, policy)
    total = records.agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))
    kept = merged.agg(F.count("*").alias("n"))
    return total.select(
        "records", kept.scalar().alias("label_keys"), (F.col("keys") - kept.scalar()).alias("conflicts_dropped"))


def collapse(
    df: DataFrame, key: str, label: str, ord_col: str, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """One training row per key; keys with conflicting labels are dropped and a
    key whose rows disagree on a feature stops the job."""
    rest = [c for c in df.columns if c != key]
    spread = [F.struct(F.min(f), F.max(f), F.count(f)).alias(f"_s_{f}") for f in features]
    grouped = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), ord_col).alias("r"),
        F.count("*").alias("group_size"),
        F.min(label).alias("_lo"),
        F.max(label).alias("_hi"),
        *spread,
    )
    bad = F.lit(False)
    for f in features:
        s = F.col(f"_s_{f}")
        bad = bad | (s["col1"] != s["col2"]) | ((s["col3"] > 0) & (s["col3"] < F.col("group_size")))
    checked = grouped.where(F.col("_lo") == F.col("_hi")).withColumn(
        "_ok", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("inconsistent features for "), F.col(key).cast("string")))).otherwise(True))
    kept = checked.where("_ok").select(key, "r.*", "group_size")
    stats = grouped.agg(
        F.sum("group_size").alias("rows_before"),
        F.count("*").alias("keys_before"),
        (F.sum("group_size") - F.count("*")).alias("duplicates_collapsed"),
        F.count_if(F.col("_lo") != F.col("_hi")).alias("conflicting_keys_dropped"),
        F.count_if(F.col("_lo") == F.col("_hi")).alias("rows_after"),
    )
    return kept, stats


def audit(labels: DataFrame, key: str, baseline: str, comparison: str, sample: int, seed: str) -> DataFrame:
    """Two labelers compared on a fixed hash-ordered sample."""
    picked = labels.orderBy(md5_key(F.col(key), seed=seed), key).limit(sample)
    winner = (
        F.when(F.col(baseline) == F.col(comparison), "agree")
        .when(F.col(baseline) > F.col(comparison), "baseline_only")
        .otherwise("comparison_only")
    )
    return picked.groupBy(
        F.col(baseline).alias("baseline"), F.col(comparison).alias("comparison"), winner.alias("winner")
    ).agg(F.count("*").alias("n"))
