"""Ordered scans, ranks and quantiles that never gather a group in one task.

A window partitioned by a hot key sends that key's rows to a single task.
These helpers range-partition by (group, order) instead, run the window inside
each range and add the carry of the ranges before it.  The carry table has one
row per (group, range), so it stays small whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.least(left, right) if kind == "min" else F.greatest(left, right)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], plain: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` with null equal to null, and on ``plain`` keys as usual;
    the key columns of the left side stay."""
    both = [*keys, *plain]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in both})
    on = F.lit(True)
    for c in both:
        hit = F.col(c).eqNullSafe(F.col(f"_r_{c}")) if c in keys else F.col(c) == F.col(f"_r_{c}")
        on = on & hit
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in both])


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    running: dict[str, tuple[str, str]],
    partitions: int | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """Add inclusive running aggregates along ``order`` inside each ``group``.

    ``running`` maps an output column to (sum | min | max, input column).
    ``order`` must be a total order within the group; null keys form a group.
    ``keep_range`` keeps the range number as ``_range``.
    """
    # Without a fixed number the adaptive planner merges small neighbouring
    # ranges, which keeps their order.
    parts = [partitions] if partitions else []
    group = list(group)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(
        df.repartitionByRange(*parts, *[F.col(g) for g in group], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*group, "_range").agg(
        *[_MERGE[kind](col).alias(f"_t_{out}") for out, (kind, col) in running.items()]
    )
    before = (
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *group,
        "_range",
        *[
            _MERGE[kind](f"_t_{out}").over(before).alias(f"_c_{out}")
            for out, (kind, _) in running.items()
        ],
    )
    inside = (
        Window.partitionBy(*group, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = join_null_safe(ranged, carry, group, ["_range"])
    out = joined.select(
        *df.columns,
        *(["_range"] if keep_range else []),
        *[
            _combine(kind, F.col(f"_c_{out}"), _MERGE[kind](col).over(inside)).alias(out)
            for out, (kind, col) in running.items()
        ],
    )
    return out


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str = "rn"
) -> DataFrame:
    """``row_number`` over a total order, safe for hot groups."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return ordered_scan(one, group, order, {out: ("sum", "_one")}).drop("_one")


def value_histogram(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value) counts with the 0-based rank span [lo, hi) each value covers."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    )
    return ordered_scan(counts, group, [value], {"hi": ("sum", "n")}).withColumn(
        "lo", F.col("hi") - F.col("n")
    )


def average_ranks(df: DataFrame, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average ranks with ties, computed on distinct values and joined back;
    a null value has no rank."""
    spans = value_histogram(df, group, value).select(
        *group, value, ((F.col("lo") + 1 + F.col("hi")) / 2).alias(out)
    )
    return join_null_safe(df, spans, group, [value], "left")


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], floor_index: bool = False
) -> DataFrame:
    """Exact quantiles per group from the value histogram.

    Linear interpolation by default; ``floor_index`` takes
    ``sorted[floor((n-1)*q)]`` instead, with no interpolation.
    """
    group = list(group)
    spans = value_histogram(df, group, value)
    size = spans.groupBy(*group).agg(F.sum("n").alias("_size"))
    spans = join_null_safe(spans, size, group) if group else spans.withColumn(
        "_size", size.select("_size").scalar()
    )

    def at(index: Column) -> Column:
        hit = (F.col("lo") <= index) & (index < F.col("hi"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks = []
    for out, q in probs.items():
        pos = (F.col("_size") - 1) * F.lit(float(q))
        picks += [
            at(F.floor(pos)).alias(f"_f_{out}"),
            at(F.ceil(pos)).alias(f"_e_{out}"),
            F.max(pos - F.floor(pos)).alias(f"_w_{out}"),
        ]
    picked = spans.groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *[
            (
                F.col(f"_f_{out}")
                if floor_index
                else F.col(f"_f_{out}")
                + F.col(f"_w_{out}") * (F.col(f"_e_{out}") - F.col(f"_f_{out}"))
            ).alias(out)
            for out in probs
        ],
    )


def md5_key(*cols: Column | str, sep: str = "|", seed: str = "") -> Column:
    """Deterministic pseudo-random sort key of a row."""
    return F.md5(F.concat_ws(sep, F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn"
) -> DataFrame:
    """First k rows per group.

    The filter on ``row_number`` lets Spark keep at most k rows per group in
    every map task before the shuffle, so a hot group never travels whole.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def next_at_or_above(
    targets: DataFrame, target: str, points: DataFrame, point: str, group: Sequence[str], out: str
) -> DataFrame:
    """For every target the smallest point >= target in its group (null if none).

    One descending scan over targets and points together, so it needs neither a
    range join nor one task per group.
    """
    group = list(group)
    t = targets.select(*group, F.col(target).alias("_v"), F.lit(1).alias("_kind"), F.struct(*targets.columns).alias("_row"),
                       F.lit(None).cast("double").alias("_p")).withColumn("_tie", F.xxhash64("_row"))
    p = points.select(*group, F.col(point).alias("_v"), F.lit(0).alias("_kind"),
                      F.lit(None).cast(t.schema["_row"].dataType).alias("_row"),
                      F.col(point).cast("double").alias("_p"), F.lit(0).cast("long").alias("_tie"))
    both = t.unionByName(p)
    scanned = ordered_scan(both, group, [F.desc("_v"), F.asc("_kind"), F.asc("_tie")], {"_near": ("min", "_p")})
    kind = points.schema[point].dataType
    return scanned.where("_kind = 1").select("_row.*", F.col("_near").cast(kind).alias(out))
