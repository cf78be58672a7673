"""Pairs of items that share a context, with hot contexts split into blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2000


def spread_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by ``keys`` into as many partitions as a shuffle has.  Left to
    the adaptive planner, small rows whose join grows with the square of a group
    would be merged into few tasks, as it only sees their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs_within(
    df: DataFrame,
    context: Sequence[str],
    item: str,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every unordered pair ``item_a < item_b`` of rows sharing ``context``.

    The pairs are the result, so their number cannot shrink; their production
    is spread out instead.  A context of n rows is hashed into
    B = ceil(n / block_rows) blocks and joined cell by cell on
    (context, low block, high block): B(B+1)/2 independent join keys of bounded
    size, so one huge context fans out over the cluster.
    """
    context = list(context)
    # contexts of one row have no pairs and go before the rows are dealt
    sizes = df.groupBy(*context).agg(F.count("*").alias("_n")).where("_n > 1").select(
        *context, F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("int").alias("_blocks")
    )
    tagged = df.select(*context, item, *carry).join(sizes, context)
    tagged = tagged.withColumn("_b", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    cells = tagged.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *context,
        F.least("_b", "_o").alias("_lo"),
        F.greatest("_b", "_o").alias("_hi"),
        "_b",
        item,
        *carry,
    )
    keys = [*context, "_lo", "_hi"]
    cells = spread_out(cells, keys)
    left = cells.select(*keys, F.col("_b").alias("_ba"), *[F.col(c).alias(f"{c}_a") for c in (item, *carry)])
    right = cells.select(*keys, F.col("_b").alias("_bb"), *[F.col(c).alias(f"{c}_b") for c in (item, *carry)])
    return (
        left.join(right, keys)
        .where(F.col(f"{item}_a") < F.col(f"{item}_b"))
        .where((F.col("_lo") == F.col("_hi")) | (F.col("_ba") != F.col("_bb")))
        .drop("_lo", "_hi", "_ba", "_bb")
    )


def pairs_between(
    left: DataFrame,
    right: DataFrame,
    context: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Left rows paired with right rows of the same context, in blocks.

    The right side is hashed into blocks of bounded size and the left side is
    repeated once per block of its context.
    """
    context = list(context)
    sizes = right.groupBy(*context).agg(
        F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("_blocks")
    )
    payload = [c for c in right.columns if c not in context]
    r = right.join(sizes, context).withColumn(
        "_cell", F.pmod(F.xxhash64(*payload), F.col("_blocks")).cast("int")
    ).drop("_blocks")
    lft = left.join(sizes, context).withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).drop("_blocks")
    keys = [*context, "_cell"]
    return spread_out(lft, keys).join(spread_out(r, keys), keys).drop("_cell")
