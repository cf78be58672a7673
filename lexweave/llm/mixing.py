"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share ``share`` times all words by their weights, no source
above ``most`` times its own words.  The level at which capped sources stop
follows from running sums over the sources in order of cap / weight.

Schedule: the mix is a row of slots of ``block`` words.  Slot k has the
golden-ratio point (k * g mod K) / K, where g is the integer nearest to K / phi
that has no factor in common with K; so the points are evenly spread in any run
of slots, and each of the K places is met once.  Cumulative block counts of the
sources map a point to its source, which therefore gets exactly its number of
slots.  Slots are ranked inside their source, and the r-th slot takes the r-th
block of the source's words: its documents in a shuffled order (md5), laid end
to end, as often as the target needs them, in a new order each time.

Hot sources: slots are ranked, and words summed up, by range-partitioned scans,
never in one task per source.

A null text has no words; words are runs without white space.  A null source is
a source of its own, the last one.  Equal rows are separate documents.  A source
without words has target 0.  The order depends on ids and texts alone, so reruns
agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import next_at_or_above, ordered_scan, row_numbers
from ..session import scratch_path

WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK = 1.5, 2, 256
WORDS = r"[^\x20\x09-\x0D]+"
LOOKUP = 1 << 16  # sources that a task looks up in an array; more are found by a scan


class Mix(NamedTuple):
    """docs (rid, doc_id, source, size), sources (source, no, source_size, target,
    words), schedule (slot, place, rid, doc_id, pass, first, last): words
    first .. last-1 of a document stand at word ``place`` of the slot."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, no, weight, source_size, target) of (source, size) rows."""
    sums = row_numbers(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [], [F.asc_nulls_last("source")], "no")
    turn = ((F.col("no") - 1) % len(weights)).cast("int") + 1
    table = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("cap", most * F.col("source_size"))
    by_ratio = ordered_scan(table.withColumn("ratio", F.col("cap") / F.col("weight")), [], ["ratio", "no"], {"_caps": ("sum", "cap"), "_weights": ("sum", "weight")})
    all_words, all_weights = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # the level of the first source, in this order, that it does not lift above its cap
    level = (F.lit(float(share * all_words)) - (F.col("_caps") - F.col("cap"))) / (F.lit(float(all_weights)) - (F.col("_weights") - F.col("weight")))
    fits = by_ratio.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "no"))).first()[0]
    target = F.col("cap").cast("double") if fits is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(fits)))
    return table.select("source", "no", "weight", "source_size", target.alias("target"))


def golden_step(n: int) -> int:
    """The integer nearest to n / phi without a common factor with n."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    return next(g for d in range(n + 1) for g in (near + d, near - d) if g > 0 and math.gcd(g, n) == 1)


def points(spark, n: int) -> DataFrame:
    """(slot, at): the integer points slot * g mod n of n slots."""
    g = golden_step(n) if n else 1
    kind = "bigint" if n < 1 << 31 else "decimal(19,0)"  # a longer product than 64 bits
    return spark.range(n).select(F.col("id").alias("slot"), F.expr(f"cast(cast(id as {kind}) * cast({g} as {kind}) % cast({max(n, 1)} as {kind}) as bigint)").alias("at"))


def _to_source(slots: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Adds the number of the source whose span of points holds ``at``."""
    if count > LOOKUP:
        ends = sources.select((F.col("_blocks") - 1).alias("_last"), "no")
        return next_at_or_above(slots, "at", ends, "_last", [], "_hit").join(ends, F.col("_hit") == F.col("_last")).select("slot", "no")
    rows = sources.select("_blocks", "no").orderBy("no").toArrow()
    ends, numbers = rows.column("_blocks").to_numpy(), rows.column("no").to_numpy()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = numbers[np.searchsorted(ends, batch.column("at").to_numpy(), "right")]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(hit, pa.int64())], names=["slot", "no"])

    return slots.mapInArrow(find, "slot long, no long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: str = "mix",
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Mix:
    """Runs jobs while it is called (sizes and targets)."""
    spark = docs.sparkSession
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    at = scratch_path(spark, "sized")
    docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(words, F.lit(WORDS)).cast("long").alias("size"),
        F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(words)).alias("key")).write.parquet(at)
    sized = spark.read.parquet(at)
    limit = F.floor(F.col("target") + 0.5).cast("long")
    planned = targets(sized.select("source", "size"), weights, share, most).withColumn("words", limit).withColumn("_need", F.ceil(F.col("words") / block).cast("long"))
    at = scratch_path(spark, "sources")
    ordered_scan(planned, [], ["no"], {"_blocks": ("sum", "_need")}).write.parquet(at)
    sources = spark.read.parquet(at)
    count, slots = sources.agg(F.count("*"), F.coalesce(F.max("_blocks"), F.lit(0))).first()

    named = _to_source(points(spark, slots), sources, count)
    ranked = row_numbers(named, ["no"], ["slot"], "_rank").select("no", "slot", (F.col("_rank") - 1).alias("_block"))

    used = sources.where("words > 0").select(F.col("source").alias("_source"), "no", "source_size", "words")
    laid = sized.where("size > 0").join(used, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = laid.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / F.col("source_size")).cast("long") - 1)))
    laid = laid.withColumn("key", F.md5(F.concat_ws("|", F.col("pass").cast("string"), "key")))
    laid = ordered_scan(laid, ["no", "pass"], ["key", "rid"], {"_after": ("sum", "size")})
    start = F.col("pass") * F.col("source_size") + F.col("_after") - F.col("size")
    laid = laid.withColumn("_start", start).where("_start < words").withColumn("_stop", F.least(F.col("_start") + F.col("size"), F.col("words")))
    pieces = laid.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_stop") - 1) / block))))
    low, high = F.greatest("_start", F.col("_block") * block), F.least("_stop", (F.col("_block") + 1) * block)
    pieces = pieces.select("no", "_block", (low - F.col("_block") * block).alias("place"), "rid", "doc_id", "pass", (low - F.col("_start")).alias("first"), (high - F.col("_start")).alias("last"))
    schedule = pieces.join(ranked, ["no", "_block"]).select("slot", "place", "rid", "doc_id", "pass", "first", "last")
    return Mix(sized.select("rid", "doc_id", "source", "size"), sources.select("source", "no", "source_size", "target", "words"), schedule)


def taken(made: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row for every document."""
    used = made.schedule.groupBy("rid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    rows = made.docs.join(used, "rid", "left").withColumnRenamed("source", "_own")
    return rows.join(made.sources, F.col("_own").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
