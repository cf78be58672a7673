"""Sentence-aligned chunks and rolling windows over reading order.

Input rows are sentences: (stream, order columns, ``tokens`` > 0).  A stream
may hold any share of the corpus, so every step works on ranges of a stream,
never on a whole stream.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scan import next_at_or_above, ordered_scan, row_numbers


def running_tokens(
    sentences: DataFrame, stream: str, order: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running token count ``cum``, sentence number ``idx`` and one
    running sum ``cum_<c>`` per extra column, cut and kept with range numbers."""
    one = sentences.withColumn("_one", F.lit(1).cast("long"))
    running = {"cum": ("sum", "tokens"), "idx": ("sum", "_one"), **{f"cum_{c}": ("sum", c) for c in extra}}
    return cut(ordered_scan(one, [stream], order, running, keep_range=True).drop("_one"))


def _walk(cums: np.ndarray, start: int, size: int) -> list[int]:
    """Cut positions after ``start`` inside one range."""
    cuts, at = [], start
    while True:
        i = int(np.searchsorted(cums, at + size, "left"))
        if i == len(cums):
            return cuts
        at = int(cums[i])
        cuts.append(at)


def greedy_chunks(
    sentences: DataFrame, stream: str, order: Sequence[str], size: int, extra: Sequence[str] = ()
) -> DataFrame:
    """Close a chunk as soon as it holds ``size`` tokens; merge a final fragment
    shorter than half a chunk into the chunk before it.

    Adds ``chunk_start``, the number of tokens of the stream before the chunk.

    The greedy rule is sequential, but where a range of sentences leaves off
    depends on the past only through the last cut, and that cut lies less than
    ``size`` tokens before the range.  So every range works out, in parallel,
    where each possible entering cut would leave it; chaining those small
    tables gives the true entering cut of every range, and a second parallel
    pass assigns the chunks.
    """
    scanned = running_tokens(sentences, stream, order, extra)
    keys = [stream, "_range"]
    ranges = scanned.groupBy(*keys).agg(
        F.min(F.col("cum") - F.col("tokens")).alias("start"), F.max("cum").alias("stop"))
    slot = lambda c: F.floor(c / F.lit(size)).cast("long")
    spots = scanned.select(stream, F.col("cum").alias("enter"), slot(F.col("cum")).alias("slot"))
    near = ranges.select(*keys, "start", F.explode(F.array(slot(F.col("start")) - 1, slot(F.col("start")))).alias("slot"))
    entering = (
        near.join(spots, [stream, "slot"])
        .where((F.col("enter") <= F.col("start")) & (F.col("enter") > F.col("start") - size))
        .select(*keys, "enter")
        .unionByName(ranges.where(F.col("start") < size).select(*keys, F.lit(0).cast("long").alias("enter")))
    )
    stream_type = sentences.schema[stream].dataType.simpleString()
    cums = scanned.select(*keys, F.col("cum").alias("v"), F.lit(True).alias("is_row"))

    def with_rows(enters: DataFrame) -> DataFrame:
        return cums.unionByName(enters.select(*keys, F.col("enter").alias("v"), F.lit(False).alias("is_row")))

    def transfer(part: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(part.loc[part["is_row"], "v"].to_numpy())
        out = part.loc[~part["is_row"], [*keys, "v"]].rename(columns={"v": "enter"})
        out["leave"] = [(_walk(at, e, size) or [e])[-1] for e in out["enter"]]
        return out

    table = with_rows(entering).groupBy(*keys).applyInPandas(
        transfer, f"{stream} {stream_type}, _range int, enter long, leave long")

    def chain(t: pd.DataFrame) -> pd.DataFrame:
        # at most (ranges of the stream) x (cuts within one chunk) rows
        at, out = 0, []
        for number, part in t.groupby("_range", sort=True):
            out.append((t[stream].iloc[0], number, at))
            at = int(part.loc[part["enter"] == at, "leave"].iloc[0])
        return pd.DataFrame(out, columns=[*keys, "enter"])

    true_enter = table.groupBy(stream).applyInPandas(chain, f"{stream} {stream_type}, _range int, enter long")

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        enter = int(part.loc[~part["is_row"], "v"].iloc[0])
        out = part.loc[part["is_row"], [*keys, "v"]].rename(columns={"v": "cum"})
        at = out["cum"].to_numpy()
        bounds = np.array([enter, *_walk(np.sort(at), enter, size)])
        out["chunk_start"] = bounds[np.searchsorted(bounds, at, "left") - 1]
        return out

    placed = with_rows(true_enter).groupBy(*keys).applyInPandas(
        assign, f"{stream} {stream_type}, _range int, cum long, chunk_start long")
    starts = cut(placed)
    ends = starts.groupBy(stream, "chunk_start").agg(F.max("cum").alias("end"))
    last = ends.groupBy(stream).agg(F.max(F.struct("chunk_start", "end")).alias("l"))
    before = (
        ends.join(last, stream).where(F.col("chunk_start") < F.col("l.chunk_start"))
        .groupBy(stream).agg(F.max("chunk_start").alias("prev"))
    )
    fragment = last.join(before, stream).where(
        F.col("l.end") - F.col("l.chunk_start") < F.lit(size // 2)
    ).select(stream, F.col("l.chunk_start").alias("chunk_start"), "prev")
    merged = starts.join(fragment, [stream, "chunk_start"], "left").select(
        *keys, "cum", F.coalesce("prev", "chunk_start").alias("chunk_start"))
    return scanned.join(merged, [*keys, "cum"]).drop("_range")


def chunk_inventory(chunks: DataFrame, stream: str, unit: str, flags: dict[str, Column], span: str) -> DataFrame:
    """One row per chunk: index, first and last unit, sizes, share of tokens in
    a span, boundary flag and any-sentence flags."""
    inside = F.when(F.col(span), F.col("tokens")).otherwise(0)
    inv = chunks.groupBy(stream, "chunk_start").agg(
        F.min_by(unit, "cum").alias("first_unit"),
        F.max_by(unit, "cum").alias("last_unit"),
        F.sum("tokens").alias("token_count"),
        F.count("*").alias("sentence_count"),
        (F.sum(inside) / F.sum("tokens")).alias("overlap"),
        *[F.bool_or(c).alias(name) for name, c in flags.items()],
    )
    inv = inv.withColumn("boundary", (F.col("overlap") > 0) & (F.col("overlap") < 1))
    return row_numbers(inv, [stream], ["chunk_start"], "_n").withColumn("chunk_index", (F.col("_n") - 1).cast("int")).drop("_n")


def rolling_windows(
    sentences: DataFrame, stream: str, order: Sequence[str], size: int, step: int
) -> DataFrame:
    """Windows of at least ``size`` tokens starting about every ``step`` tokens.

    A start moves at most one step per sentence, so the k-th start is
    k + max over j <= k of (f_j - j), f_j being the first sentence with at
    least j*step tokens before it: a running maximum, not a loop.  A window ends
    at the next running count at or above its start plus ``size``; windows the
    tail cannot fill are dropped.  All attributes follow from running sums.
    """
    rows = running_tokens(sentences, stream, order)
    before = F.col("cum") - F.col("tokens")
    # sentence idx is the f_j for every multiple of step in (previous, current] running count
    due = rows.select(
        stream, (F.col("idx") + 1).alias("f"),
        F.explode(F.when(F.floor(F.col("cum") / step) > F.floor(before / step),
                         F.sequence(F.floor(before / step) + 1, F.floor(F.col("cum") / step)))).alias("j"))
    first = rows.where("idx = 1").select(stream, F.col("idx").alias("f"), F.lit(0).cast("long").alias("j"))
    due = first.unionByName(due).withColumn("_lag", F.col("f") - F.col("j"))
    starts = ordered_scan(due, [stream], ["j"], {"_max": ("max", "_lag")}).select(
        stream, (F.col("j") + F.col("_max")).alias("idx"))
    opened = rows.join(starts, [stream, "idx"]).select(
        stream, F.col("idx").alias("start_idx"), before.alias("start"), (before + size).alias("target"))
    closed = next_at_or_above(opened, "target", rows, "cum", [stream], "end").where(F.col("end").isNotNull())
    ends = rows.select(stream, F.col("cum").alias("end"), F.col("idx").alias("end_idx"))
    return closed.join(ends, [stream, "end"]).select(
        stream, "start_idx", "end_idx", (F.col("end") - F.col("start")).alias("token_count"),
        (F.col("end_idx") - F.col("start_idx") + 1).alias("sentence_count"))
