"""Chat formatting in budgeted, turn-aligned windows.

Prefix sums of turn tokens lay a grid of ``budget`` tokens over a conversation:
turns inside one cell share a window, and a turn that crosses a grid line is a
window of its own.  So new turns never exceed the budget unless one single turn
does, and no window depends on the one before it.  Every window starts with the
conversation's system turn, then repeats at most ``history`` tokens of the turns
before it, then holds its new turns.  Loss spans cover the texts of new
assistant turns only; repeated ones are masked.

A turn reads ``### role: text</turn>`` and a line end.  Backslashes in texts are
doubled and a backslash is put before ``### `` and ``</turn>`` (before ``:`` in
roles), so ``read_back`` gets every text exactly.

Null text or role counts as empty.  Turns are ordered by turn (null first),
role, text; equal rows stay separate turns.  Rows without conv_id form one
conversation with a null id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ordered_scan
from ..session import cut

WINDOW_TOKENS = 512
HISTORY_TOKENS = 128
TURN_TOKENS = 4  # what the template adds to a turn
ROLE_OF_LOSS = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("### ", "\\### "), ("</turn>", "\\</turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


def windows(turns: DataFrame, window_tokens: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, n_repeated, text, loss): one row per window, numbered in
    order; the first ``n_repeated`` turns are repeats; loss holds the character
    spans (start, end) to learn from."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    given = turns.select("conv_id", F.col("turn").alias("_turn"), role.alias("role"), text.alias("text"))
    given = given.withColumn("_tokens", (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    order = [F.asc_nulls_first("_turn"), F.asc("role"), F.asc("text")]
    numbered = cut(ordered_scan(given, ["conv_id"], order, {"n": ("sum", "_one"), "_after": ("sum", "_tokens")}))
    is_system = (F.col("n") == 1) & (F.col("role") == "system")
    system = numbered.where(is_system).select("conv_id", F.col("text").alias("_system"), F.col("_tokens").alias("_system_tokens"), F.lit(True).alias("_has"))

    rest = numbered.where(~is_system)
    rest = rest.join(system.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c", "_system")
    lead = F.coalesce("_system_tokens", F.lit(0).cast("long"))
    budget = F.greatest(F.lit(window_tokens - history) - lead, F.lit(window_tokens // 4)).cast("long")
    rest = rest.withColumn("_b", budget).withColumn("_after", F.col("_after") - lead).withColumn("_before", F.col("_after") - F.col("_tokens"))
    cell, last = F.floor(F.col("_before") / F.col("_b")), F.floor((F.col("_after") - 1) / F.col("_b"))
    rest = rest.withColumn("window", 2 * cell + F.when(cell == last, 0).otherwise(1))

    starts = rest.groupBy("conv_id", "window").agg(F.min("_before").alias("_start"))
    new = rest.select("conv_id", "window", F.lit(2).alias("_kind"), "n", "role", "text")
    reach = 2 * F.floor((F.col("_before") + history) / F.col("_b")) + 1
    later = rest.where(reach > F.col("window")).withColumn("_w", F.explode(F.sequence(F.col("window") + 1, reach)))
    at = starts.select(F.col("conv_id").alias("_c"), F.col("window").alias("_sw"), "_start")
    repeated = later.join(at, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_w") == F.col("_sw"))).where(F.col("_start") - F.col("_before") <= history)
    repeated = repeated.select("conv_id", F.col("_w").alias("window"), F.lit(1).alias("_kind"), "n", "role", "text")

    firsts = starts.groupBy("conv_id").agg(F.min("window").alias("_first"))
    firsts = system.select("conv_id").join(firsts.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", F.coalesce("_first", F.lit(0).cast("long")).alias("window"))
    spread = starts.select("conv_id", "window").unionByName(firsts).distinct()
    led = spread.join(system.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    led = led.join(firsts.select(F.col("conv_id").alias("_c"), F.col("window").alias("_first")), F.col("conv_id").eqNullSafe(F.col("_c")))
    led = led.select("conv_id", "window", F.when(F.col("window") == F.col("_first"), 2).otherwise(0).alias("_kind"), F.lit(1).cast("long").alias("n"), F.lit("system").alias("role"), F.col("_system").alias("text"))

    rows = new.unionByName(repeated).unionByName(led)
    rows = rows.withColumn("_head", F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))).withColumn("_body", escape(F.col("text")))
    turn = F.struct("n", "_kind", F.concat("_head", "_body", F.lit("</turn>\n")).alias("s"), F.char_length("_head").alias("h"), F.char_length("_body").alias("b"), (F.col("role") == ROLE_OF_LOSS).alias("learn"))
    packed = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["s"])).alias("at"),
            F.when((x["_kind"] == 2) & x["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["b"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return packed.select("conv_id", "window", F.size(F.filter("t", lambda x: x["_kind"] < 2)).alias("n_repeated"), F.array_join(F.transform("t", lambda x: x["s"]), "").alias("text"), spans.alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    from the windows alone.  Windows stream by in order, so a conversation of any
    length needs no more memory than one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close() -> None:
            conv, n, turns, chars, loss, total = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, skip, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, words in parse(text)[skip:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learnt = _ESCAPED.sub(r"\1", text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    kept = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "window", "n_repeated", "text", "loss")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
