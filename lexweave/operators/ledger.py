"""Work queues, budgets and result ingest over run and item ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ordered_scan

# Allowed claim values.
PLACE_STATUSES = (
    "inhabited_still_exists", "extant_uninhabited", "ruined_or_remains", "abandoned_or_deserted",
    "destroyed_no_trace", "renamed_refounded_or_transferred", "unclear",
)
CONFIDENCES = ("high", "medium", "low")

USAGE = "struct<prompt_tokens:long,completion_tokens:long>"
CALL = "struct<function:struct<arguments:string>>"
RECORD = (
    "custom_id string, error string, response struct<status_code:int,body:struct<error:struct<message:string>,"
    f"choices:array<struct<message:struct<tool_calls:array<{CALL}>>>>,usage:{USAGE}>>"
)
CLAIM = (
    "struct<sentence_number:int,exact_place_text:string,canonical_place_name:string,place_status:string,"
    "temporal_scope:string,evidence_quote:string,confidence:string,rationale:string>"
)
ARGUMENTS = f"has_place_state_claim boolean, summary string, claims array<{CLAIM}>"


def pending(units: DataFrame, done: DataFrame, in_flight: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units neither finished nor waiting for a result."""
    k = list(key)
    return units.join(done.select(*k), k, "left_anti").join(in_flight.select(*k), k, "left_anti")


def budgeted_queue(queue: DataFrame, order: Sequence[Column], stop_after: int, budget: int, cost: int) -> DataFrame:
    """First min(stop_after, budget // cost) units in priority order (a top-k)."""
    return queue.orderBy(*order).limit(max(0, min(stop_after, budget // cost)))


def prefix_budget(queue: DataFrame, order: Sequence[str], cost: str, budget: int) -> DataFrame:
    """Units in order while their running cost stays within the budget."""
    return ordered_scan(queue, [], order, {"spent": ("sum", cost)}).where(F.col("spent") <= budget)


def daily_usage(usage: DataFrame, ts: str, zone: str, group: Sequence[str], tokens: str) -> DataFrame:
    """Tokens per local calendar day of a time zone."""
    day = F.to_date(F.from_utc_timestamp(ts, zone)).alias("day")
    return usage.groupBy(*group, day).agg(F.sum(tokens).alias("used"), F.count("*").alias("requests"))


def remaining_budget(used: Column, daily: Column, run: Column) -> Column:
    """What a lane may still spend today, capped by the run's own budget."""
    return F.least(run, F.greatest(F.lit(0), daily - F.coalesce(used, F.lit(0))))


def submitted_recently(runs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Latest run submitted within the last hours, if any."""
    recent = runs.where(F.col("submitted_at").isNotNull() & (F.col("submitted_at") >= now - F.make_interval(mins=F.lit(int(hours * 60)))))
    return recent.orderBy(F.desc("submitted_at"), F.desc("run_id")).limit(1)


def parse_custom_id(col: Column, prefix: str = "senttag") -> Column:
    """``prefix:mode:run:number`` to struct<mode, run_id, number>; null if malformed."""
    parts = F.split(col, ":")
    number = F.get(parts, F.lit(3)).try_cast("int")
    ok = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == prefix) & number.isNotNull()
    return F.when(ok, F.struct(F.get(parts, F.lit(1)).alias("mode"), F.get(parts, F.lit(2)).alias("run_id"), number.alias("number")))


def parse_results(lines: DataFrame, value: str = "value", prefix: str = "senttag") -> DataFrame:
    """Result lines to ids, nested arguments, usage and the first error met."""
    r = lines.where(F.trim(value) != "").withColumn("_r", F.from_json(value, RECORD))
    call = F.get(F.get(F.col("_r.response.body.choices"), F.lit(0))["message"]["tool_calls"], F.lit(0))
    args = call["function"]["arguments"]
    r = r.withColumn("_id", parse_custom_id(F.col("_r.custom_id"), prefix)).withColumn("_text", args).withColumn("args", F.from_json("_text", ARGUMENTS))
    code = F.col("_r.response.status_code")
    claims = F.coalesce(F.size("args.claims"), F.lit(0))
    flag = F.coalesce(F.col("args.has_place_state_claim"), F.lit(False))
    bad_status = F.exists("args.claims", lambda c: ~F.coalesce(c["place_status"].isin(*PLACE_STATUSES), F.lit(False)))
    error = (
        F.when(F.col("_r.custom_id").isNull(), "unreadable record")
        .when(F.col("_id").isNull(), "unexpected custom_id")
        .when(F.coalesce(code, F.lit(0)) != 200, F.concat(F.lit("record status "), F.coalesce(code.cast("string"), F.lit("none"))))
        .when(F.coalesce(F.size("_r.response.body.choices"), F.lit(0)) < 1, "no choices")
        .when(F.col("_text").isNull(), "no tool call")
        .when(F.col("args.claims").isNull() & F.col("args.summary").isNull() & F.col("args.has_place_state_claim").isNull(), "unreadable arguments")
        .when(flag & (claims == 0), "claim flag set but claims empty")
        .when(~flag & (claims > 0), "claims present but flag is false")
        .when(F.coalesce(bad_status, F.lit(False)), "invalid place status")
    )
    return r.select(
        F.col("_r.custom_id").alias("custom_id"), F.col("_id.mode").alias("mode"), F.col("_id.run_id").alias("run_id"), F.col("_id.number").alias("number"), "args",
        F.coalesce("_r.response.body.usage.prompt_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("_r.response.body.usage.completion_tokens", F.lit(0)).alias("output_tokens"), error.alias("error"))


def match_items(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Parsed results joined to stored items (run_id, number, passage_id); a
    result without an item becomes a failure."""
    known = items.select("run_id", "number", "passage_id")
    j = parsed.join(known, ["run_id", "number"], "left")
    return j.withColumn("error", F.coalesce("error", F.when(F.col("passage_id").isNull(), "no stored item for request")))


def reviews(matched: DataFrame) -> DataFrame:
    return matched.where("error IS NULL").select(
        "run_id", "number", "passage_id", F.coalesce("args.has_place_state_claim", F.lit(False)).alias("has_claim"), F.coalesce("args.summary", F.lit("")).alias("summary"), "input_tokens", "output_tokens")


def mentions(matched: DataFrame, present: str) -> DataFrame:
    """One row per claim, numbered from 1, with its training label."""
    from .quality import status_label

    rows = matched.where("error IS NULL").select("run_id", "number", "passage_id", F.posexplode("args.claims").alias("p", "c"))
    conf = F.when(F.col("c.confidence").isin(*CONFIDENCES), F.col("c.confidence")).otherwise("low")
    return rows.select(
        "run_id", "number", "passage_id", (F.col("p") + 1).alias("claim_index"), "c.sentence_number", F.coalesce("c.exact_place_text", F.lit("")).alias("exact_place_text"),
        F.coalesce("c.canonical_place_name", F.lit("")).alias("canonical_place_name"), "c.place_status", "c.temporal_scope", conf.alias("confidence"),
        status_label(F.col("c.place_status"), F.col("c.temporal_scope"), present).alias("target_label"))


def item_updates(matched: DataFrame, items: DataFrame) -> DataFrame:
    """New status of every stored item: completed, failed with its error, or
    failed because no record came back."""
    first = matched.where(F.col("number").isNotNull()).groupBy("run_id", "number").agg(
        F.min(F.struct(F.col("error").isNotNull().alias("bad"), "error", "input_tokens", "output_tokens")).alias("r"))
    j = items.select("run_id", "number").join(first, ["run_id", "number"], "left")
    return j.select(
        "run_id", "number", F.when(F.col("r").isNotNull() & ~F.col("r.bad"), "completed").otherwise("failed").alias("status"),
        F.when(F.col("r").isNull(), "no record returned for request").otherwise(F.col("r.error")).alias("error"),
        F.when(~F.coalesce("r.bad", F.lit(True)), F.col("r.input_tokens")).otherwise(0).alias("input_tokens"),
        F.when(~F.coalesce("r.bad", F.lit(True)), F.col("r.output_tokens")).otherwise(0).alias("output_tokens"))


def unassigned_errors(matched: DataFrame) -> DataFrame:
    """Failures that belong to no stored item, kept apart."""
    return matched.where(F.col("error").isNotNull() & F.col("passage_id").isNull()).select("custom_id", "error")


def stuck_runs(submitted: DataFrame, results: DataFrame, key: str, now: Column, hours: int) -> DataFrame:
    """Submitted more than ``hours`` ago and no result so far."""
    late = submitted.where(F.col("submitted_at") < now - F.make_interval(hours=F.lit(hours)))
    return late.join(results.select(key), key, "left_anti")
