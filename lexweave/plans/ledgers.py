"""L: work queues, result ingest and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.scan import md5_key
from ..session import scratch_path
from ..sources.tables import table
from ..streaming import ingest, usage
from .base import documents
from .registry import query

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("L1_budgeted_queue", """SELECT doc_id FROM (SELECT doc_id, n_chars, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr') ORDER BY CASE WHEN source IN ('src3', 'src9') THEN 0 ELSE 1 END, md5('q|' || doc_id), doc_id LIMIT 125""")
def l1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    q = ledger.pending(docs, table(spark, d, "labels"), docs.where("lang = 'fr'"), ["doc_id"])
    first = F.when(F.col("source").isin("src3", "src9"), 0).otherwise(1)
    return ledger.budgeted_queue(q, [first, md5_key("doc_id", seed="q"), F.col("doc_id")], 500, 250_000, 2000).select("doc_id")


@query("L1_prefix_budget", "SELECT doc_id, spent FROM (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE spent <= 400000")
def l1b(spark, d):
    q = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left_anti")
    return ledger.prefix_budget(q, ["doc_id"], "n_chars", 400_000).select("doc_id", "spent")


@query("L2_usage_by_local_day", "SELECT event_type, CAST(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS DATE) AS day, round(sum(value), 4) AS used, count(*) AS requests FROM events GROUP BY ALL")
def l2(spark, d):
    out = ledger.daily_usage(table(spark, d, "events"), "ts", "Asia/Kolkata", ["event_type"], "value")
    return out.withColumn("used", F.round("used", 4))


@query("L3_remaining_budget", "SELECT event_type, CAST(ts AS DATE) AS day, least(60, greatest(0, 120 - count(*))) AS remaining FROM events GROUP BY ALL")
def l3(spark, d):
    u = ledger.daily_usage(table(spark, d, "events"), "ts", "UTC", ["event_type"], "value")
    return u.select("event_type", "day", ledger.remaining_budget(F.col("requests"), F.lit(120), F.lit(60)).cast("long").alias("remaining"))


@query("L4_recency_guard", f"SELECT event_id AS run_id, ts AS submitted_at FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 90 MINUTE ORDER BY ts DESC, event_id DESC LIMIT 1")
def l4(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("submitted_at"))
    return ledger.submitted_recently(runs, now(), 1.5)


@query("L5_custom_ids", "SELECT event_id, event_type AS mode, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'run-' || user_id END AS run_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id AS INTEGER) END AS number FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 9 = 0")
def l5(spark, d):
    e = table(spark, d, "events")
    cid = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("other:"), "event_id")).otherwise(F.concat_ws(":", F.lit("senttag"), "event_type", F.concat(F.lit("run-"), "user_id"), "event_id"))
    return e.select("event_id", F.inline(F.array(F.coalesce(ledger.parse_custom_id(cid), F.struct(F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("int").alias("number"))))))


# Result records derived from events: every 10th has an error status, every
# 11th contradicts itself, every 13th claims an unknown status.
def result_lines(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    status = F.when(i % 13 == 0, "bogus").when(i % 2 == 0, "ruined_or_remains").otherwise("extant_uninhabited")
    claim = F.struct(
        F.lit(1).alias("sentence_number"), F.col("event_type").alias("exact_place_text"), F.col("event_type").alias("canonical_place_name"), status.alias("place_status"),
        F.when(i % 3 == 0, "past").otherwise("present").alias("temporal_scope"), F.when(i % 5 == 0, "sure").otherwise("high").alias("confidence"))
    has = i % 4 != 0
    claims = F.when(has, F.when(i % 7 == 0, F.array(claim, claim)).otherwise(F.array(claim))).otherwise(F.array().cast(f"array<{'struct<sentence_number:int,exact_place_text:string,canonical_place_name:string,place_status:string,temporal_scope:string,confidence:string>'}>"))
    args = F.to_json(F.struct(F.when(i % 11 == 0, ~has).otherwise(has).alias("has_place_state_claim"), F.lit("s").alias("summary"), claims.alias("claims")))
    body = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(args.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices"),
                    F.struct(F.lit(900).alias("prompt_tokens"), (i % 50).alias("completion_tokens")).alias("usage"))
    resp = F.struct(F.when(i % 10 == 0, 500).otherwise(200).alias("status_code"), body.alias("body"))
    cid = F.concat_ws(":", F.lit("senttag"), F.lit("place-state"), F.lit("run-1"), i)
    return e.select(F.to_json(F.struct(cid.alias("custom_id"), resp.alias("response"))).alias("value"))


def items(spark, d):
    """Stored requests: those of events without every 17th, plus some never answered."""
    i = F.col("event_id")
    e = table(spark, d, "events").where(i % 17 != 0).select(F.lit("run-1").alias("run_id"), i.cast("int").alias("number"), F.concat(F.lit("p"), "user_id").alias("passage_id"))
    lost = table(spark, d, "labels").select(F.lit("run-1").alias("run_id"), (10_000_000 + F.col("doc_id")).cast("int").alias("number"), F.lit("p").alias("passage_id"))
    return e.unionByName(lost)


_RES = """r AS (SELECT event_id AS i, user_id, event_type, event_id % 4 <> 0 AS has, CASE WHEN event_id % 10 = 0 THEN 'record status 500' WHEN event_id % 11 = 0 AND event_id % 4 = 0 THEN 'claim flag set but claims empty' WHEN event_id % 11 = 0 THEN 'claims present but flag is false'
 WHEN event_id % 13 = 0 AND event_id % 4 <> 0 THEN 'invalid place status' WHEN event_id % 17 = 0 THEN 'no stored item for request' END AS error FROM events)"""


@query("L6_nested_arguments", f"WITH {_RES} SELECT 'run-1' AS run_id, CAST(i AS INTEGER) AS number, CAST(900 AS BIGINT) AS input_tokens, i % 50 AS output_tokens, CASE WHEN error = 'no stored item for request' THEN NULL ELSE error END AS error FROM r")
def l6(spark, d):
    return ledger.parse_results(result_lines(spark, d)).select("run_id", "number", "input_tokens", "output_tokens", "error")


def matched(spark, d):
    return ledger.match_items(ledger.parse_results(result_lines(spark, d)), items(spark, d))


@query("L7_reviews", f"WITH {_RES} SELECT CAST(i AS INTEGER) AS number, 'p' || user_id AS passage_id, has AS has_claim, i % 50 AS output_tokens FROM r WHERE error IS NULL")
def l7(spark, d):
    return ledger.reviews(matched(spark, d)).select("number", "passage_id", "has_claim", "output_tokens")


@query("L7_mentions", f"""WITH {_RES}, m AS (SELECT *, unnest(CASE WHEN i % 7 = 0 THEN [1, 2] ELSE [1] END) AS k FROM r WHERE error IS NULL AND has)
SELECT CAST(i AS INTEGER) AS number, k AS claim_index, event_type AS exact_place_text, CASE WHEN i % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN i % 3 = 0 THEN 'exclude' WHEN i % 2 = 0 THEN 'does_not_survive' ELSE 'survives' END AS target_label FROM m""")
def l7b(spark, d):
    return ledger.mentions(matched(spark, d), "present").select("number", "claim_index", "exact_place_text", "confidence", "target_label")


@query("L7_item_status", f"""WITH {_RES} SELECT CAST(i AS INTEGER) AS number, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error FROM r WHERE i % 17 <> 0
UNION ALL SELECT CAST(10000000 + doc_id AS INTEGER), 'failed', 'no record returned for request' FROM labels""")
def l7c(spark, d):
    return ledger.item_updates(matched(spark, d), items(spark, d)).select("number", "status", "error")


@query("L8_unassigned_errors", f"WITH {_RES} SELECT 'senttag:place-state:run-1:' || i AS custom_id, error FROM r WHERE i % 17 = 0 AND error IS NOT NULL")
def l8(spark, d):
    return ledger.unassigned_errors(matched(spark, d))


@query("L9_streamed_result_ingest", f"WITH {_RES} SELECT CAST(i AS INTEGER) AS number, CASE WHEN error IS NULL OR error = 'no stored item for request' THEN 'completed' ELSE 'failed' END AS status, i % 50 AS output_tokens FROM r")
def l9(spark, d):
    folder = scratch_path(spark, "results")
    result_lines(spark, d).repartition(4).write.text(folder)
    result_lines(spark, d).write.mode("append").text(folder)  # every record arrives twice

    def parse(df):
        p = ledger.parse_results(df)
        return p.select("run_id", "number", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "output_tokens", F.lit(1).alias("version"))

    store = ingest.KeyedStore(spark, scratch_path(spark, "store"), ["run_id", "number"], "version")
    ingest.stream_results(spark, folder, parse, store, scratch_path(spark, "chk"), files_per_batch=3).awaitTermination()
    return store.read().select("number", "status", "output_tokens")


def event_stream(spark, d):
    # event time must be a TIMESTAMP; the files hold it without a zone
    raw = usage.event_stream(spark, d, table(spark, d, "events").schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df, col="start"):
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


@query("L10_streamed_daily_usage", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, round(sum(value), 4) AS used, count(*) AS requests FROM events GROUP BY ALL")
def l10(spark, d):
    s = usage.windowed_usage(event_stream(spark, d), "ts", "value", "1 hour", "1 day", group=["event_type"])
    return plain(usage.run_updates(s, ["event_type", "start"]).select("event_type", "start", "used", "requests"))


@query("L10_streamed_sliding_usage", "SELECT w AS start, round(sum(value), 4) AS used, count(*) AS requests FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY ALL")
def l10b(spark, d):
    s = usage.windowed_usage(event_stream(spark, d), "ts", "value", "1 hour", "12 hours", "6 hours")
    return plain(usage.run_updates(s, ["start"]).select("start", "used", "requests"))


@query("L10_streamed_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, round(sum(value), 4) AS used, count(*) AS requests FROM s GROUP BY user_id, sid""")
def l10c(spark, d):
    s = usage.session_usage(event_stream(spark, d), "ts", "value", "1 hour", "2 hours", "user_id")
    return plain(usage.run_complete(s).select("user_id", "start", "used", "requests"))


@query("L10_late_rows", """SELECT event_id, ts FROM events WHERE event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 6 HOUR""")
def l10d(spark, d):
    # the odd events arrive after the even ones, in a second run of the query
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    source, out, chk = (scratch_path(spark, name) for name in ("arrivals", "by-lateness", "lateness-chk"))
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        _, late = usage.append_with_late(spark.readStream.schema(e.schema).parquet(source), "ts", 6 * 3600, out, chk)
    return plain(late, "ts")


@query("L11_idempotent_reingest", "SELECT event_id, event_type FROM events")
def l11(spark, d):
    folder = scratch_path(spark, "twice")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(folder)
    e.write.mode("append").parquet(folder)
    s = ingest.distinct_within(spark.readStream.schema(e.schema).parquet(folder), "ts", "1 hour", ["event_id"])
    return ingest.run_to_table(s).select("event_id", "event_type")


@query("L12_stuck_runs", f"SELECT event_id AS run, ts AS submitted_at FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND event_id % 3 = 0")
def l12(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("run"), F.col("ts").alias("submitted_at"))
    return ledger.stuck_runs(e, e.where("run % 3 <> 0"), "run", now(), 24)


@query("L12_streamed_stuck_alerts")
def l12b(spark, d):
    e = event_stream(spark, d)
    sub = e.select("event_id", F.col("ts").alias("submitted_at"))
    res = e.where("event_id % 3 <> 0").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"))
    return plain(ingest.run_to_table(usage.stuck_alerts(sub, res, "event_id", 24)), "submitted_at")
