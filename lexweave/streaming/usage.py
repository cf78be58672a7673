"""Windowed usage and alerts on event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .ingest import KeyedStore


def windowed_usage(events: DataFrame, ts: str, value: str, delay: str, size: str, slide: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Sum and count per tumbling (or sliding) event-time window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(*group, w).agg(F.round(F.sum(value), 4).alias("used"), F.count("*").alias("requests")).select(
        *group, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "used", "requests")


def session_usage(events: DataFrame, ts: str, value: str, delay: str, gap: str, key: str) -> DataFrame:
    """Sum and count per session of a key, closed by an idle gap."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.round(F.sum(value), 4).alias("used"), F.count("*").alias("requests")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "used", "requests")


def run_updates(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode aggregation to completion and read the final rows."""
    spark = stream.sparkSession
    store = KeyedStore(spark, scratch_path(spark, "usage"), keys, "batch_version")

    def sink(df: DataFrame, batch_id: int) -> None:
        store.write_batch(df.withColumn("batch_version", F.lit(batch_id).cast("long")), batch_id)

    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "usage-chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read().drop("batch_version")


def run_complete(stream: DataFrame) -> DataFrame:
    """Run an aggregation in complete mode (session windows allow no update
    mode); every batch replaces the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, "complete")
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).option(
        "checkpointLocation", scratch_path(spark, "complete-chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def split_late(df: DataFrame, ts: str, high_water, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """On-time and late rows against the newest event time seen so far.

    For use inside ``foreachBatch``: the stream itself drops late rows without a
    trace, so they are set aside here first.
    """
    if high_water is None:
        return df, df.where(F.lit(False))
    edge = F.lit(high_water) - F.make_interval(secs=F.lit(delay_seconds))
    return df.where(F.col(ts) >= edge), df.where(F.col(ts) < edge)


def append_with_late(stream: DataFrame, ts: str, delay_seconds: int, folder: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Append a stream to two tables, on time and late, and return both.

    The newest event time is read back from the batches before, so a restarted
    query judges its first batch like any other, and a replayed batch replaces
    its own rows.
    """
    spark = stream.sparkSession

    def sink(df: DataFrame, batch_id: int) -> None:
        high = None if batch_id == 0 else spark.read.parquet(f"{folder}/on_time").where(F.col("batch") < batch_id).agg(F.max(ts)).first()[0]
        for name, rows in zip(("on_time", "late"), split_late(df, ts, high, delay_seconds)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("on_time", "late"))


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stuck_alerts(submitted: DataFrame, results: DataFrame, key: str, hours: int, delay: str = "1 hour") -> DataFrame:
    """Submissions without a result within ``hours``.

    A stream-stream left join on the key and a bounded time range: once the
    watermark passes the range, an unmatched submission comes out with a null
    result, and its state is dropped.
    """
    s = submitted.select(F.col(key).alias("k"), "submitted_at").withWatermark("submitted_at", delay)
    r = results.select(F.col(key).alias("rk"), "completed_at").withWatermark("completed_at", delay)
    on = (F.col("k") == F.col("rk")) & (F.col("completed_at") >= F.col("submitted_at")) & (
        F.col("completed_at") <= F.col("submitted_at") + F.expr(f"INTERVAL {hours} HOURS"))
    return s.join(r, on, "left_outer").where(F.col("rk").isNull()).select(F.col("k").alias(key), "submitted_at")
