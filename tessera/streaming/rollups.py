"""Streaming forms of the rollups: event-time tumbling buckets with a watermark, and append-once event logs.

The batch rollups bucket by arrival; here the time of the event counts, and the watermark stands for the retention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.localtime import ZONE
from tessera.functions.numbers import count_where


def usage_buckets(calls: DataFrame, minutes: int = 5, retention: str = "48 hours", zone: str = ZONE) -> DataFrame:
    """Buckets of streaming calls (ts, provider, model, ok, tokens, latency_ms, quota_used) by provider and model; the
    local start is added after the aggregation."""
    failed = ~F.coalesce("ok", F.lit(False))
    rows = calls.withWatermark("ts", retention).groupBy(F.window("ts", f"{minutes} minutes"), "provider", "model").agg(
        F.count(F.lit(1)).alias("request_count"),
        count_where(failed).alias("error_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("token_count"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_sum_ms"),
        F.count("latency_ms").alias("latency_count"),
        F.coalesce(F.max("quota_used"), F.lit(0)).alias("quota_used_peak"),
    )
    return rows.select(F.from_utc_timestamp("window.start", zone).alias("bucket_start"), *[c for c in rows.columns if c != "window"])


def once(events: DataFrame, key: str = "id", ts: str = "ts", retention: str = "48 hours") -> DataFrame:
    """A stream of events in which each id comes once within the retention."""
    return events.withWatermark(ts, retention).dropDuplicatesWithinWatermark([key])


def write_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a stream over what there is and keep its result in a table in memory (for tests and small dashboards)."""
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files; a restarted query goes on where its checkpoint says."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
