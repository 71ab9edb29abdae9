"""Usage rollups: tumbling local buckets by provider and model, and the dashboards read from them.

A rollup row is (bucket_start, provider, model) with request_count, error_count, token_count, latency_sum_ms,
latency_count, limit_count, quota_used_peak, app_limit_count, provider_limit_count and replenish_count; bucket_start is
local wall-clock time and is never converted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.localtime import ZONE, floor_minutes, local
from tessera.functions.numbers import count_where, half_up, rounded_mean

#: The model name under which quota pressure is kept, and the retention of the two bucket sizes in hours.
QUOTA_MODEL = "__quota__"
RETENTION_HOURS = {1: 2, 5: 48}
COUNTERS = ("request_count", "error_count", "token_count", "latency_sum_ms", "latency_count", "limit_count", "app_limit_count", "provider_limit_count", "replenish_count")


def token_count(total: Column, *parts: Column) -> Column:
    """Tokens of a call: the total if it is positive, else the sum of the positive parts."""
    positive = lambda x: F.when(x > 0, half_up(x.cast("double"))).otherwise(F.lit(0)).cast("long")
    whole = positive(total)
    summed = F.lit(0).cast("long")
    for p in parts:
        summed = summed + F.coalesce(positive(p), F.lit(0))
    return F.when(F.coalesce(whole, F.lit(0)) > 0, whole).otherwise(summed)


def rollup(calls: DataFrame, minutes: int = 5, zone: str = ZONE) -> DataFrame:
    """Buckets of calls (ts, provider, model, ok, tokens, latency_ms, limit_hit, quota_used, error_kind, replenish)."""
    failed = ~F.coalesce("ok", F.lit(False))
    return calls.groupBy(floor_minutes(local(F.col("ts"), zone), minutes).cast("timestamp_ntz").alias("bucket_start"), F.lower(F.trim(F.coalesce("provider", F.lit("")))).alias("provider"), F.trim(F.coalesce("model", F.lit(""))).alias("model")).agg(
        F.count(F.lit(1)).alias("request_count"),
        count_where(failed).alias("error_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("token_count"),
        F.coalesce(F.sum(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0)).cast("long").alias("latency_sum_ms"),
        count_where(F.col("latency_ms") > 0).alias("latency_count"),
        count_where(F.col("limit_hit")).alias("limit_count"),
        F.coalesce(F.max("quota_used"), F.lit(0)).cast("long").alias("quota_used_peak"),
        count_where(failed & (F.col("error_kind") == "app_limit")).alias("app_limit_count"),
        count_where(failed & (F.col("error_kind") == "provider_limit")).alias("provider_limit_count"),
        count_where(F.col("replenish")).alias("replenish_count"),
    )


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of buckets: counters add up, the quota peak is the larger one."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy("bucket_start", "provider", "model").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.coalesce(F.max("quota_used_peak"), F.lit(0)).alias("quota_used_peak"))


def retain(rows: DataFrame, as_of_local: str, minutes: int) -> DataFrame:
    """Buckets younger than the retention of their size."""
    return rows.filter(F.col("bucket_start") >= F.to_timestamp_ntz(F.lit(as_of_local)) - F.expr(f"INTERVAL {RETENTION_HOURS[minutes]} HOURS"))


def filter_dimensions(rows: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    if provider:
        rows = rows.filter(F.lower(F.trim("provider")) == provider.strip().lower())
    return rows.filter(F.trim("model") == model.strip()) if model else rows


def by_bucket(rows: DataFrame, minutes: int = 1) -> DataFrame:
    """Counters and quota peak of each bucket, whatever the provider and model."""
    start = floor_minutes(F.col("bucket_start").cast("timestamp"), minutes).cast("timestamp_ntz").alias("bucket_start")
    return rows.groupBy(start).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.coalesce(F.max("quota_used_peak"), F.lit(0)).alias("quota_used_peak"))


def bucket_series(rows: DataFrame, as_of_local: str, lookback_hours: int, minutes: int = 5) -> DataFrame:
    """(key, requests, cumulative, ...) of each bucket of the look-back, zero-filled, and of older buckets among the rows.

    Running sums start anew each local day; a bucket's latency is the ratio of its sums."""
    spark = rows.sparkSession
    steps = lookback_hours * 60 // minutes
    end = floor_minutes(F.to_timestamp(F.lit(as_of_local)), minutes)
    grid = spark.range(steps).select(F.timestamp_seconds(F.unix_seconds(end) - F.col("id") * 60 * minutes).cast("timestamp_ntz").alias("bucket_start"))
    filled = grid.join(by_bucket(rows, minutes), "bucket_start", "full_outer").fillna(0)
    day = F.date_format("bucket_start", "yyyy-MM-dd")
    within = W.partitionBy(day).orderBy("bucket_start").rowsBetween(W.unboundedPreceding, 0)
    return filled.select(
        F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm").alias("key"),
        F.col("request_count").alias("requests"),
        F.sum("request_count").over(within).alias("cumulative"),
        F.sum("token_count").over(within).alias("cumulative_tokens"),
        F.col("error_count").alias("errors"),
        F.col("token_count").alias("tokens"),
        F.col("limit_count").alias("limits"),
        F.col("quota_used_peak").alias("quota_pressure"),
        F.col("app_limit_count").alias("app_limits"),
        F.col("provider_limit_count").alias("provider_limits"),
        F.greatest(F.lit(0), F.col("error_count") - F.col("app_limit_count") - F.col("provider_limit_count")).alias("other_errors"),
        F.col("replenish_count").alias("replenish_requests"),
        F.coalesce(rounded_mean(F.col("latency_sum_ms"), F.col("latency_count")), F.lit(0)).alias("latency"),
    )


def series_totals(series: DataFrame) -> DataFrame:
    """Totals of a bucket series. The mean latency is a mean of the buckets' rounded means, buckets without one left out."""
    timed = F.when(F.col("latency") > 0, F.col("latency"))
    return series.agg(
        *[F.sum(c).alias(f"total_{c}") for c in ("requests", "errors", "tokens", "limits", "app_limits", "provider_limits", "other_errors", "replenish_requests")],
        F.max("quota_pressure").alias("peak_quota_pressure"),
        rounded_mean(F.sum(timed), F.count(timed)).alias("avg_latency_ms"),
    )


def error_breakdown(buckets: DataFrame) -> DataFrame:
    """Errors by cause over aggregated buckets, in which no model is left to leave out."""
    app, provider = F.sum("app_limit_count"), F.sum("provider_limit_count")
    return buckets.agg(app.alias("app_rate_limit"), provider.alias("provider_rate_limit"), F.greatest(F.lit(0), F.sum("error_count") - app - provider).alias("other_errors"), F.sum("replenish_count").alias("replenish_requests"))


def summary(buckets: DataFrame, as_of_local: str) -> DataFrame:
    """Requests of the last 1, 24 and 48 hours, the success rate and today's requests."""
    now = F.to_timestamp_ntz(F.lit(as_of_local))
    since = lambda h: F.col("bucket_start") >= now - F.expr(f"INTERVAL {h} HOURS")
    requests = lambda h: F.coalesce(F.sum(F.when(since(h), F.col("request_count"))), F.lit(0))
    errors = F.coalesce(F.sum(F.when(since(48), F.col("error_count"))), F.lit(0))
    today = F.coalesce(F.sum(F.when(F.to_date("bucket_start") == F.to_date(now), F.col("request_count"))), F.lit(0))
    row = buckets.agg(requests(1).alias("last_1h"), requests(24).alias("last_24h"), requests(48).alias("last_48h"), errors.alias("errors"), today.alias("quota_used_today"))
    rate = F.when(F.col("last_48h") > 0, F.floor((F.col("last_48h") - F.col("errors")) / F.col("last_48h") * 1000 + 0.5) / 10)
    return row.withColumn("success_rate", rate)


def catalog(rows: DataFrame) -> DataFrame:
    """(provider, model, count) of requests, and of each provider as a whole with a null model; empty ones are left out."""
    used = rows.filter((F.col("request_count") > 0) & (F.trim("provider") != "")).select(F.lower(F.trim("provider")).alias("provider"), F.trim("model").alias("model"), "request_count")
    whole = used.groupBy("provider").agg(F.sum("request_count").alias("count")).select("provider", F.lit(None).cast("string").alias("model"), "count")
    return whole.unionByName(used.filter("model <> ''").groupBy("provider", "model").agg(F.sum("request_count").alias("count")))
