"""Zero-filled time series on a local calendar up to an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.localtime import ZONE, bucket_key, day_key, hour_key

#: The look-back ranges of the review and outcome timelines, with the step of each.
RANGES = {"24h": ("hour", 24), "3d": ("hour", 72), "7d": ("day", 7), "14d": ("day", 14)}


def calendar(spark: SparkSession, as_of: str, steps: int, unit: str = "day", zone: str = ZONE) -> DataFrame:
    """(key, position) of the last `steps` local days, hours or n-minute buckets up to the one that holds as_of. Keys of
    an hour that comes twice appear once."""
    now = F.to_timestamp(F.lit(as_of))
    back = F.explode(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1))).alias("back")
    grid = spark.range(1).select(back)
    if unit == "day":
        key = F.date_format(F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), F.col("back").cast("int")), "yyyy-MM-dd")
    elif unit == "hour":
        key = hour_key(F.timestamp_seconds(F.unix_seconds(now) - F.col("back") * 3600), zone)
    else:
        minutes = int(unit)
        key = bucket_key(F.timestamp_seconds(F.floor(F.unix_seconds(now) / (60 * minutes)) * 60 * minutes - F.col("back") * 60 * minutes), minutes, zone)
    return grid.select(key.alias("key"), (F.lit(steps - 1) - F.col("back")).alias("position")).groupBy("key").agg(F.min("position").alias("position"))


def between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(key, position) of all local days of a range."""
    days = spark.range(1).select(F.posexplode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("position", "day"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("key"), "position")


def key_of(ts: Column, unit: str, zone: str = ZONE) -> Column:
    return day_key(ts, zone) if unit == "day" else hour_key(ts, zone) if unit == "hour" else bucket_key(ts, int(unit), zone)


def fill(counts: DataFrame, grid: DataFrame, *values: str) -> DataFrame:
    """The grid with the values of `counts` by key, zero where there are none; both have a row for each step."""
    filled = grid.join(counts, "key", "left")
    return filled.select("key", "position", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def within(events: DataFrame, ts: str, as_of: str, steps: int, unit: str) -> DataFrame:
    """events from a while before the first step of a calendar to a while after its last: a bound on the column itself, so
    that it reaches the scan. The slack is a day, more than any zone and clock change is off."""
    hours = steps * {"day": 24, "hour": 1}.get(unit, 0) if unit in ("day", "hour") else steps * int(unit) / 60
    slack = int(hours) + 48
    now = F.lit(as_of).cast("timestamp")
    kind = events.schema[ts].dataType.simpleString()
    low, high = (now - F.expr(f"INTERVAL {slack} HOURS")).cast(kind), (now + F.expr("INTERVAL 48 HOURS")).cast(kind)
    return events.filter((F.col(ts) >= low) & (F.col(ts) <= high))


def series(events: DataFrame, ts: str, as_of: str, steps: int, unit: str = "day", zone: str = ZONE) -> DataFrame:
    """(key, count): events by local day, hour or bucket, zero-filled; events outside the range are left out."""
    counts = within(events, ts, as_of, steps, unit).groupBy(key_of(F.col(ts), unit, zone).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return fill(counts, calendar(events.sparkSession, as_of, steps, unit, zone), "count").select("key", "count")


def stacked(events: DataFrame, ts: str, by: str, as_of: str, steps: int, unit: str = "day", zone: str = ZONE) -> DataFrame:
    """(key, by_value map, count): as `series`, with counts by the values of a column."""
    counts = within(events, ts, as_of, steps, unit).groupBy(key_of(F.col(ts), unit, zone).alias("key"), F.coalesce(by, F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("by_value"), F.sum("n").alias("count"))
    grid = calendar(events.sparkSession, as_of, steps, unit, zone)
    empty = F.create_map().cast("map<string,bigint>")
    return grid.join(maps, "key", "left").select("key", F.coalesce("by_value", empty).alias("by_value"), F.coalesce("count", F.lit(0)).alias("count"))


def from_first_day(events: DataFrame, ts: str, as_of: str, most: int = 120, zone: str = ZONE) -> DataFrame:
    """(key, count) from the first day with an event, at most `most` days back, to as_of."""
    grid = calendar(events.sparkSession, as_of, most, "day", zone)
    counts = events.filter(F.col(ts).isNotNull()).groupBy(day_key(F.col(ts), zone).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    first = counts.agg(F.min("key").alias("first"))
    return fill(counts, grid, "count").crossJoin(F.broadcast(first)).filter(F.col("key") >= F.col("first")).select("key", "count")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two series by key."""
    return a.select("key", "count").unionByName(b.select("key", "count")).groupBy("key").agg(F.sum("count").alias("count"))


def timelines(events: DataFrame, ts: str, by: str, as_of: str, zone: str = ZONE) -> DataFrame:
    """(range, key, by, count) of all ranges at once: one aggregation by hour feeds hours and days."""
    spark = events.sparkSession
    hours = events.filter(F.col(ts).isNotNull()).groupBy(hour_key(F.col(ts), zone).alias("hour"), F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    values = hours.select(by).distinct()
    out = None
    for name, (unit, steps) in RANGES.items():
        key = F.col("hour") if unit == "hour" else F.substring("hour", 1, 10)
        counts = hours.groupBy(key.alias("key"), by).agg(F.sum("n").alias("count"))
        grid = calendar(spark, as_of, steps, unit, zone).select("key").crossJoin(values)
        part = grid.join(counts, ["key", by], "left").select(F.lit(name).alias("range"), "key", by, F.coalesce("count", F.lit(0)).alias("count"))
        out = part if out is None else out.unionByName(part)
    return out
