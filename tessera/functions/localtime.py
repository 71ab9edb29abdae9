"""Keys of local days, hours and minutes. Instants are timestamps in a session whose zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Lisbon"


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an instant."""
    return F.from_utc_timestamp(ts, zone)


def day_key(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def hour_key(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd'T'HH")


def floor_minutes(wall: Column, minutes: int) -> Column:
    """Wall-clock time floored to a multiple of `minutes` within its hour (hours and days as well)."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(wall.cast("timestamp")) / (60 * minutes)) * (60 * minutes))


def bucket_key(ts: Column, minutes: int = 5, zone: str = ZONE) -> Column:
    return F.date_format(floor_minutes(local(ts, zone), minutes), "yyyy-MM-dd'T'HH:mm")


def text_bucket_key(text: Column, minutes: int = 5) -> Column:
    """Bucket of a local time written as text, without a shift of zone."""
    wall = F.try_to_timestamp(F.substring(F.translate(text, "T", " "), 1, 16), F.lit("yyyy-MM-dd HH:mm"))
    return F.date_format(floor_minutes(wall, minutes), "yyyy-MM-dd'T'HH:mm")


def day_start(day: Column, zone: str = ZONE) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("date").cast("timestamp"), zone)


def day_end(day: Column, zone: str = ZONE) -> Column:
    """The instant at which the next local day begins."""
    return day_start(F.date_add(day.cast("date"), 1), zone)


def hour_start(key: Column, zone: str = ZONE) -> Column:
    """The first instant of a local hour; of an hour that comes twice, the earlier one."""
    return F.to_utc_timestamp(F.try_to_timestamp(key, F.lit("yyyy-MM-dd'T'HH")), zone)


def add_days(day: Column, n: int) -> Column:
    """The key of the local day n days after another."""
    return F.date_format(F.date_add(day.cast("date"), n), "yyyy-MM-dd")


LOCAL_TEXT = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2}))?)?)?$"


def local_parts(text: Column) -> Column:
    """(day, hour, minute, second) of a local time written as a day with or without hour, minute and second; what is not
    there is null, and so is the whole if it is written otherwise."""
    t = F.trim(F.coalesce(text, F.lit("")))
    number = lambda k: F.regexp_extract(t, LOCAL_TEXT, k).try_cast("int")
    return F.when(t.rlike(LOCAL_TEXT), F.struct(F.regexp_extract(t, LOCAL_TEXT, 1).alias("day"), number(2).alias("hour"), number(3).alias("minute"), number(4).alias("second")))


def instant(text: Column, zone: str = ZONE) -> Column:
    """The instant at which a written local time begins."""
    p = local_parts(text)
    zero = lambda c: F.coalesce(c, F.lit(0))
    start = hour_start(F.concat(p["day"], F.lit("T"), F.lpad(zero(p["hour"]).cast("string"), 2, "0")), zone)
    return F.timestamp_seconds(F.unix_seconds(start) + zero(p["minute"]) * 60 + zero(p["second"]))


def exclusive_end(text: Column, zone: str = ZONE) -> Column:
    """The instant at which what a written local time names is over: its second, minute or hour, as far as it is written,
    or its day; midnight stands for its day."""
    p = local_parts(text)
    midnight = (F.coalesce(p["hour"], F.lit(0)) == 0) & (F.coalesce(p["minute"], F.lit(0)) == 0) & (F.coalesce(p["second"], F.lit(0)) == 0)
    step = F.when(p["second"].isNotNull(), 1).when(p["minute"].isNotNull(), 60).otherwise(3600)
    return F.when(midnight, day_end(p["day"].try_cast("date"), zone)).otherwise(F.timestamp_seconds(F.unix_seconds(instant(text, zone)) + step))
