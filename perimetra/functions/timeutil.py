"""Clock conventions as column expressions; the zone is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Kolkata"


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1e6).cast("long"))


def rfc3339(ts: Column) -> Column:
    """Milliseconds and Z, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local(ts, zone))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """[start, end) in minutes of the day; wraps past midnight; equal ends are the whole day."""
    return F.when(start == end, True).when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def is_night(minute: Column) -> Column:
    """18:30 to 05:30."""
    return (minute >= 18 * 60 + 30) | (minute < 5 * 60 + 30)


def clip_label(ts: Column) -> Column:
    """As '05 JAN · 10:30'."""
    return F.concat(F.upper(F.date_format(ts, "dd MMM")), F.lit(" · "), F.date_format(ts, "HH:mm"))


def shift_start(ts: Column, hours: int = 8) -> Column:
    """Start of the epoch-aligned shift."""
    size = hours * 3600
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / size) * size)
