"""Times of a service day (hours may pass 24) as seconds, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtfs_seconds(text) -> Column:
    """Seconds of HH:MM:SS; null if it isn't one."""
    p = F.split(F.trim(text), ":")
    return F.when(F.size(p) == 3, F.try_add(F.try_add(p[0].try_cast("int") * 3600, p[1].try_cast("int") * 60), p[2].try_cast("int")))


def gtfs_text(seconds) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def weekday(ts) -> Column:
    return F.lower(F.date_format(ts, "EEEE"))


def day_seconds(ts) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def next_morning(ts, hour: int = 9, offset_hours: int = 3) -> Column:
    """The next time that it is `hour` o'clock at a fixed offset from UTC, in RFC 3339 and UTC."""
    local = ts + F.expr(f"INTERVAL {offset_hours} HOURS")
    at = F.date_trunc("day", local) + F.expr(f"INTERVAL {hour} HOURS")
    at = F.when(at > local, at).otherwise(at + F.expr("INTERVAL 1 DAY")) - F.expr(f"INTERVAL {offset_hours} HOURS")
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minutes_text(minutes) -> Column:
    """1h05m, 12m, or - for null; halves go to the even minute."""
    m = F.bround(minutes).cast("int")
    return F.coalesce(F.when(m >= 60, F.format_string("%dh%02dm", (m / 60).cast("int"), m % 60)).when(m.isNotNull(), F.format_string("%dm", m)), F.lit("-"))
