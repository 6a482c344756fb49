"""Validity windows, in local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Jerusalem"
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def local_parts(instant: Column, zone: str = ZONE) -> tuple[Column, Column, Column]:
    """(date, time of day to the minute, day of the week) as texts, of a UTC instant in a session whose zone is UTC."""
    local = F.from_utc_timestamp(instant, zone)
    return F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm"), F.lower(F.substring(F.date_format(local, "E"), 1, 3))


def window_active(w: Column, date: Column, time: Column, day: Column) -> Column:
    """Whether one window (struct) holds: dates inclusive, start inclusive, end exclusive, overnight if it starts after it ends; days count only if all are known. Missing parts do not limit."""
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    s, e, days = w["start_time"], w["end_time"], w["days"]
    from_ok = ~set_(w["valid_from"]) | (date >= w["valid_from"])
    until_ok = ~set_(w["valid_until"]) | (date <= w["valid_until"])
    known = F.coalesce((F.size(days) > 0) & F.forall(days, lambda d: F.coalesce(d.isin(*DAYS), F.lit(False))), F.lit(False))
    day_ok = ~known | F.array_contains(days, day)
    inside = F.when(s <= e, (time >= s) & (time < e)).otherwise((time >= s) | (time < e))
    return F.coalesce(from_ok & until_ok & day_ok & (~(set_(s) & set_(e)) | inside), F.lit(True))


def active(windows: Column, instant: Column, zone: str = ZONE) -> Column:
    """Whether any window holds at an instant; no windows hold always."""
    date, time, day = local_parts(instant, zone)
    return F.when(windows.isNull() | (F.size(windows) == 0), F.lit(True)).otherwise(F.exists(windows, lambda w: window_active(w, date, time, day)))
