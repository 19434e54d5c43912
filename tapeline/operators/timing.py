"""From a publication time to a trading session, by an equi-join on the calendar day.

The bounded calendar is spread over all days between its first and last; each day knows the first session on or
after it and the first strictly after it. An event joins its own day: no range join, no as-of scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CUTOFF, OPEN = "18:40", "10:00"


def time_of_day(text: str) -> int:
    """Seconds since midnight of HH:MM or HH:MM:SS."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", text.strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise ValueError(f"not a time of day: {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


# How published times are written besides ISO; where both readings exist, the month comes first.
WRITTEN = [f"{day}{time}" for sep in "./-" for day in (f"M{sep}d{sep}yyyy", f"d{sep}M{sep}yyyy") for time in (" H:mm:ss", " H:mm", "")] + ["yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "yyyyMMdd"]


def mixed_datetime(c: Column) -> Column:
    """A timestamp without zone from texts of mixed formats; NULL where none fits."""
    t = F.trim(c)
    compact = t.rlike(r"^\d{8}$")  # a cast would take it for a year
    return F.coalesce(F.when(~compact, t.try_cast("timestamp_ntz")), *[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in WRITTEN])


def day_sessions(calendar: DataFrame, lead_days: int = 400) -> DataFrame:
    """(day, on_pos, ge_pos, gt_pos) of every day from ``lead_days`` before the first session to the last: bounded by the calendar."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a IS NOT NULL")
    days = span.select(F.explode(F.sequence(F.date_sub("a", lead_days), F.col("b"))).alias("day"))
    on = days.join(calendar, F.col("day") == F.col("date"), "left").select("day", F.col("pos").alias("on_pos"))
    later = W.orderBy("day")
    ge = F.first("on_pos", True).over(later.rowsBetween(0, W.unboundedFollowing))
    gt = F.first("on_pos", True).over(later.rowsBetween(1, W.unboundedFollowing))
    return on.select("day", "on_pos", ge.alias("ge_pos"), gt.alias("gt_pos"))


def assign_session(events: DataFrame, calendar: DataFrame, cutoff: str = CUTOFF, name: str = "t0") -> DataFrame:
    """Adds <name>_pos and <name>: the event's own day if it is a session and the time is strictly before the cutoff, else the next session.

    Publications before the calendar begins go to the first session; without a session or a time: NULL.
    """
    seconds = time_of_day(cutoff)
    days = F.broadcast(day_sessions(calendar))
    at = F.col("published_at")
    tod = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    first = F.broadcast(calendar.agg(F.min("date").alias("_first"), F.min("pos").alias("_first_pos")))
    joined = events.join(days, F.to_date(at) == F.col("day"), "left").join(first)
    own = F.col("on_pos").isNotNull() & (tod < seconds)
    pos = F.when(own, F.col("on_pos")).when(F.to_date(at) < F.col("_first"), F.coalesce(F.col("gt_pos"), F.col("_first_pos"))).otherwise(F.col("gt_pos"))
    out = joined.withColumn(f"{name}_pos", pos).drop("day", "on_pos", "ge_pos", "gt_pos", "_first", "_first_pos")
    dates = calendar.select(F.col("pos").alias(f"{name}_pos"), F.col("date").alias(name))
    return out.join(F.broadcast(dates), f"{name}_pos", "left")


def entry_session(events: DataFrame, calendar: DataFrame, mode: str = "next_open", cutoff: str = CUTOFF, open_time: str = OPEN) -> DataFrame:
    """Adds entry_pos: next_open (strictly before the opening: the same day), t0_close (t0), next_close (the session after t0)."""
    if mode == "next_open":
        return assign_session(events, calendar, open_time, "entry")
    out = assign_session(events, calendar, cutoff, "entry")
    if mode == "t0_close":
        return out
    if mode != "next_close":
        raise ValueError(mode)
    last = F.broadcast(calendar.agg(F.max("pos").alias("_last")))
    moved = out.drop("entry").join(last).withColumn("entry_pos", F.when(F.col("entry_pos") < F.col("_last"), F.col("entry_pos") + 1)).drop("_last")
    return moved.join(F.broadcast(calendar.select(F.col("pos").alias("entry_pos"), F.col("date").alias("entry"))), "entry_pos", "left")
