"""Intervals and offsets. Capture times have no zone; whole seconds count from 2000-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"


def seconds(time: Column) -> Column:
    """Whole seconds since 2000-01-01."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), time)


def from_seconds(s: Column) -> Column:
    return F.timestamp_add("SECOND", s.cast("int"), F.expr(EPOCH))


def interval_end(time: Column, anchor_s: Column, minutes: int) -> Column:
    """Second at which the interval of ``time`` ends, on a grid that begins at ``anchor_s``."""
    length = minutes * 60
    return (anchor_s + (F.floor((seconds(time) - anchor_s) / length) + 1) * length).cast("long")


def offset_minutes(begin: Column, end: Column) -> Column:
    """Minute boundaries crossed between two times."""
    return ((seconds(F.date_trunc("minute", end)) - seconds(F.date_trunc("minute", begin))) / 60).cast("long")
