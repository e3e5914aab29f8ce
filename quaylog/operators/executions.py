"""Executions: starts matched with completions, prepared statements with their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylog.functions import sql_text

from .filters import COMPLETIONS, STARTS

METRICS = ("cpu", "duration", "reads", "writes")


#: Sequence numbers of one stretch of a session; as they count events, a stretch has no more rows.
STRETCH = 1 << 17
#: Milliseconds of a replay within which a worker's commands are ordered.
SPAN_MS = 600_000


def _carried(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``carry`` has for their keys, null keys included."""
    named = carry.withColumnsRenamed({k: f"{k}_of_carry" for k in keys})
    on = [rows[k].eqNullSafe(named[f"{k}_of_carry"]) for k in keys]
    return rows.join(named, on).drop(*(f"{k}_of_carry" for k in keys))


def pair_executions(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per starting event, with the metrics and text of its completion.

    A completion belongs to the latest earlier start of its session that is still open; with no
    duration, or none but zero, it leaves that start open. Completions without an open start
    are dropped, and starts without a completion keep null metrics.

    The stack is found without state: its depth is a running sum with a floor, and events at
    one depth alternate. Sums, floors and counts of one ``stretch`` of sequence numbers are carried to
    the next, so that a session of any length is spread over tasks; only the table of
    stretches is ordered by session.
    """
    start, closing = F.col("event_type").isin(*STARTS), F.coalesce("duration", F.lit(0)) != 0
    d = events.where(F.col("event_type").isin(*STARTS, *COMPLETIONS)).withColumn("_start", start)
    d = d.withColumn("_step", F.when(start, 1).when(closing, -1).otherwise(0))
    d = d.withColumn("_stretch", F.coalesce(F.floor(F.col("event_sequence") / F.lit(stretch)).cast("long"), F.lit(-(1 << 63))))
    inside = Window.partitionBy("session_id", "_stretch").orderBy("event_sequence")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_sum", F.sum("_step").over(running)).withColumn("_least", F.min("_sum").over(running))

    zero = F.lit(0).cast("long")
    earlier = Window.partitionBy("session_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = d.groupBy("session_id", "_stretch").agg(F.sum("_step").alias("_sum"), F.min("_sum").alias("_least"))
    carry = whole.withColumn("_sum_before", F.coalesce(F.sum("_sum").over(earlier), zero)).withColumn("_least", F.col("_sum_before") + F.col("_least"))
    carry = carry.select("session_id", "_stretch", "_sum_before", F.least(F.coalesce(F.min("_least").over(earlier), zero), zero).alias("_floor_before"))
    d = _carried(d, carry, ["session_id", "_stretch"])

    d = d.withColumn("_sum", F.col("_sum_before") + F.col("_sum")).withColumn("_floor", F.least("_floor_before", F.col("_sum_before") + F.col("_least")))
    d = d.withColumn("_before", F.coalesce(F.lag("_floor").over(inside), "_floor_before"))
    level = F.col("_sum") - F.col("_floor")
    orphan = (F.col("_step") == -1) & (F.col("_floor") < F.col("_before"))
    d = d.withColumn("_level", F.when(orphan, 0).when(F.col("_step") == -1, level + 1).otherwise(level)).where("_level > 0")
    at_level = Window.partitionBy("session_id", "_stretch", "_level").orderBy("event_sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_group", F.sum(F.col("_start").cast("long")).over(at_level))

    starts = d.groupBy("session_id", "_stretch", "_level").agg(F.sum(F.col("_start").cast("long")).alias("_starts"))
    earlier = Window.partitionBy("session_id", "_level").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("session_id", "_stretch", "_level", F.coalesce(F.sum("_starts").over(earlier), zero).alias("_starts_before"))
    d = _carried(d, starts, ["session_id", "_stretch", "_level"]).withColumn("_group", F.col("_starts_before") + F.col("_group"))

    names = [c for c in events.columns if c not in ("session_id", "sql_text", *METRICS)]
    first = F.min_by(F.struct(*names, "sql_text"), F.when(F.col("_start"), F.col("event_sequence")))
    last = F.max_by(F.struct("sql_text", *METRICS), F.when(~F.col("_start"), F.col("event_sequence")))
    paired = d.groupBy("session_id", "_level", "_group").agg(first.alias("s"), last.alias("c"))
    columns = {"session_id": F.col("session_id"), "sql_text": F.coalesce("c.sql_text", "s.sql_text")}
    columns |= {m: F.col(f"c.{m}") for m in METRICS} | {n: F.col(f"s.{n}") for n in names}
    return paired.select(*[columns[c].alias(c) for c in events.columns])


def _with_last(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Adds ``_last``: the last value that isn't null of the earlier rows of the keys.

    ``bucket`` is monotone in the order. A key's rows are ordered within a bucket only, and the
    last value of each is carried to the later ones, so that a key of any number of rows is spread
    over tasks.
    """
    given = F.col(value).isNotNull()
    ends = rows.groupBy(*keys, bucket).agg(F.max_by(value, F.when(given, F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, bucket, F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_last", F.last(value, ignorenulls=True).over(inside))
    return _carried(running, carry, [*keys, bucket]).withColumn("_last", F.coalesce("_last", "_before")).drop("_before")


def resolve_prepared(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds call_kind, handle, and the statement last prepared under it in the session.

    An unprepare call ends a handle; calls of handles that weren't prepared have a null statement.
    Statements are carried from one ``stretch`` of sequence numbers to the next.
    """
    d = events.withColumn("call_kind", sql_text.call_kind(F.col("sql_text"))).withColumn("handle", sql_text.call_handle(F.col("sql_text")))
    change = F.when(F.col("call_kind") == "SP_PREPARE", F.struct(sql_text.prepared_statement(F.col("sql_text")).alias("text"))).when(
        F.col("call_kind") == "SP_UNPREPARE", F.struct(F.lit(None).cast("string").alias("text"))
    )
    calls = d.where(F.col("handle").isNotNull()).withColumn("_change", change).withColumn("_stretch", F.floor(F.col("event_sequence") / F.lit(stretch)).cast("long"))
    known = _with_last(calls, ["session_id", "handle"], "_stretch", ["event_sequence"], "_change")
    calls = known.withColumn("statement", F.when(F.col("call_kind").isin("SP_EXECUTE", "SP_UNPREPARE"), F.col("_last.text")))
    return calls.drop("_change", "_stretch", "_last").unionByName(d.where(F.col("handle").isNull()).withColumn("statement", F.lit(None).cast("string")))


def replay_schedule(events: DataFrame, stress: bool = False, by_app: bool = False, span_ms: int = SPAN_MS) -> DataFrame:
    """When each starting command is due: offset from the first, worker, and wait after the
    worker's previous command (none after a connection reset). A worker's commands are ordered
    within ``span_ms``, and its last one is carried to the next span."""
    first = events.agg(F.min("start_time").alias("_first"))
    millis = F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("start_time")) / 1000
    d = events.where(F.col("event_type").isin(*STARTS)).join(F.broadcast(first))  # one row
    offset = F.lit(0.0) if stress else F.greatest(millis, F.lit(0.0))
    key = [F.col("session_id").cast("string"), F.coalesce("database_name", F.lit(""))] + ([F.coalesce("client_app_name", F.lit(""))] if by_app else [])
    d = d.withColumn("offset_ms", offset).withColumn("worker", F.concat_ws("_", *key)).withColumn("is_reset", F.coalesce(F.col("sql_text").contains("sp_reset_connection"), F.lit(False)))
    d = d.withColumn("_span", F.floor(millis / F.lit(span_ms)).cast("long")).withColumn("_sent", F.struct("is_reset", "offset_ms"))
    d = _with_last(d, ["worker"], "_span", ["start_time", "event_sequence"], "_sent")
    delay = F.when(F.col("_last.is_reset"), 0.0).otherwise(F.greatest(F.col("offset_ms") - F.col("_last.offset_ms"), F.lit(0.0)))
    return d.withColumn("delay_ms", F.coalesce(delay, F.lit(0.0))).select("event_sequence", "start_time", "worker", "sql_text", "offset_ms", "is_reset", "delay_ms")
