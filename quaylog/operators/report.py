"""Reports: points of the analysis, series over time, comparison of two workloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylog.functions import clock
from quaylog.sources.scratch import written

from .analysis import DIMS
from .executions import METRICS
from .metrics import elapsed_minutes

NAMES = list(DIMS)
MEASURES = ("sum_duration_us", "avg_duration_us", "sum_cpu_us", "avg_cpu_us", "sum_reads", "avg_reads", "execution_count")


def first_interval(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.min_by("end_time", "interval_id").alias("first_end"))


def points(details: DataFrame, intervals: DataFrame) -> DataFrame:
    """Facts with minutes since the first interval and their interval's length.

    Facts whose names aren't all known have no point. Texts are joined after aggregation.
    """
    known = details.where(" AND ".join(f"{n} IS NOT NULL" for n in NAMES))
    d = known.join(intervals, "interval_id").join(F.broadcast(first_interval(intervals)))  # one row
    return d.withColumn("event_offset", clock.offset_minutes(F.col("first_end"), F.col("end_time"))).drop("first_end", "end_time")


def workload_data(details: DataFrame, intervals: DataFrame, queries: DataFrame) -> DataFrame:
    known = details.where(" AND ".join(f"{n} IS NOT NULL" for n in NAMES))
    return known.join(elapsed_minutes(intervals), "interval_id").join(queries.select("sql_hash", "normalized_text"), "sql_hash")


def choose_preaggregation(intervals: DataFrame) -> DataFrame:
    n = F.count("*")
    return intervals.where("duration_minutes > 0").agg(n.alias("interval_count"), F.when(n > 2000, 60).when(n > 1000, 30).when(n > 500, 15).otherwise(1).alias("preaggregation"))


def preaggregate(pts: DataFrame, minutes: int) -> DataFrame:
    """Points in buckets of offsets: averages of averages (whole), least, most and totals."""
    aggs = [x for m in METRICS for x in (F.expr(f"cast(avg(avg_{m}) as long)").alias(f"avg_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"))]
    bucket = F.expr(f"(event_offset div {minutes}) * {minutes}").alias("event_offset")
    return pts.groupBy(bucket, (F.col("duration_minutes") % minutes).alias("interval_duration"), "sql_hash", *NAMES).agg(*aggs, F.sum("execution_count").alias("execution_count"))


def query_totals(pts: DataFrame) -> DataFrame:
    """By template: totals, and means of the points' averages."""
    return pts.groupBy("sql_hash").agg(
        F.sum("sum_duration").alias("sum_duration_us"), F.round(F.avg("avg_duration"), 6).alias("avg_duration_us"), F.sum("sum_cpu").alias("sum_cpu_us"), F.round(F.avg("avg_cpu"), 6).alias("avg_cpu_us"),
        F.sum("sum_reads").alias("sum_reads"), F.round(F.avg("avg_reads"), 6).alias("avg_reads"), F.sum("execution_count").alias("execution_count"),
    )


def top_queries(totals: DataFrame, by: str = "sum_duration_us", n: int | None = None) -> DataFrame:
    ordered = totals.orderBy(F.desc(by), "sql_hash")
    return ordered.limit(n) if n else ordered


def series(pts: DataFrame, metric: str) -> DataFrame:
    return pts.groupBy("event_offset").agg(F.sum(f"sum_{metric}").alias("total")).orderBy("event_offset")


def series_batches(pts: DataFrame) -> DataFrame:
    """Batches a second by offset; each point's count is divided whole."""
    each = F.expr("execution_count div (if(duration_minutes = 0, 1, duration_minutes) * 60)")
    return pts.groupBy("event_offset").agg(F.sum(each).alias("batches_per_second")).orderBy("event_offset")


def series_time_axis(s: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """A series with the time of each offset after the first interval's end, ``at_time``.

    Without ``first``, as where two workloads of different dates are compared, the axis is the offset itself,
    in minutes: ``at_offset``.
    """
    if first is None:
        return s.withColumn("at_offset", F.col("event_offset").cast("double"))
    return s.join(F.broadcast(first)).withColumn("at_time", F.timestamp_add("MINUTE", F.col("event_offset").cast("int"), F.col("first_end"))).drop("first_end")  # one row


def query_series(pts: DataFrame, sql_hash: int) -> DataFrame:
    return pts.where(F.col("sql_hash") == sql_hash).groupBy("event_offset").agg(F.round(F.avg("avg_duration"), 6).alias("avg_duration_us")).orderBy("event_offset")


def distinct_dimensions(base: DataFrame, bench: DataFrame) -> DataFrame:
    """(kind, name): names of either workload, sorted."""
    both = base.select(*NAMES).unionByName(bench.select(*NAMES))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("name")) for n in NAMES])).alias("x")
    return both.select(pairs).select("x.kind", "x.name").where("name IS NOT NULL").distinct().orderBy("kind", "name")


def compare_queries(base: DataFrame, bench: DataFrame) -> DataFrame:
    """Totals by template of both workloads side by side, and the change.

    A template of the benchmark alone shows its numbers in the first columns, with zeros for the
    second and for the change; ``side`` tells them apart.
    """
    b, k = base.alias("b"), bench.alias("k")
    joined = b.join(k, F.col("b.sql_hash") == F.col("k.sql_hash"), "full_outer")
    only = F.col("b.sql_hash").isNull()
    matched = ~only & F.col("k.sql_hash").isNotNull()
    columns = [F.coalesce("b.sql_hash", "k.sql_hash").alias("sql_hash"), F.when(only, "benchmark").otherwise("baseline").alias("side")]
    for m in MEASURES:
        zero = F.lit(0).cast(base.schema[m].dataType)
        columns += [
            F.when(only, F.col(f"k.{m}")).otherwise(F.col(f"b.{m}")).alias(m),
            F.when(matched, F.col(f"k.{m}")).otherwise(zero).alias(f"{m}2"),
            F.when(matched, F.col(f"k.{m}") - F.col(f"b.{m}")).otherwise(zero).alias(f"diff_{m}"),
        ]
    return joined.select(*columns)


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every pair of rows of a key, and rows without partner with defaults for the other side.

    Null keys are equal to each other. A default stands for an absent partner only: what a row
    that is there holds, null included, stays.
    """
    here, there = left.withColumn("_here", F.lit(True)).alias("l"), right.withColumn("_there", F.lit(True)).alias("r")
    joined = here.join(there, _same_keys("l", "r", keys), "full_outer")
    return _with_defaults(joined, left, right, keys, defaults)


def _same_keys(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _with_defaults(joined: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Columns of a join of ``l`` and ``r``, whose flags ``_here`` and ``_there`` tell which side is present."""
    out = [F.when(F.col("_here"), F.col(f"l.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys]
    for side, flag, df in (("l", "_here", left), ("r", "_there", right)):
        for c in df.columns:
            if c not in keys:
                absent = F.lit(defaults.get(c)).cast(df.schema[c].dataType)
                out.append(F.when(F.col(flag), F.col(f"{side}.{c}")).otherwise(absent).alias(c))
    return joined.select(*out)


#: Rows of a key on one side from which it is dealt to several tasks; at most MOST_HOT keys of a side are.
HOT_ROWS, MOST_HOT = 1_000_000, 10_000


def full_outer_salted(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``full_outer`` for keys that may hold a large part of the rows of either side, or of both.

    A hot key is dealt in a grid: its left rows to L parts and its right rows to R, as many as ``hot_rows``
    go into them, and each row is copied to the parts of the other side, so that two rows of the key meet in exactly one
    cell. Whether a key has partners at all is told by the tables of keys, so a row without partner comes
    once, however its key is dealt. Both sides are written first: rows that are dealt by their place must not move when
    a task runs again. Hot are keys of more than ``hot_rows`` rows or, if that is more, a 10,000th of the side's.
    """
    left, right = written(left, "left"), written(right, "right")

    def counted(df: DataFrame) -> tuple[DataFrame, int]:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        return counts, max(hot_rows, (df.count() or 0) // MOST_HOT)

    (lefts, l_most), (rights, r_most) = counted(left), counted(right)
    # keys that are hot on a side, with the parts of both, null where a side lacks the key; at most MOST_HOT keys from each side
    sizes = full_outer(lefts.withColumnRenamed("_rows", "_l"), rights.withColumnRenamed("_rows", "_r"), keys, {})
    parts = lambda c, most: F.ceil(F.col(c) / F.lit(most)).cast("int")
    hot = sizes.where(F.coalesce(F.col("_l") > l_most, F.lit(False)) | F.coalesce(F.col("_r") > r_most, F.lit(False)))
    hot = F.broadcast(written(hot.select(*keys, parts("_l", l_most).alias("_l"), parts("_r", r_most).alias("_r"), F.lit(True).alias("_hot")), "hot"))

    def tagged(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.alias("x").join(hot.alias("h"), _same_keys("x", "h", keys), "left").select("x.*", F.col(own).alias("_own"), F.col(other).alias("_other"), F.coalesce("_hot", F.lit(False)).alias("_hot"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1)
        placed = df.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.coalesce("_own", one)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce("_other", one) - 1))).drop("_own", "_other", "_hot")

    def alone(df: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of keys that the other side lacks; of hot keys that is known."""
        cold = df.where("NOT _hot").alias("x").join(others.alias("o"), _same_keys("x", "o", keys), "left_anti")
        return cold.unionByName(df.where("_hot AND _other IS NULL"))

    def filled(df: DataFrame, present: bool) -> list[Column]:
        return [F.col(c) if present else F.lit(defaults.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns if c not in keys]

    l_tagged, r_tagged = tagged(left, "_l", "_r"), tagged(right, "_r", "_l")
    here = dealt(l_tagged, "_i", "_j").withColumn("_here", F.lit(True)).alias("l")
    there = dealt(r_tagged, "_j", "_i").withColumn("_there", F.lit(True)).alias("r")
    matched = here.join(there, _same_keys("l", "r", keys) & (F.col("l._i") == F.col("r._i")) & (F.col("l._j") == F.col("r._j")))
    left_only = alone(l_tagged, rights).select(*keys, *filled(left, True), *filled(right, False))
    right_only = alone(r_tagged, lefts).select(*keys, *filled(left, False), *filled(right, True))
    return _with_defaults(matched, left, right, keys, defaults).unionByName(left_only).unionByName(right_only)


def compare_query_dims(base: DataFrame, bench: DataFrame, sql_hash: int) -> DataFrame:
    """For one template, totals of both workloads by application, database, host and login."""

    def side(pts: DataFrame, suffix: str) -> DataFrame:
        aggs = [F.sum(f"sum_{m}").alias(f"sum_{m}{suffix}") for m in METRICS] + [F.round(F.avg(f"avg_{m}"), 6).alias(f"avg_{m}{suffix}") for m in METRICS]
        return pts.where(F.col("sql_hash") == sql_hash).groupBy(*NAMES).agg(*aggs, F.sum("execution_count").alias(f"execution_count{suffix}"))

    a, b = side(base, ""), side(bench, "2")
    joined = full_outer(a, b, NAMES, {})
    return joined.select(*NAMES, *[F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) for f in joined.schema if f.name not in NAMES])


ORDER = ("start_time", "event_sequence")


def ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy(*ORDER)


def write_ordered(events: DataFrame, path: str) -> None:
    """Events as files that follow each other: each holds a range of the order, and its rows in order.

    The ranges are cut by a sample of the rows, so files are of much the same size however times are spread.
    """
    ordered_events(events).write.mode("overwrite").parquet(path)


def order_faults(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, events, inside, between) of what ``write_ordered`` wrote: rows that come after a later one in
    their file, and files that begin before what the files before them hold. Nulls come first, as they are written.

    Only the table of files, a row each, is put in one order.
    """
    place = F.struct(*ORDER)
    rows = spark.read.parquet(path).select(place.alias("place"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("place").over(Window.partitionBy("file").orderBy("row"))
    files = rows.withColumn("_fault", F.coalesce(before > F.col("place"), F.lit(False)).cast("long")).groupBy("file").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.count("*").alias("events"), F.sum("_fault").alias("inside"))
    reached = F.max("most").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    checked = files.withColumn("_fault", F.coalesce(reached > F.col("least"), F.lit(False)).cast("long"))
    zero = F.lit(0).cast("long")
    return checked.agg(F.count("*").alias("files"), F.coalesce(F.sum("events"), zero).alias("events"), F.coalesce(F.sum("inside"), zero).alias("inside"), F.coalesce(F.sum("_fault"), zero).alias("between"))


def top_waits(waits: DataFrame, n: int | None = None) -> DataFrame:
    ordered = waits.orderBy(F.desc("wait_sec"), "wait_type", *(c for c in ("snapshot_no", "interval_id") if c in waits.columns))
    return ordered.limit(n) if n else ordered


