"""Waits, disk and counters: from cumulative snapshots to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WAITS = ("wait_sec", "resource_sec", "signal_sec", "wait_count")
FILE_KEYS = ("database_name", "physical_filename", "logical_filename", "file_type", "volume_mount_point")
DISK = ("read_latency_ms", "reads", "read_bytes", "write_latency_ms", "writes", "write_bytes")

#: Categories by the start of a wait type's name, the longest start deciding; whole tables can
#: be given instead. Fixed values.
WAIT_CATEGORIES = {
    "LCK_": "Lock", "LATCH_": "Latch", "PAGELATCH_": "Buffer Latch", "PAGEIOLATCH_": "Buffer IO", "RESOURCE_SEMAPHORE": "Memory", "CXPACKET": "Parallelism", "EXCHANGE": "Parallelism",
    "ASYNC_NETWORK_IO": "Network IO", "SOS_SCHEDULER_YIELD": "CPU", "WRITELOG": "Tran Log IO",
}


def waits_snapshot(raw: DataFrame) -> DataFrame:
    """Cumulative waits in seconds by type, longest first, of raw milliseconds."""
    seconds = {"wait_sec": F.col("wait_time_ms"), "resource_sec": F.col("wait_time_ms") - F.col("signal_wait_time_ms"), "signal_sec": F.col("signal_wait_time_ms")}
    aggs = [F.round(F.max(v) / F.lit(1000).cast("decimal(20,0)"), 2).cast("decimal(16,2)").alias(k) for k, v in seconds.items()]
    return raw.groupBy("wait_type").agg(*aggs, F.max("waiting_tasks_count").alias("wait_count")).where("wait_sec > 0").orderBy(F.desc("wait_sec"), "wait_type")


def wait_deltas(snapshots: DataFrame) -> DataFrame:
    """Waits since the snapshot before, of ``snapshots(snapshot_no, wait_type, ...)``.

    The first snapshot gives zeros. Where the total count has fallen, counters were reset and
    the snapshot itself is given. Else only types of both snapshots that grew.
    """
    totals = snapshots.groupBy("snapshot_no").agg(F.sum("wait_count").alias("total"))
    order = Window.orderBy("snapshot_no")
    kinds = totals.select("snapshot_no", F.col("snapshot_no").alias("_no"), F.lag("snapshot_no").over(order).alias("previous_no"), (F.col("total") < F.lag("total").over(order)).alias("reset"))
    now = snapshots.join(kinds.drop("_no"), "snapshot_no")
    before = snapshots.select(F.col("snapshot_no").alias("previous_no"), "wait_type", *[F.col(c).alias(f"_{c}") for c in WAITS], F.lit(True).alias("_there"))
    joined = now.join(before, ["previous_no", "wait_type"], "left")
    plain = F.col("previous_no").isNotNull() & ~F.coalesce("reset", F.lit(False))
    delta = [F.when(F.col("previous_no").isNull(), F.col(c) * 0).when(plain, F.col(c) - F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in WAITS]
    grew = F.col("_there").isNotNull() & (F.col("wait_sec") - F.col("_wait_sec") > 0)
    return joined.where(~plain | grew).select("snapshot_no", "wait_type", *delta)


def disk_deltas(snapshots: DataFrame) -> DataFrame:
    """Disk activity since the snapshot before, and the cumulative values as cum_*."""
    order = Window.orderBy("snapshot_no")
    previous = snapshots.select("snapshot_no").distinct().withColumn("_previous", F.lag("snapshot_no").over(order))
    n, p = snapshots.join(previous, "snapshot_no").alias("n"), snapshots.alias("p")
    same = (F.col("n._previous") == F.col("p.snapshot_no")) & (F.col("n.physical_filename") == F.col("p.physical_filename"))
    for k in FILE_KEYS:
        if k != "physical_filename":
            same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}"))
    return n.join(p, same).select("n.snapshot_no", *[f"n.{k}" for k in FILE_KEYS], *[(F.col(f"n.{c}") - F.col(f"p.{c}")).alias(c) for c in DISK], *[F.col(f"n.{c}").alias(f"cum_{c}") for c in DISK])


def counter_ratio(counters: DataFrame) -> DataFrame:
    """(avg_cpu_percent): ratio counters over their base counters, summed over pools."""
    d = counters.select(*[F.rtrim(F.col(c)).alias(c) for c in ("object_name", "counter_name", "instance_name")], "cntr_value", "cntr_type").distinct()
    base = d.where(F.col("counter_name").endswith("base")).select("object_name", "instance_name", F.explode(F.array(F.regexp_replace("counter_name", " base", ""), F.regexp_replace("counter_name", " base", " (ms)"))).alias("counter_name"), F.col("cntr_value").alias("_base"))
    value = d.where(~F.col("counter_name").contains(" base") & F.col("object_name").endswith(":Resource Pool Stats")).join(base, ["object_name", "instance_name", "counter_name"], "left")
    share = F.when((F.col("cntr_type") == 537003264) & (F.col("_base") > 0), F.col("cntr_value") * 1.0 / F.col("_base") * 100).otherwise(F.col("cntr_value")).cast("float")
    return value.agg(F.sum(share).cast("int").alias("avg_cpu_percent"))


def cpu_recent(samples: DataFrame, minutes: int) -> DataFrame:
    """Each sample with the whole mean of the values of the last ``minutes`` before and with it.

    Values are added up by second, and seconds are cut into stretches as long as the reach, so that a reach is the end of one stretch
    and the beginning of the next: two running sums inside a stretch, of its seconds at most, whatever the number of
    samples. Nothing is taken off a sum, so what lies outside a reach leaves no rounding in it.
    """
    reach, second = minutes * 60, F.col("second")
    panes = samples.groupBy("server", "second").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    own = F.struct(second.alias("at"), F.col("total"), F.col("n"), F.lit(True).alias("own"))
    # where a second's reach begins it asks for what that stretch holds from there on
    asked = F.struct((second - reach).alias("at"), F.lit(None).cast(panes.schema["total"].dataType).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("own"))
    placed = panes.select("server", "second", F.explode(F.array_compact(F.array(own, F.when(second.isNotNull() & F.lit(reach > 0), asked)))).alias("x")).select("server", "second", "x.*")
    placed = placed.withColumn("stretch", F.col("at") - F.pmod("at", F.lit(max(reach, 1))))
    stretch = Window.partitionBy("server", "stretch")
    since, until = (stretch.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow) for order in ("at", F.desc("at")))
    sums = placed.select("server", "second", *[F.when(F.col("own"), F.sum(c).over(since)).otherwise(F.sum(c).over(until)).alias(c) for c in ("total", "n")])
    whole = sums.groupBy(F.col("server").alias("_server"), F.col("second").alias("_second")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.round(F.coalesce(F.col("total") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)), 6).cast("int")
    means = whole.select("_server", "_second", mean.alias("avg_cpu"))
    return samples.join(means, samples["server"].eqNullSafe(means["_server"]) & samples["second"].eqNullSafe(means["_second"])).drop("_server", "_second")


def wait_stats(waits: DataFrame) -> DataFrame:
    return waits.groupBy("interval_id", "wait_type").agg(*[F.sum(c).alias(c) for c in WAITS])


def disk_perf(d: DataFrame) -> DataFrame:
    averages, sums, most = ("read_latency_ms", "write_latency_ms"), ("reads", "read_bytes", "writes", "write_bytes"), [f"cum_{c}" for c in DISK]
    return d.groupBy("interval_id", *FILE_KEYS).agg(*[F.avg(c).alias(c) for c in averages], *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def performance_counters(c: DataFrame) -> DataFrame:
    return c.groupBy("interval_id", "name").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"))


def _one_each(rules: DataFrame, key: str) -> DataFrame:
    """Rules with one row for each key; a key that has two categories is an error when it is read."""
    clash = F.raise_error(F.concat(F.lit("two categories for "), F.col(key)))
    category = F.when(F.count_distinct("category") > 1, clash.cast("string")).otherwise(F.min("category"))
    return rules.where(F.col(key).isNotNull()).groupBy(key).agg(category.alias("category"))


def wait_categories(types: DataFrame, rules: DataFrame) -> DataFrame:
    """(wait_type, category) of each of ``types``: that of the longest ``rules(prefix, category)`` which its name begins with, or null.

    Each type, which are few, is spread to all its beginnings, so that the rules are met by an equal join, whatever their
    number; they may lie inside each other. The empty prefix is a rule for all names.
    """
    names = types.select("wait_type").where("wait_type IS NOT NULL").distinct()
    starts = names.select("wait_type", F.explode(F.sequence(F.lit(0), F.length("wait_type"))).alias("_length"))
    starts = starts.withColumn("prefix", F.expr("substring(wait_type, 1, _length)"))
    met = starts.join(_one_each(rules, "prefix"), "prefix", "left")
    return met.groupBy("wait_type").agg(F.max_by("category", F.when(F.col("category").isNotNull(), F.col("_length"))).alias("category"))


def wait_report(waits: DataFrame, intervals: DataFrame, categories: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Waits with interval end, elapsed minutes and category; times in milliseconds.

    ``categories(wait_type, category)`` names types one by one, ``rules(prefix, category)`` by the start of their names; the
    rules are WAIT_CATEGORIES where neither is given, and serve types that ``categories`` lacks where both are. One
    type has one category: a table that gives two for a key is an error, and one that repeats a row is not.
    """
    if rules is None and categories is None:
        rules = waits.sparkSession.createDataFrame(list(WAIT_CATEGORIES.items()), "prefix string, category string")
    d = waits.join(elapsed_minutes(intervals), "interval_id").withColumn("wait_category", F.lit(None).cast("string"))
    for table in ([_one_each(categories, "wait_type")] if categories is not None else []) + ([wait_categories(waits, rules)] if rules is not None else []):
        d = d.join(table, "wait_type", "left").withColumn("wait_category", F.coalesce("wait_category", "category")).drop("category")
    d = d.withColumn("wait_category", F.coalesce("wait_category", F.lit("<n/a>")))
    return d.select("interval_id", "end_time", "elapsed_minutes", "wait_type", "wait_category", *[(F.col(c) * 1000).alias(c.replace("_sec", "_ms")) for c in WAITS[:3]], "wait_count")


def counter_report(counters: DataFrame, intervals: DataFrame) -> DataFrame:
    return counters.join(elapsed_minutes(intervals), "interval_id").select("interval_id", "end_time", "elapsed_minutes", "name", "min_value", "max_value", "avg_value")


def elapsed_minutes(intervals: DataFrame) -> DataFrame:
    """Intervals with the running total of their lengths; the table has a row per interval only."""
    running = Window.orderBy("end_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return intervals.withColumn("elapsed_minutes", F.sum("duration_minutes").over(running))
