"""Intervals of a stream that close, and are corrected by what comes late.

Each batch adds its partial aggregates to a store by interval. An interval is closed, its details
written, once the watermark (the latest event time seen, less a delay) has passed its end. An event
of a closed interval is late: it is kept beside the others, goes to a side output too, and the
details of just the spans of intervals that late events touch are derived again, from partials, and replaced. So the
closed details always equal those of a batch over all that has arrived.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.functions import clock
from quaylog.operators import analysis, partials
from quaylog.sources.versions import Versions, file_system, replace_partitions

#: Intervals whose rows are one partition of the store, which is what late events have derived again.
SPAN = 24


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = file_system(spark, path)
    return fs.exists(at)


class IntervalStore:
    """The tables of one workload under ``root/workload``: partials, details and late events, by interval.

    ``minutes`` is the length of intervals, on a grid of whole lengths since ``anchor_s`` seconds after
    2000-01-01; ``delay`` is how far the watermark stays behind the latest event. ``span`` intervals are a partition.
    """

    def __init__(self, root: str, workload: str, minutes: int = 1, delay: str = "10 minutes", anchor_s: int = 0, span: int = SPAN):
        self.path, self.minutes, self.anchor_s = f"{root}/{workload}", minutes, anchor_s
        self.span = F.floor(F.col("interval_id") / F.lit(span * minutes * 60)).cast("long")
        self.delay_s = int(pd.Timedelta(delay).total_seconds())
        self.clock = Versions(f"{self.path}/clock")

    def _placed(self, batch: DataFrame) -> DataFrame:
        d = batch.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
        return d.withColumn("interval_id", clock.interval_end(F.col("start_time"), F.lit(self.anchor_s), self.minutes))

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch. One that is run again replaces what it wrote and starts from the same watermark.

        Events without a time belong to no interval and are left out, as those of no template are.
        """
        spark = batch.sparkSession
        batch = batch.where("start_time IS NOT NULL")
        held = self.clock.read(spark, number)
        was = held.first()["second"] if held is not None else None
        latest = batch.agg(F.max(clock.seconds(F.col("start_time").cast("timestamp_ntz")))).first()[0]
        known = [x for x in (was, None if latest is None else latest - self.delay_s) if x is not None]
        now = max(known) if known else None

        placed = self._placed(batch)
        replace_partitions(partials.partials(analysis.templated(placed)).withColumns({"span": self.span, "batch": F.lit(number)}), f"{self.path}/partials", "span", "batch")
        late = placed.where("false" if was is None else F.col("interval_id") <= was)
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        if now is not None and _there(spark, f"{self.path}/partials"):
            self._derive(spark, number, was, now)
        if now is not None:
            self.clock.write(spark.range(1).select(F.lit(now).cast("long").alias("second")), number)

    def _parts(self, spark: SparkSession) -> DataFrame:
        stored = spark.read.parquet(f"{self.path}/partials")
        return stored.withColumns({"span": F.col("span").cast("long"), "batch": F.col("batch").cast("long")})

    def _derive(self, spark: SparkSession, number: int, was: int | None, now: int) -> None:
        """Details of the spans in which the watermark has just passed an interval's end, or the batch added to a closed one."""
        closed = self._parts(spark).where(F.col("interval_id") <= now)
        newly = F.lit(True) if was is None else F.col("interval_id") > was
        touched = closed.where(newly | (F.col("batch") == number)).select("span").distinct()
        due = closed.join(touched, "span", "left_semi")
        replace_partitions(partials.details(partials.rolled_up(due, *partials.KEYS)).withColumn("span", self.span), f"{self.path}/details", "span")

    def stream(self, events: DataFrame, checkpoint: str, **trigger: Any):
        """Runs the store over a stream of events."""
        writer = events.writeStream.trigger(**trigger) if trigger else events.writeStream
        return writer.option("checkpointLocation", checkpoint).foreachBatch(self.add).start()

    def closed(self, spark: SparkSession) -> DataFrame:
        """Details of closed intervals, late events included."""
        return spark.read.parquet(f"{self.path}/details").drop("span")

    def all_details(self, spark: SparkSession) -> DataFrame:
        """Details of all intervals, those that are open as they stand."""
        return partials.details(partials.rolled_up(self._parts(spark), *partials.KEYS))

    def late(self, spark: SparkSession) -> DataFrame:
        """Events that came when their interval was closed, with the batch they came in."""
        return spark.read.parquet(f"{self.path}/late")

    def summary(self, spark: SparkSession) -> DataFrame:
        """By client names, over all that has arrived."""
        return partials.summary(self._parts(spark))

    def intervals(self, spark: SparkSession) -> DataFrame:
        """Closed intervals, and the marker of no length before the first."""
        return analysis.intervals(self.closed(spark), self.minutes)
