"""Continuous capture and analysis with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaylog.functions import clock, sql_text
from quaylog.operators import analysis, executions, metrics
from quaylog.operators.executions import METRICS
from quaylog.operators.filters import COMPLETIONS, STARTS
from quaylog.sources.versions import Versions

from .ledger import Ledger

EVENT_SCHEMA = (
    "event_sequence long, event_type int, start_time timestamp, client_app_name string, client_host_name string, database_name string, "
    "server_principal_name string, session_id int, sql_text string, cpu long, duration long, reads long, writes long"
)


def stream_capture(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, **options: str) -> DataFrame:
    """New files of a capture as a stream; a Kafka topic's JSON events if ``path`` is 'kafka'."""
    if path == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    return spark.readStream.schema(schema).options(**options).parquet(path)


def resume_capture(events: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Takes in each event once, also when the checkpoint is lost; ``Ledger(path).events`` reads them."""
    return Ledger(path).stream(events, checkpoint, **trigger)


def recent_cpu(samples: DataFrame, minutes: int, slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """(server, end_time, samples, avg_cpu) of ``samples(server, ts, value)``: the whole mean of the values of the last
    ``minutes`` before each end of ``slide``, once it is closed; ends without a sample in reach have no row.

    Samples are added up by ``slide`` first, so that a sample is counted once and not for each window over it. Late samples beyond
    ``delay`` are left out. Over a table that doesn't stream it gives all ends.
    """
    d = samples.where("ts IS NOT NULL")
    if samples.isStreaming:
        d = d.withWatermark("ts", delay)
    panes = d.groupBy("server", F.window("ts", slide).alias("pane")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    over = panes.groupBy("server", F.window(F.window_time("pane"), f"{minutes} minutes", slide).alias("w")).agg(F.sum("total").alias("total"), F.sum("n").alias("samples"))
    mean = F.coalesce(F.round(F.col("total") / F.when(F.col("samples") > 0, F.col("samples")), 6), F.lit(0.0)).cast("int")
    return over.select("server", F.col("w.end").alias("end_time"), "samples", mean.alias("avg_cpu"))


def dedup_resume(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once each, by session and sequence; with a checkpoint also across restarts."""
    return events.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["session_id", "event_sequence"])


def details_by_window(events: DataFrame, minutes: int = 1, delay: str | None = "10 minutes", anchor: str = "0 seconds") -> DataFrame:
    """Facts by closed interval; late events beyond ``delay`` are left out.

    None: ``events`` have a watermark already, as those of ``dedup_resume``.
    """
    d = sql_text.normalize_sql(events.where(F.coalesce(F.length("sql_text"), F.lit(0)) > 0)).where("template IS NOT NULL").withColumn("sql_hash", sql_text.sql_hash(F.col("template")))
    if events.isStreaming and delay:
        d = d.withWatermark("start_time", delay)
    aggs = [x for m in METRICS for x in (F.expr(f"cast(avg({m}) as long)").alias(f"avg_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"), F.coalesce(F.sum(m), F.lit(0)).alias(f"sum_{m}"))]
    keys = [F.col(c).alias(n) for n, c in analysis.DIMS.items()]
    grouped = d.groupBy(F.window("start_time", f"{minutes} minutes", startTime=anchor).alias("w"), "sql_hash", *keys).agg(*aggs, F.count("*").alias("execution_count"))
    return grouped.withColumn("interval_end", F.col("w.end")).drop("w")


def _triggered(writer, trigger: dict[str, Any]):
    return writer.trigger(**trigger) if trigger else writer


def save_details(batch: DataFrame, number: int, root: str, workload: str) -> None:
    """A batch of closed intervals under its own number: one that is run again replaces itself."""
    batch.withColumn("interval_id", clock.seconds(F.col("interval_end").cast("timestamp_ntz"))).write.mode("overwrite").parquet(f"{root}/{workload}/details/batch={number}")


def write_details(details: DataFrame, root: str, workload: str, checkpoint: str, **trigger: Any):
    """Writes closed intervals batch by batch, each once; ``read_details`` reads them."""
    save = lambda batch, number: save_details(batch, number, root, workload)
    return _triggered(details.writeStream.outputMode("append"), trigger).option("checkpointLocation", checkpoint).foreachBatch(save).start()


def read_details(spark: SparkSession, root: str, workload: str, minutes: int) -> tuple[DataFrame, DataFrame]:
    """(details, intervals) that ``write_details`` has closed; intervals with the marker of no length."""
    details = spark.read.parquet(f"{root}/{workload}/details").drop("batch")
    return details, analysis.intervals(details, minutes)


def pair_stream(events: DataFrame, timeout: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Completed executions as they complete: a stack of open starts is kept for each session.

    A session's open starts are given out without metrics when it has been silent for
    ``timeout`` of event time. Within a batch events are taken in sequence. A session's events of
    one batch are held by one task: bound the batches (``maxFilesPerTrigger``), or take
    ``stream_executions``, which has no such limit.
    """
    out = T.StructType([f for f in events.schema if f.name in _KEPT])
    columns = [f.name for f in out]
    state = T.StructType([T.StructField("open", T.StringType())])
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: Any, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        import json

        stack = json.loads(held.get[0]) if held.exists else []
        done = []
        if held.hasTimedOut:
            done, stack = stack, []
            held.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("event_sequence")
            latest = int(rows["start_time"].max().timestamp() * 1000)
            for row in rows.to_dict("records"):
                row = {c: None if pd.isna(row[c]) else row[c] for c in columns}
                row["start_time"] = str(row["start_time"])
                if row["event_type"] in STARTS:
                    stack.append(row)
                elif row["event_type"] in COMPLETIONS and stack:
                    stack[-1] |= {c: row[c] for c in (*METRICS, "sql_text")}
                    if row["duration"]:
                        done.append(stack.pop())
            held.update((json.dumps(stack, default=float),))
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), latest) + millis)
        if done:
            frame = pd.DataFrame(done, columns=columns)
            frame["start_time"] = pd.to_datetime(frame["start_time"])
            for f in out:
                if f.dataType in (T.LongType(), T.IntegerType()):
                    frame[f.name] = frame[f.name].astype("Int64" if f.dataType == T.LongType() else "Int32")
            yield frame

    return events.withWatermark("start_time", delay).groupBy("session_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


_KEPT = ("event_sequence", "event_type", "start_time", "client_app_name", "client_host_name", "database_name", "server_principal_name", "session_id", "sql_text", *METRICS)


def stream_executions(events: DataFrame, path: str, checkpoint: str, timeout: str = "30 minutes", delay: str = "10 minutes", **trigger: Any):
    """Pairs each batch whole, with the starts that the batches before left open; ``read_executions`` reads the result.

    A batch is ordered and paired by Spark, so a session needs no task's memory. A session's open
    starts are given out, with what metrics they have, when it has been silent for ``timeout`` beyond
    ``delay`` of event time; no event is left out for being late. A batch that is run again starts
    from the same versions.
    """
    table, clocks = Versions(f"{path}/paired"), Versions(f"{path}/clock")
    columns = [f.name for f in events.schema if f.name in _KEPT]
    silent, late = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (timeout, delay))
    held = F.struct("sql_text", *METRICS)
    micros = F.unix_micros(F.col("start_time").cast("timestamp"))

    def pair(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, before = table.read(spark, number), clocks.read(spark, number)
        was = before.first()[0] if before is not None else None
        now = max((x for x in (was, batch.agg(F.max(micros)).first()[0]) if x is not None), default=None)
        seen = batch.groupBy(F.col("session_id").alias("_session")).agg(F.greatest(F.max(micros), F.lit(was - late if was is not None else None).cast("long")).alias("_now"))
        new = batch.select(*columns).withColumn("_held", F.lit(None).cast(batch.select(held.alias("h")).schema["h"].dataType)).withColumn("_seen", F.lit(None).cast("long"))
        if old is not None:
            # an open start comes back as it was, what completions have said of it so far beside it
            opened = old.where("NOT _done").withColumns({"sql_text": F.col("_text"), **{m: F.lit(None).cast(batch.schema[m].dataType) for m in METRICS}})
            new = new.unionByName(opened.select(new.columns))
        paired = executions.pair_executions(new.withColumn("_text", F.col("sql_text")))
        paired = paired.withColumn("_held", F.when(F.coalesce(*METRICS).isNotNull(), held).otherwise(F.col("_held")))
        paired = paired.withColumns({c: F.coalesce(F.col(f"_held.{c}"), F.col(c)) for c in ("sql_text", *METRICS)})
        paired = paired.join(seen, F.col("session_id").eqNullSafe(F.col("_session")), "left").withColumn("_seen", F.greatest("_seen", "_now")).drop("_now", "_session")
        over = F.col("_seen") + silent < F.lit(now - late if now is not None else None).cast("long")
        table.write(paired.withColumn("_done", (F.coalesce("duration", F.lit(0)) != 0) | F.coalesce(over, F.lit(False))), number)
        # what is given out stays; of versions only those that a batch may start from do
        done = spark.read.parquet(f"{table.path}/v={number}").where("_done")
        done.select([c for c in done.columns if c in _KEPT]).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        clocks.write(spark.range(1).select(F.lit(now).cast("long").alias("micros")), number)

    return _triggered(events.writeStream, trigger).option("checkpointLocation", checkpoint).foreachBatch(pair).start()


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_executions`` has given out."""
    return spark.read.parquet(f"{path}/done").drop("batch")


def stream_summary(events: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """A running summary: every batch's is merged into the version before it; ``read_summary`` reads the newest.

    A batch that is run again starts from the same version, so nothing is counted twice.
    """
    table = Versions(path)

    def merge(batch: DataFrame, number: int) -> None:
        new = analysis.workload_summary(batch)
        old = table.read(batch.sparkSession, number)
        table.write(new if old is None else analysis.merge_summary(old, new), number)

    return _triggered(events.writeStream, trigger).option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    return Versions(path).read(spark)


class WaitDeltas:
    """Deltas of snapshots that arrive in parts, under ``path``.

    The newest snapshot is held open until a row of a later one arrives, since more of its rows may come;
    snapshots come in the order of their numbers. What is kept between batches is the last snapshot that is
    closed, which the next one is measured against, and all rows of the open one. Rows of a closed snapshot are too late
    and go to ``late``. A batch that is run again starts from the same state.
    """

    def __init__(self, path: str):
        self.path, self.held = path, Versions(f"{path}/held")

    def add(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = self.held.read(spark, number)
        closed = None if old is None else old.agg(F.max(F.when(F.col("_closed"), F.col("snapshot_no")))).first()[0]
        here = batch.where("snapshot_no IS NOT NULL")
        here.where("false" if closed is None else F.col("snapshot_no") <= closed).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        new = here if closed is None else here.where(F.col("snapshot_no") > closed)
        both = new if old is None else old.drop("_closed").unionByName(new)
        newest = both.agg(F.max("snapshot_no")).first()[0]
        self._deltas(both.where(F.col("snapshot_no") < F.lit(newest)), closed).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={number}")
        # of the snapshots before the newest only the last is needed
        last = both.where(F.col("snapshot_no") < F.lit(newest)).agg(F.max("snapshot_no").alias("_last"))
        kept = both.join(F.broadcast(last)).where(F.coalesce(F.col("snapshot_no") >= F.col("_last"), F.lit(True)))  # one row
        self.held.write(kept.withColumn("_closed", F.col("snapshot_no") < F.lit(newest)).drop("_last"), number)

    @staticmethod
    def _deltas(snapshots: DataFrame, closed: int | None) -> DataFrame:
        deltas = metrics.wait_deltas(snapshots)
        return deltas if closed is None else deltas.where(F.col("snapshot_no") > closed)

    def stream(self, snapshots: DataFrame, checkpoint: str, **trigger: Any):
        return _triggered(snapshots.writeStream, trigger).option("checkpointLocation", checkpoint).foreachBatch(self.add).start()

    def read(self, spark: SparkSession, open_too: bool = False) -> DataFrame:
        """Deltas of closed snapshots; ``open_too``: and those of the open one as it stands, as at the end of a capture."""
        done = spark.read.parquet(f"{self.path}/deltas").drop("batch")
        if not open_too or (held := self.held.read(spark)) is None:
            return done
        closed = held.agg(F.max(F.when(F.col("_closed"), F.col("snapshot_no")))).first()[0]
        return done.unionByName(self._deltas(held.drop("_closed"), closed))

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/late")


def stream_wait_deltas(snapshots: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Deltas of each new snapshot against the one before, once it is complete; ``WaitDeltas`` reads them."""
    return WaitDeltas(path).stream(snapshots, checkpoint, **trigger)
