"""Registered queries that go through a store or a stream, and their SQL.

Each writes what it needs to a scratch folder and returns what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.operators import analysis, report, templates
from quaylog.sources import parsers, stores
from quaylog.sources.scratch import scratch, written
from quaylog.streaming import jobs
from quaylog.streaming.interval_store import IntervalStore
from quaylog.streaming.ledger import Ledger

from . import queries as plans
from .queries import _CAP_COLUMNS, _query, _with

NOW = {"availableNow": True}


def _stream(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """The adapter's events, written once and read as a stream."""
    path = scratch(spark, "arriving")
    e = plans.events(spark, sf_dir).withColumn("start_time", F.col("start_time").cast("timestamp"))
    for _ in range(copies):
        e.write.mode("append").parquet(path)
    return jobs.stream_capture(spark, path)


def _appended(df: DataFrame) -> DataFrame:
    """What a stream appends by the time all that has arrived is read."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "appended")
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").option("path", path)
    writer.trigger(**NOW).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _local(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


@_query("write_capture", _with(f"SELECT {_CAP_COLUMNS}, true AS ids_dense FROM cap"))
def _(s, d):
    """Two appends of half the events each; whether their ids are 1 to n is told beside each row."""
    path, e = scratch(s, "capture"), plans.events(s, d)
    for half in ("event_type > 0", "event_type < 0"):
        stores.write_capture({"events": e.where(half)}, path)
    back = stores.read_capture(s, path)["events"]
    dense = back.agg(((F.min("row_id") == 1) & (F.max("row_id") == F.count("*")) & (F.count_distinct("row_id") == F.count("*"))).alias("ids_dense"))
    return back.join(F.broadcast(dense)).select(*plans.adapter.CAPTURE, "ids_dense")  # one row


_CHILD = "event_sequence % 50 = 0"


@_query("read_capture", _with(f"""SELECT {_CAP_COLUMNS}, CASE WHEN {_CHILD} THEN session_id::DOUBLE END AS cpu_counter, CASE WHEN {_CHILD} THEN 2 END AS waits, CASE WHEN {_CHILD} THEN 'WAIT_' || session_id END AS first_wait,
   CASE WHEN {_CHILD} THEN session_id * 3 END::BIGINT AS disk_reads FROM cap"""))
def _(s, d):
    """A capture with counters, waits and disk rows of some events, written and read."""
    path, e = scratch(s, "capture"), plans.events(s, d).withColumn("row_id", F.col("event_sequence"))
    some = e.where(_CHILD)
    counters = some.select("row_id", F.explode(F.array(F.lit("AVG_CPU_USAGE"), F.lit("OTHER"))).alias("name"), F.col("session_id").cast("double").alias("value"))
    waits = some.select("row_id", F.explode(F.array(F.lit("WAIT_"), F.lit("X_"))).alias("kind"), "session_id").select("row_id", F.concat("kind", "session_id").alias("wait_type"))
    stores.write_capture({"events": e, "counters": counters, "waits": waits, "disk_perf": some.select("row_id", (F.col("session_id") * 3).cast("long").alias("reads"))}, path)
    back = stores.read_capture(s, path)["events"]
    return back.select(*plans.adapter.CAPTURE, F.col("counters")["AVG_CPU_USAGE"].alias("cpu_counter"), F.when(F.col("waits").isNotNull(), F.size("waits")).alias("waits"), F.col("waits")[0]["wait_type"].alias("first_wait"), F.col("disk_perf")[0]["reads"].alias("disk_reads"))


@_query("convert_capture", _with(f"SELECT {_CAP_COLUMNS} FROM cap WHERE lower(client_app_name) = 'app_click'"))
def _(s, d):
    """XML of the events as a capture, filtered by application, and read back."""
    path = scratch(s, "converted")
    stores.convert_capture(plans.xe_documents(plans.events(s, d)), path, "xe", app=["app_click"])
    return stores.read_capture(s, path)["events"].select(*plans.adapter.CAPTURE)


@_query("read_analysis", _with("SELECT (SELECT count(*) FROM intervals WHERE duration_minutes > 0) AS real_intervals, (SELECT min_by(end_time, interval_id) FROM intervals) AS first_end", plans._ALL))
def _(s, d):
    root, details = scratch(s, "analysis"), plans._analysis(s, d)[0]
    stores.write_analysis({"details": details}, root, "w")
    back = stores.read_analysis(s, root, "w")["details"]
    stores.write_analysis({"intervals": analysis.intervals(back, plans.MINUTES)}, root, "w")
    return stores.analysis_facts(stores.read_analysis(s, root, "w"))


@_query("write_analysis", _with(f"SELECT d.*, q.normalized_text, i.duration_minutes FROM details d JOIN ({plans._QUERIES_SQL}) q USING (sql_hash) JOIN intervals i USING (interval_id)", plans._ALL))
def _(s, d):
    """Facts written in two parts, the first of them twice, with their intervals and templates each time."""
    root, x = scratch(s, "analysis"), written(plans.execs(s, d), "executions")
    details, queries = written(analysis.workload_details(x), "details"), written(analysis.normalized_queries(x), "queries")
    for part in ("interval_id % 7200 = 0", "interval_id % 7200 <> 0", "interval_id % 7200 = 0"):
        facts = details.where(part)
        stores.write_analysis({"details": facts, "intervals": analysis.intervals(facts, plans.MINUTES).where("duration_minutes > 0"), "queries": queries.join(facts, "sql_hash", "left_semi")}, root, "w")
    back = stores.read_analysis(s, root, "w")
    return back["details"].join(back["queries"].select("sql_hash", "normalized_text"), "sql_hash").join(back["intervals"].select("interval_id", "duration_minutes"), "interval_id").select(*details.columns, "normalized_text", "duration_minutes")


@_query("check_format", _with("SELECT true AS accepted, false AS without_sequence, false AS without_session, count(*) AS total FROM cap"))
def _(s, d):
    trace = plans.trace_rows(plans.events(s, d))
    without = {c: parsers.check_trace_format(trace.withColumn(c, F.lit(None).cast("long"))) for c in ("EventSequence", "SPID")}
    return trace.agg(F.lit(parsers.check_trace_format(trace)).alias("accepted"), F.lit(without["EventSequence"]).alias("without_sequence"), F.lit(without["SPID"]).alias("without_session"), F.count("*").alias("total"))


@_query("stream_dedup_resume", _with(f"SELECT {_CAP_COLUMNS} FROM cap"))
def _(s, d):
    return _local(_appended(jobs.dedup_resume(_stream(s, d, copies=2), "60 days"))).select(*plans.adapter.CAPTURE)


def _arriving(spark: SparkSession, parts: list[DataFrame], take) -> None:
    """Each part written to one folder in turn; ``take(folder)`` runs a stream over what is there."""
    path = scratch(spark, "arriving")
    for part in parts:
        part.write.mode("append").parquet(path)
        take(path)


def _zoned(df: DataFrame) -> DataFrame:
    return df.withColumn("start_time", F.col("start_time").cast("timestamp"))


@_query("stream_resume_ledger", _with(f"SELECT {_CAP_COLUMNS} FROM cap"))
def _(s, d):
    """A stream that is started again without its checkpoint, when all old files and a copy of them are there."""
    path, e = scratch(s, "ledger"), _zoned(plans.events(s, d))
    runs = iter(range(3))

    def take(folder: str) -> None:
        jobs.resume_capture(jobs.stream_capture(s, folder), path, f"{path}-checkpoint-{next(runs)}", **NOW).awaitTermination()

    _arriving(s, [e.where(f"start_time < TIMESTAMP '{plans.SPLIT}'"), e], take)
    return _local(Ledger(path).events(s)).select(*plans.adapter.CAPTURE)


@_query("stream_pair_executions", _with(f"SELECT {_CAP_COLUMNS} FROM paired WHERE duration <> 0", plans._PAIRING.format(src="cap")))
def _(s, d):
    path = scratch(s, "executions")
    jobs.stream_executions(_stream(s, d), path, f"{path}-checkpoint", delay="60 days", **NOW).awaitTermination()
    return _local(jobs.read_executions(s, path)).select(*plans.adapter.CAPTURE)


_MEASURES = ", ".join(f"trunc(avg({m}))::BIGINT AS avg_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}, coalesce(sum({m}), 0)::BIGINT AS sum_{m}" for m in plans._METRICS)


@_query("stream_workload_details", _with(f"""SELECT {plans._HASH.format('template')} AS sql_hash, client_app_name AS application, database_name AS database, client_host_name AS host, server_principal_name AS login,
   {_MEASURES}, count(*) AS execution_count, date_trunc('hour', start_time) + INTERVAL 1 HOUR AS interval_end FROM (SELECT *, {plans._TEMPLATE} AS template FROM cap WHERE length(sql_text) > 0) WHERE template IS NOT NULL GROUP BY ALL"""))
def _(s, d):
    path = scratch(s, "details")
    details = jobs.details_by_window(_stream(s, d), plans.MINUTES)
    # all intervals, the open ones too
    save = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    details.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").foreachBatch(save).trigger(**NOW).start().awaitTermination()
    return _local(s.read.schema(details.schema).parquet(path))


_CLOSED = f"""closed AS (SELECT * FROM (SELECT {plans._HASH.format('template')} AS sql_hash, client_app_name AS application, database_name AS database, client_host_name AS host, server_principal_name AS login,
   {_MEASURES}, count(*) AS execution_count, date_trunc('hour', start_time) + INTERVAL 1 HOUR AS interval_end FROM (SELECT *, {plans._TEMPLATE} AS template FROM cap WHERE length(sql_text) > 0) WHERE template IS NOT NULL GROUP BY ALL)
   WHERE interval_end <= (SELECT max(start_time) FROM cap) - INTERVAL 2 HOUR)"""


@_query("write_details", _with(f"SELECT *, {plans._SECOND.format('interval_end')} AS interval_id FROM closed", _CLOSED))
def _(s, d):
    """Intervals that are closed when all events have come, each once though all its batches run twice."""
    root = scratch(s, "closed")
    details = jobs.details_by_window(_stream(s, d), plans.MINUTES, "2 hours")

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            jobs.save_details(batch, number, root, "w")

    details.writeStream.outputMode("append").option("checkpointLocation", f"{root}-checkpoint").foreachBatch(twice).trigger(**NOW).start().awaitTermination()
    return _local(jobs.read_details(s, root, "w", plans.MINUTES)[0])


@_query("stream_intervals", _with(f"SELECT interval_id, {plans._AT.format('interval_id')} AS end_time, duration_minutes FROM (SELECT DISTINCT {plans._SECOND.format('interval_end')} AS interval_id, {plans.MINUTES} AS duration_minutes FROM closed UNION ALL SELECT min({plans._SECOND.format('interval_end')}) - {plans.MINUTES * 60 + 1}, 0 FROM closed HAVING count(*) > 0)", _CLOSED))
def _(s, d):
    root = scratch(s, "closed")
    jobs.write_details(jobs.details_by_window(_stream(s, d), plans.MINUTES, "2 hours"), root, "w", f"{root}-checkpoint", **NOW).awaitTermination()
    return jobs.read_details(s, root, "w", plans.MINUTES)[1]


# the last part is late: what belongs to it had its intervals closed by the parts before
_LATE = "session_id % 5 = 0 AND start_time < TIMESTAMP '2024-01-10 00:00:00'"
_PARTS = (f"start_time < TIMESTAMP '{plans.SPLIT}' AND NOT ({_LATE})", f"start_time >= TIMESTAMP '{plans.SPLIT}'", _LATE)


def _interval_store(s: SparkSession, d: str) -> IntervalStore:
    """A store that three parts of the events have come to, each batch run twice."""
    root, e = scratch(s, "intervals"), _zoned(plans.events(s, d))
    store = IntervalStore(root, "w", plans.MINUTES, "2 hours")

    def take(folder: str) -> None:
        def twice(batch: DataFrame, number: int) -> None:
            for _ in range(2):
                store.add(batch, number)

        writer = jobs.stream_capture(s, folder).writeStream.trigger(**NOW).option("checkpointLocation", f"{root}/checkpoint")
        writer.foreachBatch(twice).start().awaitTermination()

    _arriving(s, [e.where(part) for part in _PARTS], take)
    return store


@_query("late_data", _with(f"SELECT * EXCLUDE (interval_end), {plans._SECOND.format('interval_end')} AS interval_id FROM closed", _CLOSED))
def _(s, d):
    """Closed intervals, corrected by what came when they were closed: as if all had come in time."""
    return _interval_store(s, d).closed(s)


@_query("late_events", _with(f"SELECT event_sequence, 2::BIGINT AS batch FROM cap WHERE {_LATE}"))
def _(s, d):
    """The side output of late events, with the number of the batch they came in."""
    return _interval_store(s, d).late(s).select("event_sequence", F.col("batch").cast("long").alias("batch"))


@_query("interval_store_summary", _with(plans._SUMMED.format("").replace("FROM execs", f"FROM (SELECT *, {plans._TEMPLATE} AS template FROM cap WHERE length(sql_text) > 0) WHERE template IS NOT NULL")))
def _(s, d):
    """The summary of all that has come, from the store's partials."""
    return _interval_store(s, d).summary(s)


@_query("stream_summary", _with(f"""SELECT coalesce(o.application, n.application) AS application, coalesce(o.database, n.database) AS database, coalesce(o.host, n.host) AS host, coalesce(o.login, n.login) AS login, {plans._MERGED}
  FROM s1 o FULL JOIN s2 n ON o.application IS NOT DISTINCT FROM n.application AND o.database IS NOT DISTINCT FROM n.database AND o.host IS NOT DISTINCT FROM n.host AND o.login IS NOT DISTINCT FROM n.login""",
    *(f"s{n} AS (SELECT *, true AS k FROM ({plans._SUMMED.format('').replace('FROM execs', f'FROM cap WHERE start_time {op} TIMESTAMP {chr(39)}{plans.SPLIT}{chr(39)}')}))" for n, op in ((1, "<"), (2, ">=")))))
def _(s, d):
    """Two batches, merged."""
    path, e = scratch(s, "summary"), _zoned(plans.events(s, d))
    take = lambda folder: jobs.stream_summary(jobs.stream_capture(s, folder), path, f"{path}-checkpoint", **NOW).awaitTermination()
    _arriving(s, [e.where(f"start_time {op} TIMESTAMP '{plans.SPLIT}'") for op in ("<", ">=")], take)
    return _local(jobs.read_summary(s, path))


@_query("stream_wait_deltas", _with("SELECT * FROM deltas", plans._SNAP))
def _(s, d):
    """Three batches, cut inside snapshots, each run twice; the last snapshot as it stands at the end."""
    path = scratch(s, "waits")
    deltas, snapshots = jobs.WaitDeltas(path), plans._snapshots(s, d)
    part = lambda n: F.expr(f"snapshot_no < {n} OR snapshot_no = {n} AND wait_type < 'D'")  # noqa: E731  days since 2000
    first, second = part(8775), part(8787)

    def take(folder: str) -> None:
        def twice(batch: DataFrame, number: int) -> None:
            for _ in range(2):
                deltas.add(batch, number)

        arriving = s.readStream.schema(snapshots.schema).parquet(folder)
        arriving.writeStream.trigger(**NOW).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(twice).start().awaitTermination()

    _arriving(s, [snapshots.where(first), snapshots.where(~first & second), snapshots.where(~second)], take)
    return deltas.read(s, open_too=True)


@_query("stream_recent_cpu", """WITH x AS (SELECT user_id % 7 AS server, date_trunc('hour', ts) AS hour, sum(least(greatest(value, 0), 100)) AS total, count(value) AS n FROM events GROUP BY ALL),
  ends AS (SELECT server, hour + to_hours(i::INTEGER) AS end_time, total, n FROM x, range(1, 25) r(i)),
  windows AS (SELECT server, end_time, sum(n)::BIGINT AS samples, trunc(round(sum(total) / sum(n), 6))::INTEGER AS avg_cpu FROM ends GROUP BY 1, 2)
  SELECT * FROM windows WHERE end_time <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _(s, d):
    """Mean CPU of the last day by the hour, from windows that are closed when all samples have come."""
    samples = plans.adapter.user_events(s, d).select((F.col("u") % 7).alias("server"), F.col("ts").cast("timestamp").alias("ts"), F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)).alias("value"))
    path = scratch(s, "samples")
    samples.write.parquet(path)
    return _local(_appended(jobs.recent_cpu(s.readStream.schema(samples.schema).parquet(path), 1440, "1 hour", "2 hours")))


@_query("ordered_files", _with("SELECT count(*) AS events, 0::BIGINT AS inside, 0::BIGINT AS between FROM cap"))
def _(s, d):
    """Events written in order, and the rows and files that are out of it when read back."""
    path = scratch(s, "ordered")
    report.write_ordered(plans.events(s, d), path)
    return report.order_faults(s, path).select("events", "inside", "between")


@_query("template_store", _with(f"SELECT event_sequence, {plans._TEMPLATE} AS template FROM cap"))
def _(s, d):
    """Templates by way of distinct texts; the texts of each half are added to one store."""
    store, e = templates.TemplateStore(s), plans.events(s, d)
    halves = [templates.with_templates(e.where(part), store, number=i).select("event_sequence", "template") for i, part in enumerate(("event_type > 0", "event_type < 0"))]
    return halves[0].unionByName(halves[1])
