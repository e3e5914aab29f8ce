import datetime

from quaylog.operators import analysis, executions
from quaylog.sources import parsers, stores
from quaylog.streaming import jobs
from tests.test_operators import SCHEMA, event


def test_xe_kinds(spark):
    def xml(name, *fields):
        return f'<event name="{name}" timestamp="2024-01-01T00:00:01.500Z">' + "".join(f'<data name="{k}"><value>{v}</value></data>' for k, v in fields) + "</event>"

    docs = [
        xml("login", ("is_cached", "true")), xml("login", ("is_cached", "false"), ("session_id", 5)), xml("attention", ("sql_text", "q"), ("duration", 9)), xml("other"),
        xml("user_event", ("event_id", 83), ("user_data", "boom")), xml("user_event", ("event_id", 82), ("user_info", "Capture.Timeout[30]"), ("user_data", "slow")), xml("user_event", ("event_id", 82), ("user_info", "x")),
        xml("rpc_completed", ("statement", "exec p"), ("cpu_time", 3), ("duration", 4), ("logical_reads", 5), ("writes", 6)), "not xml",
    ]
    got = parsers.parse_xe(spark.createDataFrame([(x,) for x in docs], "event_data string")).collect()
    assert sorted((r["event_type"], r["sql_text"], r["cpu"], r["duration"]) for r in got) == [
        (1, "exec p", 3, 4), (2, parsers.NONPOOLED, None, None), (5, "q", 9, 9), (5, "slow", 30_000_000, 30_000_000), (7, "boom", 0, 0),
    ]
    assert got[0]["start_time"] == datetime.datetime(2024, 1, 1, 0, 0, 1, 500000)


def test_trace_kinds_and_missing_columns(spark):
    rows = [(10, 1, "p", 2, 7), (14, 1, None, None, 7), (14, 2, None, None, 7), (82, None, "Capture.Timeout[12]", None, 7), (82, None, "other", None, 7), (99, None, "x", None, 7)]
    df = spark.createDataFrame(rows, "EventClass int, EventSubClass int, TextData string, CPU int, SPID int")
    got = sorted((r["event_type"], r["sql_text"], r["cpu"], r["client_app_name"]) for r in parsers.parse_trace(df).collect())
    assert got == [(1, "p", 2000, None), (2, parsers.NONPOOLED, None, None), (5, "Capture.Timeout[12]", 12_000_000, None)]


def test_capture_round_trip_and_append(spark, tmp_path):
    path = f"file://{tmp_path}/capture"
    df = spark.createDataFrame([event(i, 2) for i in range(5)], SCHEMA)
    stores.write_capture({"events": df}, path)
    stores.write_capture({"events": df, "counters": spark.createDataFrame([(1, "AVG_CPU_USAGE", 3.0)], "row_id long, name string, value float")}, path)
    got = stores.read_capture(spark, path)["events"]
    assert got.count() == 10 and got.select("row_id").distinct().count() == 10
    assert got.where("row_id = 1").first()["counters"] == {"AVG_CPU_USAGE": 3.0}


def test_analysis_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    details = spark.createDataFrame([(3600, 1), (7200, 1)], "interval_id long, sql_hash long")
    stores.write_analysis({"details": details, "intervals": analysis.intervals(details, 60)}, root, "w")
    back = stores.read_analysis(spark, root, "w")
    assert set(back) == {"details", "intervals"} and stores.analysis_facts(back).first()["real_intervals"] == 2


def _stream(spark, tmp_path, rows):
    schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    spark.createDataFrame(rows, SCHEMA).withColumn("start_time", _ts()).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return jobs.stream_capture(spark, f"file://{tmp_path}/in", schema)


def _ts():
    from pyspark.sql import functions as F

    return F.col("start_time").cast("timestamp")


def test_stream_pairing(spark, tmp_path):
    rows = [event(1, 2, text="a"), event(2, 2, text="b"), event(3, 1, duration=0, text="b"), event(4, 1, duration=5, text="b"), event(5, 1, duration=6, text="a"), event(6, 1, duration=7)]
    q = jobs.pair_stream(_stream(spark, tmp_path, rows)).writeStream.format("memory").queryName("paired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_sequence"], r["sql_text"], r["duration"]) for r in spark.table("paired").collect()) == [(1, "a", 6), (2, "b", 5)]


def test_stream_executions_over_batches(spark, tmp_path):
    schema, path = SCHEMA.replace("timestamp_ntz", "timestamp"), f"file://{tmp_path}"
    batches = [
        [event(1, 2, text="a"), event(2, 2, text="b"), event(3, 1, duration=0, text="b")],
        [event(4, 1, duration=5, text=None), event(5, 2, text="c")],
        [event(6, 1, duration=0, text="c2"), event(7, 1, duration=4, text="c3"), event(8, 1, duration=6, text="a"), event(9, 1, duration=7), event(10, 2, text="d"), event(11, 1, duration=0, text="d2")],
        *([event(i, 2, session=77, text="e")] for i in (1500, 2700)),
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).withColumn("start_time", _ts()).coalesce(1).write.mode("append").parquet(f"{path}/in")
        jobs.stream_executions(jobs.stream_capture(spark, f"{path}/in", schema), f"{path}/out", f"{path}/cp", availableNow=True).awaitTermination()
    got = sorted((r["event_sequence"], r["sql_text"], r["duration"]) for r in jobs.read_executions(spark, f"{path}/out").collect())
    whole = executions.pair_executions(spark.createDataFrame(sum(batches, []), SCHEMA)).where("session_id <> 77").collect()
    assert got == sorted((r["event_sequence"], r["sql_text"], r["duration"]) for r in whole)
    assert got == [(1, "a", 6), (2, "b", 5), (5, "c3", 4), (10, "d2", 0)]


def test_stream_pairing_query_holds_no_session_in_a_task(spark, monkeypatch):
    from quaylog.plans import queries, stored  # noqa: F401

    monkeypatch.setattr(jobs, "pair_stream", None)
    import __spark_entry__

    assert __spark_entry__.queries()["stream_pair_executions"](spark, "/root/testdata/sf0.001").count() > 0


def test_stream_details_equal_batch(spark, tmp_path):
    rows = [event(i, -3, duration=i, text=f"select {i}") for i in range(1, 300)] + [event(100_000, -3, duration=1)]
    stream = jobs.details_by_window(jobs.dedup_resume(_stream(spark, tmp_path, rows + rows[:3]), "1 minute"), 1, None)
    q = stream.writeStream.format("memory").queryName("details").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = jobs.details_by_window(spark.createDataFrame(rows[:-1], SCHEMA).withColumn("start_time", _ts()), 1)
    assert sorted(map(str, spark.table("details").collect())) == sorted(map(str, batch.collect()))


def test_stream_summary_merges(spark, tmp_path):
    q = jobs.stream_summary(_stream(spark, tmp_path, [event(i, -3, duration=2) for i in range(9)]), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"file://{tmp_path}/out/v=0").first()["execution_count"] == 9
