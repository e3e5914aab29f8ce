import datetime
import random

from pyspark.sql import functions as F

from quaylog.operators import analysis, executions, filters, metrics, report

SCHEMA = "event_sequence long, event_type int, start_time timestamp_ntz, client_app_name string, client_host_name string, database_name string, server_principal_name string, session_id int, sql_text string, cpu long, duration long, reads long, writes long"
T0 = datetime.datetime(2024, 1, 1)


def event(seq, kind, session=1, duration=None, text="select 1", app="a"):
    return (seq, kind, T0 + datetime.timedelta(seconds=seq), app, "h", "d", "l", session, text, duration, duration, duration, duration)


def sequential(rows):
    """Metrics of each start, by a stack for each session."""
    out, open_ = {}, {}
    for r in sorted(rows):
        stack = open_.setdefault(r[7], [])
        if r[1] in filters.STARTS:
            stack.append(r[0])
            out[r[0]] = (r[8], None)
        elif stack:
            out[stack[-1]] = (r[8], r[10])
            if r[10]:
                stack.pop()
    return out


def test_pairing_equals_a_stack(spark):
    rng = random.Random(4)
    rows = [event(i, rng.choice([2, -3, 1, 3, 3]), rng.randrange(4), text=f"s{i}") for i in range(600)]
    rows = [r if r[1] in filters.STARTS else event(r[0], r[1], r[7], rng.choice([0, None, 5, 7]), r[8]) for r in rows]
    got = {r["event_sequence"]: (r["sql_text"], r["duration"]) for r in executions.pair_executions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == sequential(rows)


def test_pairing_of_nothing(spark):
    assert executions.pair_executions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filters(spark):
    rows = [event(1, 2, app="A1"), event(2, 2, app="b"), event(3, 2, app=None), event(4, 7, app="zz")]
    df = spark.createDataFrame(rows, SCHEMA)
    keep = lambda **k: [r[0] for r in filters.filter_events(df, **k).orderBy("event_sequence").collect()]
    assert keep(app=["a1"]) == [1, 4]
    assert keep(app=["^a1"]) == [2, 3, 4]
    assert keep(app=["b", "^a1"]) == [2, 4]
    assert keep() == [1, 2, 3, 4]
    texts = spark.createDataFrame([(t,) for t in ("", None, "KILL 5", "kill 5", "exec sp_cursorclose 1", "select 1")], "sql_text string")
    assert sorted(r[0] for r in filters.skip_internal(texts).collect()) == ["kill 5", "select 1"]


def test_prepared_statements(spark):
    prepare = "declare @p1 int set @p1=7 exec sp_prepare @p1 output,NULL,N'select ''x''' select @p1"
    rows = [event(1, 2, text="exec sp_execute 7"), event(2, 2, text=prepare), event(3, 2, text="exec sp_execute 7,1"), event(4, 2, text="exec sp_unprepare 7"), event(5, 2, text="exec sp_execute 7")]
    got = {r["event_sequence"]: r["statement"] for r in executions.resolve_prepared(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: None, 3: "select 'x'", 4: "select 'x'", 5: None}


def test_prepared_statements_over_stretches(spark):
    rng, rows, want, known = random.Random(4), [], {}, {}
    for seq in range(120):
        session, handle, kind = rng.choice([1, 1, 1, 2, None]), rng.randrange(3), rng.choice(["prepare", "execute", "execute", "unprepare"])
        text = {"prepare": f"declare @p1 int set @p1={handle} exec sp_prepare @p1 output,NULL,N'select {seq}' select @p1", "execute": f"exec sp_execute {handle}", "unprepare": f"exec sp_unprepare {handle}"}[kind]
        want[seq] = None if kind == "prepare" else known.get((session, handle))
        if kind != "execute":
            known[session, handle] = f"select {seq}" if kind == "prepare" else None
        rows.append(event(seq, 2, session=session, text=text))
    df = spark.createDataFrame(rows, SCHEMA)
    for stretch in (7, 1 << 17):
        assert {r["event_sequence"]: r["statement"] for r in executions.resolve_prepared(df, stretch).collect()} == want
    assert executions.resolve_prepared(df.where("false")).count() == 0


def test_replay_schedule_over_spans(spark):
    rng, rows, want, last = random.Random(6), [], {}, {}
    for seq in sorted(rng.sample(range(4000), 150)):
        session, app, text = rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.choice(["select 1", "exec sp_reset_connection"])
        rows.append(event(seq, 2, session=session, text=text, app=app))
    start = rows[0][0]
    for by_app in (False, True):
        want, last = {}, {}
        for r in rows:
            key, offset = (r[7], r[3] if by_app else None), (r[0] - start) * 1000.0
            before = last.get(key)
            want[r[0]] = (offset, 0.0 if before is None or before[0] else offset - before[1])
            last[key] = ("reset" in r[8], offset)
        for span in (30_000, 600_000, 1 << 40):
            got = executions.replay_schedule(spark.createDataFrame(rows, SCHEMA), by_app=by_app, span_ms=span).collect()
            assert {r["event_sequence"]: (r["offset_ms"], r["delay_ms"]) for r in got} == want
    stressed = executions.replay_schedule(spark.createDataFrame(rows, SCHEMA), stress=True).collect()
    assert {(r["offset_ms"], r["delay_ms"]) for r in stressed} == {(0.0, 0.0)}


def test_merge_equals_aggregate_and_keeps_old_nulls(spark):
    rng = random.Random(1)
    rows = [event(i, -3, duration=rng.randrange(50), app=rng.choice("abc")) for i in range(80)]
    a, b = spark.createDataFrame(rows[:40], SCHEMA), spark.createDataFrame(rows[40:], SCHEMA)
    merged = analysis.merge_summary(analysis.workload_summary(a), analysis.workload_summary(b))
    whole = analysis.workload_summary(a.unionByName(b)).select(merged.columns)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    old, new = spark.createDataFrame([event(1, -3)], SCHEMA), spark.createDataFrame([event(2, -3, duration=5)], SCHEMA)
    row = analysis.merge_summary(analysis.workload_summary(old), analysis.workload_summary(new)).first()
    assert row["min_cpu"] is None and row["sum_cpu"] == 5 and row["execution_count"] == 2


def test_dictionary_continues(spark):
    df = spark.createDataFrame([event(1, 2, app="x"), event(2, 2, app="y"), event(3, 2, app=None)], SCHEMA)
    have = spark.createDataFrame([(0, "y")], "id long, name string")
    assert sorted(map(tuple, analysis.assign_dictionary(df, "client_app_name", have).collect())) == [(0, "y"), (1, "x")]


def test_wait_deltas_reset_and_first(spark):
    rows = [(1, "A", 5.0, 4.0, 1.0, 10), (2, "A", 7.0, 5.0, 2.0, 12), (2, "B", 3.0, 3.0, 0.0, 1), (3, "A", 1.0, 1.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "snapshot_no long, wait_type string, wait_sec double, resource_sec double, signal_sec double, wait_count long")
    assert sorted(map(tuple, metrics.wait_deltas(df).collect())) == [(1, "A", 0.0, 0.0, 0.0, 0), (2, "A", 2.0, 1.0, 1.0, 2), (3, "A", 1.0, 1.0, 0.0, 2)]


def test_benchmark_only_template(spark):
    schema = "sql_hash long, sum_duration_us long, avg_duration_us double, sum_cpu_us long, avg_cpu_us double, sum_reads long, avg_reads double, execution_count long"
    a = spark.createDataFrame([(1, 10, 1.0, 10, 1.0, 10, 1.0, 1)], schema)
    b = spark.createDataFrame([(1, 15, 2.0, 10, 1.0, 10, 1.0, 1), (2, 9, 1.0, 1, 1.0, 1, 1.0, 3)], schema)
    got = {r["sql_hash"]: r for r in report.compare_queries(a, b).collect()}
    assert (got[1]["diff_sum_duration_us"], got[1]["side"]) == (5, "baseline")
    assert (got[2]["sum_duration_us"], got[2]["sum_duration_us2"], got[2]["diff_sum_duration_us"], got[2]["side"]) == (9, 0, 0, "benchmark")


def test_intervals_have_a_marker(spark):
    df = spark.createDataFrame([(3600,), (7200,), (7200,)], "interval_id long")
    assert sorted((r[0], r[2]) for r in analysis.intervals(df, 60).collect()) == [(-1, 0), (3600, 60), (7200, 60)]
    assert analysis.intervals(df.where("false"), 60).count() == 0


def test_time_bounds(spark):
    df = spark.createDataFrame([event(0, 2), event(59, 2), event(60, 2)], SCHEMA)
    assert filters.time_bounded(df, "2024-01-01 00:00:00", 1).count() == 2
    assert filters.time_bounded(df, "2024-01-01 00:00:30").count() == 2
    assert filters.map_database(df, {"d": "e"}).select(F.first("database_name")).first()[0] == "e"


def test_recent_cpu_equals_a_loop(spark):
    rng = random.Random(9)
    seconds = [rng.choice([None, *range(-130, 700)]) for _ in range(500)]
    rows = [(i, rng.choice([1, 1, 2, None]), s, rng.choice([None, rng.uniform(0, 100), 50.0])) for i, s in enumerate(seconds)] + [(900, 3, 5, None), (901, 3, 5000, 7.0)]
    df = spark.createDataFrame(rows, "e long, server long, second long, value double")
    for minutes in (0, 1, 3):
        want = {}
        for e, server, second, _ in rows:
            inside = [v for _, a, s, v in rows if a == server and v is not None and (s is second is None or None not in (s, second) and 0 <= second - s <= minutes * 60)]
            want[e] = int(round(sum(inside) / len(inside), 6)) if inside else 0
        assert {r["e"]: r["avg_cpu"] for r in metrics.cpu_recent(df, minutes).collect()} == want
    # no frame that moves at both ends, which is added up anew for every row
    assert "RangeFrame, -" not in metrics.cpu_recent(df, 3)._jdf.queryExecution().optimizedPlan().toString()
