"""Stores that are added to: late events, snapshots in parts, resumed streams, ids, upserts and templates."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quaylog.functions import sql_text
from quaylog.operators import analysis, metrics, partials, report, templates
from quaylog.sources import stores
from quaylog.sources.versions import Versions
from quaylog.streaming import jobs
from quaylog.streaming.interval_store import IntervalStore
from quaylog.streaming.ledger import Ledger
from tests.test_operators import SCHEMA, T0, event

TEXTS = ["select 1", "select a from b", "exec sp_reset_connection", "", None, "update t set x = 5"]


def events_of(rng, n, seconds=7200):
    return [event(rng.randrange(seconds), rng.choice([2, -3]), rng.randrange(3), rng.choice([None, 0, 5, 9]), rng.choice(TEXTS), rng.choice(["a", "b", None])) for _ in range(n)]


def plain(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_late_events_are_as_a_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(events_of(rng, 120), key=lambda r: r[2])
    late = [r for i, r in enumerate(rows) if i % 7 == 0]
    early = [r for i, r in enumerate(rows) if i % 7]
    batches = [early[:40], early[40:], [], late]
    store = IntervalStore(f"file://{tmp_path}", "w", 10, "5 minutes", span=3)
    mark, behind = None, 0
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        store.add(df, number)
        store.add(df, number)  # as after a crash
        ends = [r[2].replace(minute=r[2].minute // 10 * 10, second=0) + datetime.timedelta(minutes=10) for r in batch]
        behind += sum(mark is not None and e <= mark for e in ends)
        if batch:
            reached = max(r[2] for r in batch) - datetime.timedelta(minutes=5)
            mark = reached if mark is None else max(mark, reached)
    whole = IntervalStore("", "w", 10)._placed(spark.createDataFrame(rows, SCHEMA))
    want = analysis.workload_details(analysis.templated(whole))
    second = int((mark - datetime.datetime(2000, 1, 1)).total_seconds())
    assert behind > 0 and store.late(spark).count() == behind
    assert plain(store.all_details(spark)) == plain(want)
    assert plain(store.closed(spark)) == plain(want.where(F.col("interval_id") <= second))
    assert plain(store.summary(spark)) == plain(analysis.workload_summary(analysis.templated(whole)))
    assert store.intervals(spark).where("duration_minutes = 0").count() == 1


def test_partials_add_up(spark):
    rng = random.Random(6)
    df = spark.createDataFrame(events_of(rng, 150), SCHEMA)
    x = analysis.executions(df, 10)
    halves = [partials.partials(x.where(f"event_sequence % 2 = {i}")) for i in (0, 1)]
    merged = partials.rolled_up(halves[0].unionByName(halves[1]), *partials.KEYS)
    assert plain(partials.details(merged)) == plain(analysis.workload_details(x))
    assert plain(partials.summary(merged)) == plain(analysis.workload_summary(x))
    assert plain(partials.details(partials.coarser(merged, 60, df))) == plain(analysis.workload_details(analysis.executions(df, 60)))
    assert partials.details(partials.partials(x.where("false"))).count() == 0


def snapshots(spark, rows):
    return spark.createDataFrame([(n, w, *map(float, (s, s - 1, 1)), c) for n, w, s, c in rows], "snapshot_no long, wait_type string, wait_sec double, resource_sec double, signal_sec double, wait_count long")


def test_wait_deltas_of_split_snapshots(spark, tmp_path):
    rows = [(n, w, 10 * n + i, 5 * n + i) for n in range(4) for i, w in enumerate("AB")]
    whole = metrics.wait_deltas(snapshots(spark, rows))
    for cuts in ((3,), (1, 3), (2, 5, 7), (1, 2, 3, 4, 5, 6, 7)):
        deltas = jobs.WaitDeltas(f"file://{tmp_path}/{'-'.join(map(str, cuts))}")
        for number, (a, b) in enumerate(zip((0, *cuts), (*cuts, 8))):
            for _ in range(2):
                deltas.add(snapshots(spark, rows[a:b]), number)
        assert plain(deltas.read(spark, open_too=True)) == plain(whole)
        assert deltas.read(spark).where("snapshot_no = 3").count() == 0 and deltas.late(spark).count() == 0
    deltas.add(snapshots(spark, [(1, "C", 1, 1), (4, "A", 99, 99)]), 9)
    assert [tuple(r)[:2] for r in deltas.late(spark).select("snapshot_no", "wait_type").collect()] == [(1, "C")]
    assert deltas.read(spark).where("snapshot_no = 3").count() == 2


def test_versions_are_pruned(spark, tmp_path):
    table = Versions(f"file://{tmp_path}/t", keep=2)
    for n in range(5):
        table.write(spark.range(n + 1), n)
    assert table.numbers(spark) == [3, 4] and table.read(spark).count() == 5 and table.read(spark, 4).count() == 4 and table.read(spark, 3) is None


def joined(left, right):
    """The full outer join by nested loops; null keys are equal, 0 and -1 stand for absent partners."""
    out = []
    for k in {x[:2] for x in left} | {x[:2] for x in right}:
        out += [(*k, a, b) for a in [x[2] for x in left if x[:2] == k] or [0] for b in [x[2] for x in right if x[:2] == k] or [-1]]
    return sorted(map(str, out))


def test_full_outer_with_null_and_hot_keys(spark):
    rng = random.Random(3)
    left, right = ([(rng.choice(["hot", None, "a", own]) if rng.random() < 0.6 else "hot", rng.choice(["x", None]), rng.choice([None, 1, 2])) for _ in range(50)] for own in ("left", "right"))
    a, b = spark.createDataFrame(left, "k string, j string, n int"), spark.createDataFrame(right, "k string, j string, m int")
    for join in (report.full_outer, lambda *x: report.full_outer_salted(*x, hot_rows=4), report.full_outer_salted):
        got = join(a, b, ["k", "j"], {"n": 0, "m": -1})
        assert got.columns == ["k", "j", "n", "m"] and sorted(str(tuple(r)) for r in got.collect()) == joined(left, right)
        assert sorted(str(tuple(r)) for r in join(a, b.where("false"), ["k", "j"], {"n": 0, "m": -1}).collect()) == joined(left, [])
        assert join(a.where("false"), b.where("false"), ["k", "j"], {}).count() == 0


def test_row_ids_are_dense_over_appends(spark, tmp_path):
    path = f"file://{tmp_path}/capture"
    for n in (7, 0, 12):
        stores.write_capture({"events": spark.createDataFrame([event(i, 2) for i in range(n)], SCHEMA).repartition(3)}, path)
    assert sorted(r[0] for r in stores.read_capture(spark, path)["events"].select("row_id").collect()) == list(range(1, 20))


def test_claims_do_not_overlap(spark, tmp_path):
    ids = stores.RowIds(spark, f"file://{tmp_path}/ids")
    assert [ids.claim(10), stores.RowIds(spark, ids.path).claim(5), ids.claim(1, least=100)] == [(0, 1), (1, 11), (2, 101)]
    ids.give_back(1)  # not the last one: others have built on it
    assert ids.claim(1) == (3, 102)
    ids.give_back(3)
    assert ids.claim(2) == (3, 102)


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    path, df = f"file://{tmp_path}/capture", spark.createDataFrame([event(i, 2) for i in range(4)], SCHEMA)
    stores.write_capture({"events": df}, path)
    with pytest.raises(Exception, match="lost"):
        stores.write_capture({"events": df, "waits": spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("row_id"))}, path)
    stores.write_capture({"events": df}, path)
    back = stores.read_capture(spark, path)
    assert sorted(r["row_id"] for r in back["events"].collect()) == list(range(1, 9)) and set(back) == {"events"}


def test_writing_an_interval_twice_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    x = analysis.executions(spark.createDataFrame(events_of(random.Random(8), 60), SCHEMA), 10)
    tables = {"details": analysis.workload_details(x), "queries": analysis.normalized_queries(x), "summary": analysis.workload_summary(x)}
    tables["intervals"] = analysis.intervals(tables["details"], 10)
    names = tuple(tables)
    stores.write_analysis(tables, root, "w")
    first = {n: plain(df) for n, df in stores.read_analysis(spark, root, "w", names).items()}
    stores.write_analysis(tables, root, "w")
    assert {n: plain(df) for n, df in stores.read_analysis(spark, root, "w", names).items()} == first
    assert first["details"] == plain(tables["details"].select("interval_id", *[c for c in tables["details"].columns if c != "interval_id"]))
    one = tables["details"].agg(F.min("interval_id")).first()[0]
    changed = tables["details"].where(F.col("interval_id") == one).withColumn("execution_count", F.lit(77).cast("long"))
    stores.write_analysis({"details": changed, "intervals": tables["intervals"].where(F.col("interval_id") == one).withColumn("duration_minutes", F.lit(3))}, root, "w")
    back = stores.read_analysis(spark, root, "w", names)
    assert {r[0] for r in back["details"].where(F.col("interval_id") == one).select("execution_count").collect()} == {77}
    assert back["details"].count() == len(first["details"]) and back["intervals"].count() == len(first["intervals"])
    assert back["intervals"].where(F.col("interval_id") == one).first()["duration_minutes"] == 3


def test_a_stream_without_its_checkpoint_takes_each_event_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}", SCHEMA.replace("timestamp_ntz", "timestamp")
    rows = [event(i, 2) for i in range(30)]
    unkeyed = [(None, *rows[0][1:])]

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).withColumn("start_time", F.col("start_time").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def run(checkpoint):
        jobs.resume_capture(jobs.stream_capture(spark, f"{path}/in", schema), f"{path}/out", f"{path}/{checkpoint}", availableNow=True).awaitTermination()

    arrive(rows[:10] + unkeyed)
    run("a")
    arrive(rows[5:20] + rows[15:20])
    run("a")
    arrive(rows)
    run("b")  # the first checkpoint is lost
    run("c")
    ledger = Ledger(f"{path}/out")
    assert sorted(r[0] for r in ledger.events(spark).where("event_sequence IS NOT NULL").select("event_sequence").collect()) == list(range(30))
    assert ledger.events(spark).where("event_sequence IS NULL").count() == 1 and ledger.marks(spark).count() == 3


def test_a_batch_that_was_lost_before_its_marks_is_taken_again(spark, tmp_path):
    df = spark.createDataFrame([(*event(i, 2), "f", i) for i in range(6)], SCHEMA + ", _file string, _offset long")
    ledger = Ledger(f"file://{tmp_path}/out")
    ledger.add(df.where("_offset < 3"), "q-0")
    (tmp_path / "out/marks/part=q-0/_SUCCESS").unlink()
    assert ledger.events(spark) is None
    ledger.add(df.where("_offset < 3"), "q-0")
    ledger.add(df, "r-0")
    ledger.add(df, "r-0")
    assert sorted(r[0] for r in ledger.events(spark).select("event_sequence").collect()) == list(range(6))
    assert [tuple(r) for r in ledger.marks(spark).collect()] == [("f", 5, 5)]


def test_recent_cpu_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), T0 + datetime.timedelta(seconds=rng.randrange(1800)), rng.choice([None, 10.0, 55.5, 90.0])) for _ in range(80)]
    df = spark.createDataFrame(rows, "server string, ts timestamp, value double")
    want = {}
    for server in "ab":
        for i in range(1, 40):
            end = T0 + datetime.timedelta(minutes=i)
            inside = [v for s, t, v in rows if s == server and end - datetime.timedelta(minutes=5) <= t < end]
            if inside:
                known = [v for v in inside if v is not None]
                want[server, end] = (len(known), int(sum(known) / len(known)) if known else 0)
    found = lambda d: {(r["server"], r["end_time"]): (r["samples"], r["avg_cpu"]) for r in d.collect()}
    assert found(jobs.recent_cpu(df, 5)) == want
    df.unionByName(spark.createDataFrame([("z", T0 + datetime.timedelta(hours=3), 1.0)], df.schema)).write.parquet(f"file://{tmp_path}/in")
    stream = jobs.recent_cpu(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 5, delay="1 minute")
    q = stream.writeStream.format("memory").queryName("recent").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert found(spark.table("recent")) == want


def test_wait_categories(spark):
    waits = spark.createDataFrame([(1, w, 2.0, 1.0, 1.0, 1) for w in ("PAGEIOLATCH_SH", "PAGEX", "LCK_M_X", "ODD", "NAMED")], "interval_id long, wait_type string, wait_sec double, resource_sec double, signal_sec double, wait_count long")
    intervals = spark.createDataFrame([(1, T0, 60)], "interval_id long, end_time timestamp_ntz, duration_minutes int")
    rules = [("PAGE", "page"), ("PAGEIO", "io"), ("PAGEIO", "io"), ("LCK_M_XX", "no"), (None, "null")]
    named = [("NAMED", "name"), ("NAMED", "name"), ("OTHER", "x")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} string, category string")
    found = lambda **k: {r["wait_type"]: r["wait_category"] for r in metrics.wait_report(waits, intervals, **k).collect()}
    assert found(rules=frame(rules, "prefix"), categories=frame(named, "wait_type")) == {"PAGEIOLATCH_SH": "io", "PAGEX": "page", "LCK_M_X": "<n/a>", "ODD": "<n/a>", "NAMED": "name"}
    assert found() == {"PAGEIOLATCH_SH": "Buffer IO", "PAGEX": "<n/a>", "LCK_M_X": "Lock", "ODD": "<n/a>", "NAMED": "<n/a>"}
    assert metrics.wait_report(waits, intervals, categories=frame(named, "wait_type")).count() == 5
    with pytest.raises(Exception, match="two categories for NAMED"):
        found(categories=frame([*named, ("NAMED", "another")], "wait_type"))


def test_files_follow_each_other(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(events_of(random.Random(9), 300), SCHEMA).repartition(5)
    # else so few rows are one file
    monkeypatch.setattr(report, "ordered_events", lambda d: d.repartitionByRange(3, *report.ORDER).sortWithinPartitions(*report.ORDER))
    report.write_ordered(df, f"file://{tmp_path}/good")
    faults = report.order_faults(spark, f"file://{tmp_path}/good").first()
    assert faults["files"] > 1 and tuple(faults)[1:] == (300, 0, 0)
    files = sorted((tmp_path / "good").glob("part-*.parquet"))
    read = [(r["start_time"], r["event_sequence"]) for f in files for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()]
    assert read == sorted(read)
    df.write.parquet(f"file://{tmp_path}/bad")
    faults = report.order_faults(spark, f"file://{tmp_path}/bad").first()
    assert faults["inside"] > 0 and faults["between"] > 0


def test_template_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(templates, "LEAST_ROWS", 3)
    texts = [*TEXTS, *["select 7"] * 9, *["exec p @a=5"] * 2, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sql_text string")
    store = templates.TemplateStore(spark, f"file://{tmp_path}/t")
    for part in ("i < 8", "true", "true"):
        rows = df.where(part)
        assert plain(templates.with_templates(rows, store)) == plain(sql_text.normalize_sql(rows))
    assert store.known().count() == len({t for t in texts if t is not None}) == store.known().select("digest").distinct().count()


CALLS = [
    ("set @p1=3 exec sp_prepexecrpc @p1 output,N'select a from t',1", "SELECT A FROM T", None),
    ("exec sp_cursorprepexec @p1 output,@p2 output,N'@a int',N'select b from t where a=@a',1", "SELECT B FROM T WHERE A=@A", "{CURSOR}"),
    ("exec sp_cursoropen @cursor=@p1 output,@stmt=N'select c from t',@x=1", "SELECT C FROM T", "{CURSOR}"),
    ("exec sp_executesql @statement=N'select d from t',@params=N'@a int',@a=1", "SELECT D FROM T", None),
    ("exec sp_prepare @p1 output , N'@a int', N'select e from t'", "SELECT E FROM T", "{PREPARING}"),
    ("exec sp_prepexec @p1 output,NULL,N'exec sp_executesql N''select f from t'''", None, "{PREPARED}"),
    ("exec other_procedure N'select g from t'", "EXEC OTHER_PROCEDURE N'SELECT G FROM T'", None),
    ("exec sp_executesql 5", "EXEC SP_EXECUTESQL 5", None),
    ("exec sp_prepare @p1 output", "EXEC SP_PREPARE @P1 OUTPUT", None),
    ("", "", None),
]


def test_wrapped_statements(spark):
    df = spark.createDataFrame([(i, c[0].upper()) for i, c in enumerate(CALLS)], "i int, t string")
    got = {r["i"]: (r["_inner"], r["_tag"]) for r in sql_text.unwrap_call(df, "t").collect()}
    for i, (_, inner, tag) in enumerate(CALLS):
        assert got[i][1] == tag and (inner is None or got[i][0] == inner), (i, got[i])


def test_long_calls_do_not_overflow(spark):
    texts = ["exec sp_executesql N'select 1'," + ",".join(f"N'{i}'" for i in range(30_000)), "exec sp_prepare @p1 output,NULL,N'" + "''" * 60_000 + "'"]
    df = spark.createDataFrame([(t,) for t in texts], "sql_text string")
    got = [r[0] for r in df.select(sql_text.prepared_statement(F.col("sql_text"))).collect()]
    assert got == [None, "'" * 60_000] and sql_text.normalize_sql(df).count() == 2
