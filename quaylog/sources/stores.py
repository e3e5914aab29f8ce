"""Captures and analyses as folders of Parquet tables."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylog.operators.analysis import merge_new
from quaylog.operators.filters import filter_events

from . import parsers
from .scratch import written
from .versions import Versions, file_system, replace_partitions

CAPTURE_TABLES = ("events", "counters", "waits", "disk_perf")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none, or a folder without files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_capture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a capture. No order is imposed.

    Events have their counters as a map (of one name the largest), and their waits and disk rows
    as arrays; null where an event has none.
    """
    found = {t: df.drop("writer") for t in CAPTURE_TABLES if (df := _table(spark, f"{path}/{t}")) is not None}
    events = found.get("events")
    if "counters" in found:
        once = found["counters"].groupBy("row_id", "name").agg(F.max("value").alias("value"))
        maps = once.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("counters"))
        events = events.join(maps, "row_id", "left")
    for name in ("waits", "disk_perf"):
        if name in found:
            columns = [c for c in found[name].columns if c != "row_id"]
            lists = found[name].groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
            events = events.join(lists, "row_id", "left")
    return found | ({"events": events} if events is not None else {})


def numbered(events: DataFrame) -> tuple[DataFrame, int]:
    """Events with ``row_id`` 1, 2, ... without gaps, in the order of their files and rows, and their number.

    The events are written first, so that a row's place doesn't change when a task runs again. Places within a task's rows are known
    to that task; what lies before it is a prefix sum over the table of tasks, the only one put in one order.
    """
    placed = written(events.withColumn("_place", F.monotonically_increasing_id()), "placed")
    inside = F.lit((1 << 33) - 1)
    task = F.shiftright("_place", 33).alias("_task")
    counts = placed.groupBy(task).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(counts.select("_task", before.alias("_before"), "n"), "tasks")
    # the places of one task follow each other from 0, as the rows were written from one plan
    ids = placed.withColumn("_task", task).join(sizes.drop("n"), "_task").withColumn("row_id", (F.col("_before") + F.col("_place").bitwiseAND(inside) + 1).cast("long"))
    return ids.drop("_task", "_before", "_place"), sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class RowIds:
    """Ranges of row ids that the writers of a capture have claimed, under ``path``.

    A claim is a file named by its number that is made only if it isn't there, so of two writers that want the same
    range one has to take the next. A claim whose writer failed is given back if it is the last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _claims(self) -> list[tuple[int, int, int]]:
        """(number, first, count) of all claims, by number."""
        at, fs = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        return sorted(tuple(map(int, s.getPath().getName().split("-")[1:])) for s in fs.listStatus(at) if s.getPath().getName().startswith("claim-") and s.getLen())

    def claim(self, count: int, least: int = 0, tries: int = 100) -> tuple[int, int]:
        """(number, first id) of a range of ``count`` ids after all that are claimed and after ``least``."""
        from py4j.protocol import Py4JJavaError

        for _ in range(tries):
            claims = self._claims()
            number = claims[-1][0] + 1 if claims else 0
            first = max(least, claims[-1][1] + claims[-1][2] - 1 if claims else 0) + 1
            lock, fs = file_system(self.spark, f"{self.path}/lock-{number}")
            try:
                fs.create(lock, False).close()
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                time.sleep(0.1)  # another writer is about to name its range
                continue
            out = fs.create(file_system(self.spark, f"{self.path}/claim-{number}-{first}-{count}")[0], False)
            out.write(bytearray(b"1"))
            out.close()
            return number, first
        raise TimeoutError(f"no range of row ids could be claimed under {self.path}; a writer that was lost may have left lock files")

    def give_back(self, number: int) -> None:
        claims = self._claims()
        if claims and claims[-1][0] == number:
            for name in (f"claim-{number}-{claims[-1][1]}-{claims[-1][2]}", f"lock-{number}"):
                at, fs = file_system(self.spark, f"{self.path}/{name}")
                fs.delete(at, False)


def write_capture(dfs: dict[str, DataFrame], path: str) -> None:
    """Appends tables to a capture, partitioned by the writer's number, and events by day.

    Events without row_id get ids 1, 2, ... after those that the capture has, without gaps; each writer claims its range
    before it writes (``RowIds``) and its rows are in folders of their own, so two writers never share ids or a commit. Of a
    writer that fails nothing stays, its range included. Child tables carry their event's row_id.
    """
    events = dfs["events"]
    spark = events.sparkSession
    ids, number = RowIds(spark, f"{path}/_row_ids"), None
    if "row_id" not in events.columns:
        have = _table(spark, f"{path}/events")
        least = have.agg(F.max("row_id")).first()[0] if have is not None else None
        events, count = numbered(events)
        number, first = ids.claim(count, least or 0)
        events = events.withColumn("row_id", F.col("row_id") + F.lit(first - 1))
    part = f"writer={uuid.uuid4().hex if number is None else number}"
    tables = {"events": events.withColumn("event_date", F.to_date("start_time"))} | {t: dfs[t] for t in CAPTURE_TABLES[1:] if t in dfs}
    try:
        for name, df in tables.items():
            (df.write.partitionBy("event_date") if name == "events" else df.write).parquet(f"{path}/{name}/{part}")
    except Exception:
        for name in tables:
            at, fs = file_system(spark, f"{path}/{name}/{part}")
            fs.delete(at, True)
        if number is not None:
            ids.give_back(number)
        raise


def convert_capture(source: DataFrame, path: str, kind: str, **filters) -> None:
    """XML (``kind`` 'xe') or trace rows ('trace') as a capture, filtered by client names."""
    if kind == "trace" and not parsers.check_trace_format(source):
        raise ValueError("the trace holds no row with EventSequence and SPID")
    parsed = parsers.parse_xe(source) if kind == "xe" else parsers.parse_trace(source)
    write_capture({"events": filter_events(parsed, **filters)}, path)


def total_events(df: DataFrame) -> int:
    return df.count()


#: Keys of tables that take new rows only, the first seen staying: templates and dictionaries.
FIRST_SEEN = {"queries": "sql_hash", "applications": "name", "databases": "name", "hosts": "name", "logins": "name"}


def upserted(existing: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, and existing rows of keys that don't come in; of a key that comes in more than once one row."""
    new = written(incoming.dropDuplicates([key]), "incoming")  # read twice
    return new if existing is None else existing.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)


def write_analysis(tables: dict[str, DataFrame], root: str, workload: str) -> None:
    """Tables of one analysis under ``root/workload``; writing the same again changes nothing.

    Facts replace the intervals that they have rows of, and leave others as they are. The table of intervals is
    brought up to date by interval, templates and dictionaries take keys they don't have, and any other
    table, as a summary, is replaced. These small tables are versions: readers see the newest that is complete.
    """
    for name, df in tables.items():
        path = f"{root}/{workload}/{name}"
        if name == "intervals":
            table = Versions(path)
            table.write(upserted(table.read(df.sparkSession), df, "interval_id"))
        elif name in FIRST_SEEN:
            table = Versions(path)
            old, new = table.read(df.sparkSession), written(df.dropDuplicates([FIRST_SEEN[name]]), "incoming")
            table.write(new if old is None else merge_new(old, new, FIRST_SEEN[name]))
        elif "interval_id" in df.columns:
            replace_partitions(df, path, "interval_id")
        else:
            Versions(path).write(df)


def read_analysis(spark: SparkSession, root: str, workload: str, names: tuple[str, ...] = ("details", "intervals", "queries")) -> dict[str, DataFrame]:
    """The tables that are there, of those named."""
    found = {}
    for name in names:
        path = f"{root}/{workload}/{name}"
        if (df := Versions(path).read(spark)) is None and (df := _table(spark, path)) is not None:
            df = df.withColumn("interval_id", F.col("interval_id").cast("long"))
        if df is not None:
            found[name] = df
    return found


def analysis_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(real_intervals, first_end) of an analysis."""
    return tables["intervals"].agg(F.count_if(F.col("duration_minutes") > 0).alias("real_intervals"), F.min_by("end_time", "interval_id").alias("first_end"))
