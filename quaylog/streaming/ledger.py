"""Events of a growing capture once each, though a stream is started anew without its checkpoint.

What has been taken in is told by a ledger beside the output, not by the stream's own state: for each source file
the last row that was taken (its offset) and the highest sequence number among its rows. A stream that starts
again reads all files again; rows up to a file's mark are passed over, and of the others those whose
session and sequence the output already holds on the same day, as copies in another file are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.sources.versions import file_system

KEYS = ("session_id", "event_sequence")


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts under ``path`` that are complete."""
    at, fs = file_system(spark, path)
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(p.getName().removeprefix("part=") for p in found if fs.exists(file_system(spark, f"{p}/_SUCCESS")[0]))


class Ledger:
    """Output and marks of one capture under ``path``.

    A batch writes its events as one part, then its marks as a part of the same name, and is taken in when both are
    complete. A part whose marks are missing, as of a writer that was lost between the two, doesn't count: it is
    written again or left aside. A batch that is run again finds the state without its own part and replaces it. Events whose
    session or sequence is null can't be told apart by them and are kept by their place alone.
    """

    def __init__(self, path: str):
        self.path = path

    def _read(self, spark: SparkSession, table: str, parts: list[str]) -> DataFrame | None:
        return spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/part={p}" for p in parts]) if parts else None

    def marks(self, spark: SparkSession, besides: str | None = None) -> DataFrame | None:
        """(file, offset, sequence): the last row and the highest sequence taken of each file."""
        held = self._read(spark, "marks", [p for p in _parts(spark, f"{self.path}/marks") if p != besides])
        return None if held is None else held.groupBy("file").agg(F.max("offset").alias("offset"), F.max("sequence").alias("sequence"))

    def add(self, batch: DataFrame, part: str) -> None:
        """Takes in a batch whose rows have ``_file`` and ``_offset``, the file they are from and their place in it."""
        spark = batch.sparkSession
        marks = self.marks(spark, part)
        new = batch
        if marks is not None:
            passed = marks.select(F.col("file").alias("_file"), F.col("offset").alias("_mark"))
            new = batch.join(passed, "_file", "left").where("_mark IS NULL OR _offset > _mark").drop("_mark")
        keyed = new.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS)).withColumn("event_date", F.to_date("start_time"))
        # of copies that arrive together the first by file and place is taken
        once = keyed.groupBy(*KEYS).agg(F.min_by(F.struct(*keyed.columns), F.struct("_file", "_offset")).alias("x")).select("x.*")
        held = self._read(spark, "events", [p for p in _parts(spark, f"{self.path}/marks") if p != part])
        if held is not None:
            days = once.select("event_date").distinct()
            taken = held.join(days, held["event_date"].eqNullSafe(days["event_date"]), "left_semi").select(*KEYS)
            once = once.join(taken, list(KEYS), "left_anti")
        unkeyed = new.where(" OR ".join(f"{k} IS NULL" for k in KEYS)).withColumn("event_date", F.to_date("start_time"))
        columns = [c for c in [*batch.columns, "event_date"] if c not in ("_file", "_offset")]
        once.select(columns).unionByName(unkeyed.select(columns)).write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/events/part={part}")
        reached = batch.groupBy(F.col("_file").alias("file")).agg(F.max("_offset").alias("offset"), F.max("event_sequence").alias("sequence"))
        reached.write.mode("overwrite").parquet(f"{self.path}/marks/part={part}")

    def stream(self, events: DataFrame, checkpoint: str, **trigger: Any):
        """Runs over ``events`` of a file source of Parquet, which tells each row's file and place."""
        placed = events.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_offset"))

        def take(batch: DataFrame, number: int) -> None:
            # a stream without its checkpoint counts from 0 again, under another id
            self.add(batch, f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}")

        writer = placed.writeStream.trigger(**trigger) if trigger else placed.writeStream
        return writer.option("checkpointLocation", checkpoint).foreachBatch(take).start()

    def events(self, spark: SparkSession) -> DataFrame | None:
        """All events taken in, once each."""
        held = self._read(spark, "events", _parts(spark, f"{self.path}/marks"))
        return None if held is None else held.drop("part", "event_date")
