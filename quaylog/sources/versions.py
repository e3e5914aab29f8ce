"""Small tables that are rewritten whole under a number, and whole groups of partitions that are replaced.

A version counts from the moment its ``_SUCCESS`` is there, so a writer that is lost leaves the one
before in force. A writer that runs again under its number replaces its own version only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Versions:
    """A table under ``path`` of which the newest version is in force.

    ``keep`` versions that are complete stay: the newest, and those that a batch that is run again starts from.
    """

    def __init__(self, path: str, keep: int = 3):
        self.path, self.keep = path, keep

    def numbers(self, spark: SparkSession) -> list[int]:
        """Numbers of complete versions, smallest first."""
        at, fs = file_system(spark, self.path)
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(file_system(spark, f"{s.getPath()}/_SUCCESS")[0])]
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("v="))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest of a number below ``before``; None if there is none."""
        numbers = [n for n in self.numbers(spark) if before is None or n < before]
        return spark.read.parquet(f"{self.path}/v={numbers[-1]}") if numbers else None

    def write(self, df: DataFrame, number: int | None = None) -> None:
        """``df`` as a version; without a number as the one after the newest. What is older than the kept ones goes."""
        spark = df.sparkSession
        have = self.numbers(spark)
        number = (have[-1] + 1 if have else 0) if number is None else number
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for old in [n for n in have if n < number][: -(self.keep - 1)] if self.keep > 1 else [n for n in have if n < number]:
            at, fs = file_system(spark, f"{self.path}/v={old}")
            fs.delete(at, True)


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Writes ``df`` by partitions: those it has rows of are replaced, others stay as they are. Twice is as once.

    A partition's rows are brought together, but for those of one that is larger than its share.
    """
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
