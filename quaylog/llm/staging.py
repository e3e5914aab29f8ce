"""Tables written to the folder that driver and executors share.

A staged table cuts lineage (a lost executor re-reads files instead of recomputing
the steps before) and gives Catalyst real sizes.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quaylog-")
        spark.sparkContext.setCheckpointDir(path)
    return path


class Stage:
    """A DataFrame written once as Parquet; ``df`` reads it back, ``drop`` deletes it.

    What isn't dropped goes when the session's JVM ends.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/quaylog/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


class Buckets:
    """A DataFrame written once as a table in buckets by ``key``, which joins on the key read where they are; ``drop`` deletes it.

    There are as many buckets as the session's shuffles have partitions, so what is partitioned by the key already
    is written as one file for each bucket.
    """

    def __init__(self, df: DataFrame, name: str, key: str):
        self._spark, self._name = df.sparkSession, f"quaylog_{name}_{uuid.uuid4().hex}"
        self._path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self._spark)}/quaylog/{self._name}")
        self._fs = self._path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        count = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(count, key).sortBy(key).option("compression", "zstd").option("path", self._path.toString()).saveAsTable(self._name)
        self.df = self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        self._fs.delete(self._path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Has the session send Python tasks Arrow batches of ``most`` bytes where it would send
    larger ones (Spark's default is 64 MB, which a task holds several times over)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    size = int(now.rstrip("kmg")) << unit
    if not 0 < size <= most:
        spark.conf.set(name, str(most))


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that are done; it does so when their
    objects are collected, which a driver with free memory may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
