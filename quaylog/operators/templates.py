"""Templates of distinct texts: each text is reduced once, and rows get its template by the text's digest.

A capture holds few texts many times. Copies are combined before they leave a task, the templates of texts that
weren't met before are added to a store, and rows are joined back: those of the commonest texts by a broadcast
table of a fixed number of entries, so that no task gathers them, all others by a shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.functions import sql_text
from quaylog.sources.scratch import scratch, written
from quaylog.sources.versions import file_system

#: Texts whose templates are broadcast, of at most TRUNCATED_CHARS signs each: texts of more than a MOST_COMMON-th of the rows.
MOST_COMMON, LEAST_ROWS = 2_000, 1_000


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, so that no other text can take its template."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class TemplateStore:
    """Templates by digest under ``path``, added to in parts and never changed; without a path for this session only.

    A part that is written again under its number replaces itself. Two parts may hold the same digest, with the same template.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "templates")

    def known(self, besides: int | None = None) -> DataFrame | None:
        # by the names of its parts: Spark takes two reads of one folder for the same, though a part has come between them
        parts = [f"{self.path}/part={n}" for n in self._parts() if n != besides]
        return self.spark.read.parquet(*parts).select("digest", "template") if parts else None

    def add(self, texts: DataFrame, number: int) -> None:
        """Templates of ``texts(digest, text)`` that the store lacks, as part ``number``."""
        new, known = texts.select("digest", "text"), self.known(besides=number)
        if known is not None:
            new = new.join(known.select("digest").distinct(), "digest", "left_anti")
        sql_text.normalize_sql(new, "text").select("digest", "template").write.mode("overwrite").parquet(f"{self.path}/part={number}")

    def _parts(self) -> list[int]:
        at, fs = file_system(self.spark, self.path)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.split("=")[1]) for x in found if x.startswith("part=") and fs.exists(file_system(self.spark, f"{self.path}/{x}/_SUCCESS")[0]))

    def numbered(self) -> int:
        """The number of the next part."""
        return max(self._parts(), default=-1) + 1


def with_templates(rows: DataFrame, store: TemplateStore | None = None, text: str = "sql_text", out: str = "template", number: int | None = None) -> DataFrame:
    """``normalize_sql`` by way of distinct texts: the same ``out``, '' for a null text.

    ``rows`` is read twice. New texts are added to ``store`` as part ``number``, or as its next part.
    """
    store = store or TemplateStore(rows.sparkSession)
    tagged = rows.withColumn("_digest", text_digest(F.col(text)))
    each = written(tagged.where(F.col(text).isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("n"), F.first(text).alias("text")), "texts")
    store.add(each, store.numbered() if number is None else number)
    named = store.known().groupBy("digest").agg(F.first("template").alias("template"))
    total = each.agg(F.sum("n")).first()[0] or 0
    common = each.where(F.col("n") > max(LEAST_ROWS, total // MOST_COMMON)).select("digest")  # at most MOST_COMMON
    common = F.broadcast(written(named.join(F.broadcast(common), "digest").select(F.col("digest").alias("_digest"), F.struct("template").alias("_common")), "common"))
    met = tagged.join(common, "_digest", "left")
    here = met.where(F.col("_common").isNotNull() | F.col(text).isNull()).withColumn(out, F.when(F.col(text).isNull(), "").otherwise(F.col("_common.template")))
    rare = met.where(F.col("_common").isNull() & F.col(text).isNotNull()).join(named.select(F.col("digest").alias("_digest"), F.col("template").alias(out)), "_digest")
    columns = [*[c for c in rows.columns if c != out], out]
    return here.select(columns).unionByName(rare.select(columns))
