"""The analysis tables: facts by interval and template, summaries, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylog.functions import clock, sql_text

from . import partials
from .executions import METRICS
from .filters import drop_empty_executions, drop_noise_templates
from .partials import DIMS

#: Names of event types in the error table. Fixed values.
TYPE_NAMES = {5: "Timeout", 7: "Error"}


def with_interval(df: DataFrame, minutes: int, events: DataFrame | None = None) -> DataFrame:
    """Adds interval_id: the second since 2000-01-01 at which a row's interval ends.

    The grid begins at the first event of ``events``, the raw capture, so that what ``df`` took
    to make isn't made twice; of ``df`` itself if there is none.
    """
    anchor = (df if events is None else events).agg(clock.seconds(F.min("start_time")).alias("_anchor"))
    return df.join(F.broadcast(anchor)).withColumn("interval_id", clock.interval_end(F.col("start_time"), F.col("_anchor"), minutes)).drop("_anchor")  # one row


def executions(paired: DataFrame, minutes: int = 60, events: DataFrame | None = None) -> DataFrame:
    """Paired rows with template, sql_hash and interval_id; noise and empty texts are gone."""
    return templated(with_interval(paired, minutes, events))


def templated(rows: DataFrame) -> DataFrame:
    """Rows with template and sql_hash; noise and empty texts are gone."""
    named = sql_text.normalize_sql(drop_empty_executions(rows))
    return drop_noise_templates(named).withColumn("sql_hash", sql_text.sql_hash(F.col("template")))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}")


def workload_details(execs: DataFrame) -> DataFrame:
    """By interval, template and client names: average (whole), least, most and total of each metric."""
    return partials.details(partials.partials(execs))


def workload_summary(execs: DataFrame) -> DataFrame:
    """By client names, of executions read for it alone; ``partials.summary`` has it from partials."""
    aggs = [x for m in METRICS for x in (F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"), _total(m))]
    dates = [F.min("start_time").alias("min_execution_date"), F.max("start_time").alias("max_execution_date")]
    return execs.groupBy(*[F.col(c).alias(n) for n, c in DIMS.items()]).agg(*aggs, *dates, F.count("*").alias("execution_count"))


def merge_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` brought up to date with ``new``: an old null least or most value stays null."""
    keys, out = list(DIMS), []
    joined = old.withColumn("_had", F.lit(True)).alias("o").join(new.withColumn("_has", F.lit(True)).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    both = F.col("_had").isNotNull() & F.col("_has").isNotNull()
    for c in old.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            value = F.coalesce(o, n)
        elif c.startswith("min_"):
            value = F.when(both, F.when(n < o, n).otherwise(o)).otherwise(F.coalesce(o, n))
        elif c.startswith("max_"):
            value = F.when(both, F.when(n > o, n).otherwise(o)).otherwise(F.coalesce(o, n))
        else:
            value = F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))
        out.append(value.alias(c))
    return joined.select(*out)


def execution_errors(events: DataFrame, minutes: int = 60) -> DataFrame:
    names = F.create_map(*[F.lit(x) for k, v in TYPE_NAMES.items() for x in (k, v)])
    errors = with_interval(events, minutes).where(F.col("event_type").isin(*TYPE_NAMES))
    return errors.groupBy("interval_id", names[F.col("event_type")].alias("error_type"), F.col("sql_text").alias("message")).agg(F.count("*").alias("error_count"))


def intervals(execs: DataFrame, minutes: int) -> DataFrame:
    """(interval_id, end_time, duration_minutes): an interval for each id, and one of no length,
    a second before the first begins."""
    ends = execs.select("interval_id").distinct()
    marker = ends.agg((F.min("interval_id") - minutes * 60 - 1).alias("interval_id")).where("interval_id IS NOT NULL")
    every = ends.withColumn("duration_minutes", F.lit(minutes)).unionByName(marker.withColumn("duration_minutes", F.lit(0)))
    return every.select("interval_id", clock.from_seconds(F.col("interval_id")).alias("end_time"), "duration_minutes")


def assign_dictionary(events: DataFrame, name: str, existing: DataFrame | None = None) -> DataFrame:
    """(id, name): whole ids from 0 in the order names are first seen, after those that exist.

    Only the distinct names are put in one order. Null has no entry; its id is -1 in facts.
    """
    first = events.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.struct("start_time", "event_sequence")).alias("seen"))
    if existing is not None:
        first = first.join(existing, "name", "left_anti")
        base = existing.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("base"))
        numbered = first.join(F.broadcast(base)).withColumn("id", (F.row_number().over(Window.orderBy("seen", "name")) - 1 + F.col("base")).cast("long"))
        return existing.select("id", "name").unionByName(numbered.select("id", "name"))
    return first.select((F.row_number().over(Window.orderBy("seen", "name")) - 1).cast("long").alias("id"), "name")


def with_ids(facts: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """Facts with ``<name>_id`` in place of a name; null is -1."""
    return facts.join(dictionary.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name)), name, "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", F.lit(-1).cast("long"))).drop(name)


def merge_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, and incoming rows of keys that don't exist yet."""
    return existing.unionByName(incoming.join(existing.select(key).distinct(), key, "left_anti").select(existing.columns))


def normalized_queries(execs: DataFrame) -> DataFrame:
    """(sql_hash, normalized_text, example_text) as first seen."""
    first = F.min_by(F.struct("template", "sql_text"), F.struct("start_time", "event_sequence"))
    return execs.groupBy("sql_hash").agg(first.alias("x")).select("sql_hash", F.col("x.template").alias("normalized_text"), F.col("x.sql_text").alias("example_text"))


def report_queries(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("sql_hash").alias("query_hash"), F.col("normalized_text").alias("query_template"), F.col("example_text").alias("query_example"))


def latest_two_workloads(workloads: DataFrame) -> DataFrame:
    """One row (latest, previous) of the newest workload names of ``workloads(name, created)``."""
    ranked = workloads.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("created"), F.desc("name")))).where("rn <= 2")
    return ranked.groupBy().pivot("rn", [1, 2]).agg(F.min("name")).select(F.col("1").alias("latest"), F.col("2").alias("previous"))
