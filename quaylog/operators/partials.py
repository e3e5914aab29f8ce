"""Partial aggregates of executions, from which details, summary and coarser intervals are rolled up.

A partial has a row per interval, template and client names: for each metric its count, sum, least
and most, and how many executions there were between which times. Two partials of the same keys
add up to one, so executions are read once, by one shuffle, whatever tables are asked for; partials
of parts that arrive later are merged in without reading what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylog.functions import clock

from .executions import METRICS

DIMS = {"application": "client_app_name", "database": "database_name", "host": "client_host_name", "login": "server_principal_name"}
KEYS = ("interval_id", "sql_hash", *DIMS)


def partials(execs: DataFrame) -> DataFrame:
    """Partials of executions with interval_id and sql_hash."""
    aggs = [x for m in METRICS for x in (F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"sum_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))]
    times = [F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"), F.count("*").alias("execution_count")]
    return execs.groupBy("interval_id", "sql_hash", *[F.col(c).alias(n) for n, c in DIMS.items()]).agg(*aggs, *times)


def rolled_up(parts: DataFrame, *keys: str | Column) -> DataFrame:
    """Partials merged to one for each of the keys."""
    aggs = [x for m in METRICS for x in (F.sum(f"n_{m}").alias(f"n_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}"))]
    times = [F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.sum("execution_count").alias("execution_count")]
    return parts.groupBy(*keys).agg(*aggs, *times)


def _total(m: str) -> Column:
    return F.coalesce(f"sum_{m}", F.lit(0)).alias(f"sum_{m}")


def details(parts: DataFrame) -> DataFrame:
    """The facts of partials that have one row for each key: averages (whole), least, most and totals."""
    mean = lambda m: F.expr(f"if(n_{m} = 0, null, sum_{m} div n_{m})").alias(f"avg_{m}")
    measures = [x for m in METRICS for x in (mean(m), F.col(f"min_{m}"), F.col(f"max_{m}"), _total(m))]
    return parts.select(*[c for c in KEYS if c in parts.columns], *measures, "execution_count")


def summary(parts: DataFrame) -> DataFrame:
    """By client names, from partials of any intervals and templates."""
    whole = rolled_up(parts, *DIMS)
    measures = [x for m in METRICS for x in (F.col(f"min_{m}"), F.col(f"max_{m}"), _total(m))]
    return whole.select(*DIMS, *measures, F.col("first_time").alias("min_execution_date"), F.col("last_time").alias("max_execution_date"), "execution_count")


def coarser(parts: DataFrame, minutes: int, events: DataFrame) -> DataFrame:
    """Partials of intervals of ``minutes``, a multiple of those that ``parts`` have, on the same grid: it begins at the first of ``events``."""
    anchor = events.agg(clock.seconds(F.min("start_time")).alias("_anchor"))
    # an interval's last second lies in the coarser one that holds it
    moved = parts.join(F.broadcast(anchor)).withColumn("interval_id", (F.col("_anchor") + F.ceil((F.col("interval_id") - F.col("_anchor")) / F.lit(minutes * 60)) * (minutes * 60)).cast("long"))  # one row
    return rolled_up(moved.drop("_anchor"), *KEYS)
