"""A capture of a database workload, derived from a table of user events.

Every user event gives a statement that starts and, mostly, one that completes some events
later, so that executions of a session nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = (
    "event_sequence", "event_type", "start_time", "client_app_name", "client_host_name", "database_name", "server_principal_name",
    "session_id", "sql_text", "cpu", "duration", "reads", "writes",
)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("props", "([0-9]+)", 1).try_cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.round(F.col("value") * 100).cast("long").alias("c"), number.alias("k"), "value"
    )


def workload_events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Starting and completed statements, with the columns of a capture.

    ``spread`` deals the events out before they are widened, for work that needs no shuffle: a scan has no more
    tasks than the file has row groups, and some 20 bytes of an event become a kilobyte of XML.
    """
    d = user_events(spark, sf_dir)
    if spread:
        d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "e")
    # numbers are written once, though the texts name them several times
    d = d.withColumns({"us": F.col("u").cast("string"), "ks": F.col("k").cast("string")})
    e, u, t, k, c, us, ks = (F.col(x) for x in ("e", "u", "t", "k", "c", "us", "ks"))
    texts = (
        F.concat(F.lit("SELECT * FROM T_"), t, F.lit(" WHERE ID = "), ks, F.lit(" AND NAME = N'n"), us, F.lit("'")),
        F.concat(F.lit("exec dbo.p_"), t, F.lit(" @Id="), ks, F.lit(",@Name=N'it''s "), us, F.lit("'")),
        F.concat(F.lit("select a from t where id in ("), ks, F.lit(","), us, F.lit(") -- note "), ks),
        F.concat(F.lit("/* c "), ks, F.lit(" */ UPDATE T SET B = 0xAF"), ks, F.lit(" WHERE ID=-"), ks, F.lit(".5")),
        F.lit("exec sp_reset_connection"),
        F.concat(F.lit("declare @p1 int set @p1="), us, F.lit(" exec sp_prepare @p1 output,NULL,N'select * from t_"), t, F.lit(" where id = @x' select @p1")),
        F.concat(F.lit("exec sp_execute "), us, F.lit(","), ks),
        F.concat(F.lit("EXEC sp_executesql N'select * from t_"), t, F.lit(" where v = "), ks, F.lit("'")),
    )
    text = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        text = F.when(e % 8 == i, x).otherwise(text)
    common = d.select(
        "e", "c", "k",
        F.col("ts").alias("start_time"),
        F.when(e % 29 != 0, F.concat(F.lit("app_"), t)).alias("client_app_name"),
        F.concat(F.lit("host_"), u % 7).alias("client_host_name"),
        F.concat(F.lit("db_"), u % 4).alias("database_name"),
        F.concat(F.lit("login_"), u % 5).alias("server_principal_name"),
        (u % 20).cast("int").alias("session_id"),
        text.alias("sql_text"),
    )
    none = F.lit(None).cast("long")
    # both rows of an event come from one scan
    start = F.struct((e * 10).alias("event_sequence"), F.when(e % 2 == 0, -3).otherwise(2).alias("event_type"), none.alias("cpu"), none.alias("duration"), none.alias("reads"), none.alias("writes"))
    done = F.struct(
        ((e + 17 * (e % 3)) * 10 + 1 + e % 3).alias("event_sequence"), F.when(e % 2 == 0, 3).otherwise(1).alias("event_type"),
        (c * 10).alias("cpu"), F.when(e % 17 == 0, F.lit(0).cast("long")).otherwise(c * 15).alias("duration"), k.alias("reads"), (k % 10).alias("writes"),
    )
    both = F.array_compact(F.array(F.when(e % 13 != 0, start), F.when(e % 11 != 0, done)))
    return common.withColumn("x", F.explode(both)).select(*[F.col(f"x.{c}").alias(c) if c in ("event_sequence", "event_type", "cpu", "duration", "reads", "writes") else c for c in CAPTURE])


#: The same rows in SQL, as a common table expression named ``cap``.
SQL = r"""
base AS (SELECT event_id AS e, ts, user_id AS u, event_type AS t, round(value * 100)::BIGINT AS c,
                TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value FROM events),
texts AS (SELECT *, CASE e % 8
    WHEN 0 THEN 'SELECT * FROM T_' || t || ' WHERE ID = ' || k || ' AND NAME = N''n' || u || ''''
    WHEN 1 THEN 'exec dbo.p_' || t || ' @Id=' || k || ',@Name=N''it''''s ' || u || ''''
    WHEN 2 THEN 'select a from t where id in (' || k || ',' || u || ') -- note ' || k
    WHEN 3 THEN '/* c ' || k || ' */ UPDATE T SET B = 0xAF' || k || ' WHERE ID=-' || k || '.5'
    WHEN 4 THEN 'exec sp_reset_connection'
    WHEN 5 THEN 'declare @p1 int set @p1=' || u || ' exec sp_prepare @p1 output,NULL,N''select * from t_' || t || ' where id = @x'' select @p1'
    WHEN 6 THEN 'exec sp_execute ' || u || ',' || k
    ELSE 'EXEC sp_executesql N''select * from t_' || t || ' where v = ' || k || '''' END AS sql_text,
    CASE WHEN e % 29 <> 0 THEN 'app_' || t END AS client_app_name, 'host_' || u % 7 AS client_host_name, 'db_' || u % 4 AS database_name,
    'login_' || u % 5 AS server_principal_name, (u % 20)::INTEGER AS session_id FROM base),
cap AS (
  SELECT e * 10 AS event_sequence, CASE WHEN e % 2 = 0 THEN -3 ELSE 2 END AS event_type, ts AS start_time, client_app_name, client_host_name, database_name, server_principal_name,
         session_id, sql_text, NULL::BIGINT AS cpu, NULL::BIGINT AS duration, NULL::BIGINT AS reads, NULL::BIGINT AS writes FROM texts WHERE e % 13 <> 0
  UNION ALL
  SELECT (e + 17 * (e % 3)) * 10 + 1 + e % 3, CASE WHEN e % 2 = 0 THEN 3 ELSE 1 END, ts, client_app_name, client_host_name, database_name, server_principal_name,
         session_id, sql_text, c * 10, CASE WHEN e % 17 = 0 THEN 0 ELSE c * 15 END, k, k % 10 FROM texts WHERE e % 11 <> 0)
"""


def metric_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: day, series names and amounts that snapshots accumulate."""
    wait = F.create_map(*[F.lit(x) for x in ("click", "PAGEIOLATCH_SH", "view", "CXPACKET", "purchase", "LCK_M_X", "signup", "ASYNC_NETWORK_IO", "error", "CUSTOM_WAIT")])
    return user_events(spark, sf_dir).select(
        "e", "ts", "u", "t", "c", "k", "value", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.coalesce(wait[F.col("t")], F.lit("OTHER_WAIT")).alias("wait_type"),
        F.concat(F.lit("db_"), F.col("u") % 4).alias("database_name"), F.concat(F.lit("file_"), F.col("u") % 3).alias("physical_filename"),
    )
