"""The registered queries of workload analysis, each with its SQL.

All read the given tables by way of the workload adapter. Names are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylog.functions import clock, sql_text
from quaylog.operators import analysis, executions, filters, metrics, partials, report
from quaylog.sources import adapter, parsers
from quaylog.sources.scratch import written

MINUTES = 60
SPLIT = "2024-01-16 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_PAIRING = """
ev AS (SELECT *, event_type IN (2, -3) AS st, CASE WHEN event_type IN (2, -3) THEN 1 WHEN coalesce(duration, 0) <> 0 THEN -1 ELSE 0 END AS x FROM {src}),
sums AS (SELECT *, sum(x) OVER (PARTITION BY session_id ORDER BY event_sequence ROWS UNBOUNDED PRECEDING) AS s FROM ev),
floors AS (SELECT *, least(min(s) OVER (PARTITION BY session_id ORDER BY event_sequence ROWS UNBOUNDED PRECEDING), 0) AS m FROM sums),
lagged AS (SELECT *, lag(m, 1, 0) OVER (PARTITION BY session_id ORDER BY event_sequence) AS pm FROM floors),
levels AS (SELECT *, CASE WHEN x = -1 AND m < pm THEN 0 WHEN x = -1 THEN s - m + 1 ELSE s - m END AS level FROM lagged),
groups AS (SELECT *, sum(st::INTEGER) OVER (PARTITION BY session_id, level ORDER BY event_sequence ROWS UNBOUNDED PRECEDING) AS g FROM levels WHERE level > 0),
halves AS (SELECT session_id,
  min_by({{'event_sequence': event_sequence, 'event_type': event_type, 'start_time': start_time, 'app': client_app_name, 'host': client_host_name, 'db': database_name, 'login': server_principal_name, 'sql_text': sql_text}}, event_sequence) FILTER (st) AS a,
  max_by({{'sql_text': sql_text, 'cpu': cpu, 'duration': duration, 'reads': reads, 'writes': writes}}, event_sequence) FILTER (NOT st) AS z
  FROM groups GROUP BY session_id, level, g),
paired AS (SELECT a.event_sequence, a.event_type, a.start_time, a.app AS client_app_name, a.host AS client_host_name, a.db AS database_name, a.login AS server_principal_name,
  session_id, coalesce(z.sql_text, a.sql_text) AS sql_text, z.cpu AS cpu, z.duration AS duration, z.reads AS reads, z.writes AS writes FROM halves)
"""
_TEMPLATE = """CASE WHEN sql_text = 'exec sp_reset_connection' THEN NULL
  WHEN sql_text LIKE 'SELECT * FROM T_%' THEN regexp_replace(regexp_replace(upper(sql_text), 'N''[^'']*''', '{NSTR}'), '= [0-9]+', '= {##}')
  WHEN sql_text LIKE 'exec dbo.p_%' THEN regexp_replace(upper(sql_text), '@ID=[0-9]+,@NAME=.*$', '@ID = {NUM}, @NAME = {STR}')
  WHEN sql_text LIKE 'select a from t%' THEN 'SELECT A FROM T WHERE ID {IN}'
  WHEN sql_text LIKE '/* c %' THEN 'UPDATE T SET B = {BINARY} WHERE ID={##}'
  WHEN sql_text LIKE 'declare @p1%' THEN '{PREPARING} ' || upper(regexp_extract(sql_text, 'N''(.*)''', 1))
  WHEN sql_text LIKE 'exec sp_execute %' THEN 'EXEC SP_EXECUTE {##}, {##}'
  ELSE regexp_replace(upper(regexp_extract(sql_text, 'N''(.*)''', 1)), '= [0-9]+', '= {##}') END"""
_HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_SECOND = "date_diff('second', TIMESTAMP '2000-01-01 00:00:00', {0})"
_AT = "(TIMESTAMP '2000-01-01 00:00:00' + to_seconds({0}))"
_METRICS = ("cpu", "duration", "reads", "writes")
_NAMES = "application, database, host, login"


def _execs_sql(source: str, minutes: int = MINUTES, mark: str = "") -> str:
    """CTEs that end in execs, details, intervals and points (with ``mark`` behind their names)."""
    measures = ", ".join(f"trunc(avg({m}))::BIGINT AS avg_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}, coalesce(sum({m}), 0)::BIGINT AS sum_{m}" for m in _METRICS)
    anchor = f"(SELECT {_SECOND.format('min(start_time)')} FROM {source})"
    ctes = _PAIRING.format(src=source) + f""",
    execs AS (SELECT *, {_HASH.format('template')} AS sql_hash FROM (
      SELECT *, {_TEMPLATE} AS template, {anchor} + ((({_SECOND.format('start_time')}) - {anchor}) // {minutes * 60} + 1) * {minutes * 60} AS interval_id
      FROM paired WHERE length(sql_text) > 0) WHERE template IS NOT NULL),
    details AS (SELECT interval_id, sql_hash, client_app_name AS application, database_name AS database, client_host_name AS host, server_principal_name AS login, {measures}, count(*) AS execution_count
      FROM execs GROUP BY ALL),
    intervals AS (SELECT interval_id, {_AT.format('interval_id')} AS end_time, duration_minutes FROM (
      SELECT DISTINCT interval_id, {minutes} AS duration_minutes FROM execs UNION ALL SELECT min(interval_id) - {minutes * 60 + 1}, 0 FROM execs HAVING count(*) > 0)),
    points AS (SELECT d.*, i.duration_minutes, date_diff('minute', (SELECT min_by(end_time, interval_id) FROM intervals), i.end_time) AS event_offset
      FROM details d JOIN intervals i USING (interval_id) WHERE application IS NOT NULL AND database IS NOT NULL AND host IS NOT NULL AND login IS NOT NULL)"""
    if mark:
        import re

        for name in ("ev", "sums", "floors", "lagged", "levels", "groups", "halves", "paired", "execs", "details", "intervals", "points"):
            ctes = re.sub(rf"(?<![\w.'{{]){name}(?= AS \(|\b(?=[ ,)\n]|$))(?! *=)", f"{name}{mark}", ctes)
    return ctes


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([adapter.SQL, *ctes]) + "\n" + select


_ALL = _execs_sql("cap")
_BASE = [f"cap1 AS (SELECT * FROM cap WHERE start_time < TIMESTAMP '{SPLIT}')", f"cap2 AS (SELECT * FROM cap WHERE start_time >= TIMESTAMP '{SPLIT}')", _execs_sql("cap1", mark="1"), _execs_sql("cap2", mark="2")]


def events(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    return adapter.workload_events(spark, d, spread)


def paired(spark: SparkSession, d: str) -> DataFrame:
    return executions.pair_executions(events(spark, d))


def execs(spark: SparkSession, d: str, part: str = "1=1", minutes: int = MINUTES) -> DataFrame:
    e = events(spark, d).where(part)
    return analysis.executions(executions.pair_executions(e), minutes, e)


def _analysis(spark: SparkSession, d: str, part: str = "1=1") -> tuple[DataFrame, DataFrame, DataFrame]:
    x = execs(spark, d, part)
    details = written(analysis.workload_details(x), "details")
    ivals = analysis.intervals(details, MINUTES)
    return details, ivals, report.points(details, ivals)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _analysis(spark, d, f"start_time < TIMESTAMP_NTZ '{SPLIT}'")[2], _analysis(spark, d, f"start_time >= TIMESTAMP_NTZ '{SPLIT}'")[2]


_CAP_COLUMNS = ", ".join(adapter.CAPTURE)


@_query("filter_events", _with(f"SELECT {_CAP_COLUMNS} FROM cap WHERE lower(client_app_name) IN ('app_click', 'app_view') AND (lower(database_name) NOT IN ('db_1') OR database_name IS NULL)"))
def _(s, d):
    return filters.filter_events(events(s, d), app=["APP_click", "app_view", "^app_error"], db=["^DB_1"])


# kinds -3 to 9 by sequence, those that the adapter lacks among them
_KIND = "CASE WHEN event_sequence % 7 < 3 THEN event_type ELSE (event_sequence % 13) - 3 END"


@_query("filter_event_types", _with(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM cap) WHERE kind IN (-3, 0, 1, 2, 3, 4, 5, 6, 7, 8) GROUP BY 1"))
def _(s, d):
    kinds = events(s, d).withColumn("event_type", F.expr(_KIND).cast("int"))
    return filters.filter_event_types(kinds).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


# a skipped part after each statement, before it, or none, by sequence
_PARTS = (*filters.SKIPPED_PARTS, *filters.SKIPPED_STARTS)
_SPOILED = f"CASE event_sequence % 23 {' '.join(f"WHEN {i} THEN sql_text || ' {x}x'" for i, x in enumerate(_PARTS))} WHEN 20 THEN '' WHEN 21 THEN 'KILL 5' WHEN 22 THEN 'insert bulk t' ELSE sql_text END"


@_query("skip_internal", _with(f"""SELECT event_sequence FROM (SELECT event_sequence, {_SPOILED} AS t FROM cap) WHERE t <> '' AND NOT ({' OR '.join(f"contains(t, '{x}')" for x in filters.SKIPPED_PARTS)} OR starts_with(t, 'KILL') OR starts_with(t, 'insert bulk'))"""))
def _(s, d):
    return filters.skip_internal(events(s, d).withColumn("sql_text", F.expr(_SPOILED))).select("event_sequence")


@_query("drop_empty_executions", _with("SELECT count(*) AS n FROM cap WHERE length(sql_text) > 0"))
def _(s, d):
    return filters.drop_empty_executions(events(s, d)).agg(F.count("*").alias("n"))


@_query("drop_noise_templates", _with(f"SELECT event_sequence, template FROM (SELECT event_sequence, {_TEMPLATE} AS template FROM cap WHERE sql_text IS NOT NULL) WHERE template IS NOT NULL"))
def _(s, d):
    return filters.drop_noise_templates(sql_text.normalize_sql(filters.drop_empty_executions(events(s, d)))).select("event_sequence", "template")


@_query("time_bounded", _with(f"SELECT {_CAP_COLUMNS} FROM cap WHERE start_time >= TIMESTAMP '2024-01-05 12:00:00' AND start_time < TIMESTAMP '2024-01-05 12:00:00' + INTERVAL 3000 MINUTE"))
def _(s, d):
    return filters.time_bounded(events(s, d), "2024-01-05 12:00:00", 3000)


@_query("map_database", _with("SELECT event_sequence, CASE database_name WHEN 'db_1' THEN 'sales' WHEN 'db_3' THEN 'stock' ELSE database_name END AS database_name FROM cap"))
def _(s, d):
    return filters.map_database(events(s, d), {"db_1": "sales", "db_3": "stock"}).select("event_sequence", "database_name")


@_query("pair_executions", _with(f"SELECT {_CAP_COLUMNS} FROM paired", _PAIRING.format(src="cap")))
def _(s, d):
    return paired(s, d)


@_query("strip_nul", "SELECT event_id, 'ab' || event_type AS sql_text, event_type AS decoded FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    padded = F.concat(F.lit("ab"), F.col("event_type"), F.lit("\0\0"))
    return e.select("event_id", sql_text.clean_text(padded).alias("sql_text"), sql_text.decode_utf16(F.encode("event_type", "UTF-16LE")).alias("decoded"))


@_query("normalize_sql", _with(f"SELECT event_sequence, {_TEMPLATE} AS template FROM cap WHERE sql_text IS NOT NULL"))
def _(s, d):
    return sql_text.normalize_sql(events(s, d).where("sql_text IS NOT NULL")).select("event_sequence", "template")


@_query("sql_hash", _with(f"SELECT template, {_HASH.format('template')} AS sql_hash, count(*) AS n FROM (SELECT {_TEMPLATE} AS template FROM cap WHERE sql_text IS NOT NULL) WHERE template IS NOT NULL GROUP BY ALL"))
def _(s, d):
    t = sql_text.normalize_sql(events(s, d).where("sql_text IS NOT NULL")).where("template IS NOT NULL")
    return t.groupBy("template", sql_text.sql_hash(F.col("template")).alias("sql_hash")).agg(F.count("*").alias("n"))


@_query("strip_comments", _with("SELECT event_sequence, 'select ''-- ' || client_host_name || '''  ' || chr(10) || 'from t' AS stripped, 'x ' || client_host_name AS plain FROM cap"))
def _(s, d):
    nested = F.concat(F.lit("select '-- "), "client_host_name", F.lit("' /* a /* b */ c */ -- d\nfrom t"))
    plain = F.concat(F.lit("/* a\n */x "), "client_host_name", F.lit("-- end"))
    return events(s, d).select("event_sequence", sql_text.strip_comments(nested).alias("stripped"), sql_text.strip_comments(plain).alias("plain"))


def _by_fourths(*texts):
    """One of four texts, by sequence; None in a text stands for the host's name."""
    picked = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        whole = F.concat(*[F.col("client_host_name") if x is None else F.lit(x) for x in text])
        picked = F.when(F.col("event_sequence") % 4 == i, whole).otherwise(picked)
    return picked


@_query("param_values", _with("SELECT event_sequence, CASE event_sequence % 4 WHEN 0 THEN '@A = {STR},@B = {NUM}' WHEN 1 THEN '@LONG_NAME = {STR}, @B1 = {NUM}, @C=@D' WHEN 2 THEN 'plain ' || client_host_name ELSE '@A = {STR} + <' || client_host_name || '>' END AS out FROM cap"))
def _(s, d):
    text = _by_fourths(["@A=N'it''s ", None, "',@B = 12"], ["@LONG_NAME = '", None, "', @B1=1.5, @C=@D"], ["plain ", None], ["@A = '' + <", None, ">"])
    return events(s, d).select("event_sequence", sql_text.param_values(text).alias("out"))


@_query("constants", _with("SELECT event_sequence, CASE event_sequence % 4 WHEN 0 THEN 'X = {STR}, {STR}, {NSTR}, {BINARY}, {##} = {##}' WHEN 1 THEN 'Y IN ({##}, {##}) AND Z = {STR}' WHEN 2 THEN client_host_name || ' A1 T' ELSE 'X={BINARY}+{NSTR}' END AS out FROM cap"))
def _(s, d):
    text = _by_fourths(["X = '', 'a', N'", None, "', 0XAF, --1 = 77"], ["Y IN (1, -2.5) AND Z = '", None, "'"], [None, " A1 T"], ["X=0X1F+N'a''b ", None, "'"])
    return events(s, d).select("event_sequence", sql_text.constants(text).alias("out"))


@_query("in_lists", _with("SELECT event_sequence, CASE event_sequence % 4 WHEN 0 THEN 'WHERE A {IN}' WHEN 1 THEN 'A {IN} OR C' WHEN 2 THEN 'JOIN T ON A = ' || client_host_name ELSE 'A IN (SELECT 1)' END AS out FROM cap"))
def _(s, d):
    text = _by_fourths(["WHERE A IN ( {STR}, '", None, "', {##} )"], ["A IN ({##}) AND B IN\n({STR}) OR C"], ["JOIN T ON A = ", None], ["A IN (SELECT 1)"])
    return events(s, d).select("event_sequence", sql_text.in_lists(text).alias("out"))


@_query("text_shape", _with("SELECT event_sequence, 'a, ' || client_host_name || ', b c' AS out, substr(repeat(client_host_name, 1000), 1, 4000) AS cut FROM cap"))
def _(s, d):
    spread = sql_text.collapse_spaces(sql_text.spread_csv(F.concat(F.lit("a,"), "client_host_name", F.lit(",  b \n c"))))
    return events(s, d).select("event_sequence", spread.alias("out"), sql_text.truncate(F.repeat("client_host_name", F.lit(1000))).alias("cut"))


@_query("unwrap_call", _with("SELECT event_sequence, CASE WHEN event_sequence % 2 = 0 THEN 'SELECT ' || upper(client_host_name) ELSE 'SELECT 1' END AS inner_sql, CASE WHEN event_sequence % 2 = 0 THEN '{CURSOR}' END AS tag FROM cap"))
def _(s, d):
    cursor = F.concat(F.lit("EXEC SP_CURSOROPEN @P1 OUTPUT,N'SELECT "), F.upper("client_host_name"), F.lit("',@P2 OUTPUT"))
    text = F.when(F.col("event_sequence") % 2 == 0, cursor).otherwise(F.lit("EXEC SP_EXECUTESQL N'SELECT 1',N'@A INT'"))
    out = sql_text.unwrap_call(events(s, d).withColumn("t", text), "t")
    return out.select("event_sequence", F.col("_inner").alias("inner_sql"), F.col("_tag").alias("tag"))


@_query("call_kind", _with("""SELECT event_sequence, CASE WHEN sql_text LIKE '%sp_reset_connection%' THEN 'SP_RESET_CONNECTION' WHEN sql_text LIKE '%exec sp_prepare %' THEN 'SP_PREPARE'
  WHEN sql_text LIKE 'exec sp_execute %' THEN 'SP_EXECUTE' ELSE 'OTHER' END AS call_kind,
  CASE WHEN sql_text LIKE '%sp_prepare%' THEN TRY_CAST(regexp_extract(sql_text, 'set @p1=([0-9]+)', 1) AS INTEGER) WHEN sql_text LIKE 'exec sp_execute %' THEN TRY_CAST(regexp_extract(sql_text, 'sp_execute ([0-9]+)', 1) AS INTEGER) END AS handle FROM cap"""))
def _(s, d):
    t = F.col("sql_text")
    return events(s, d).select("event_sequence", sql_text.call_kind(t).alias("call_kind"), sql_text.call_handle(t).alias("handle"))


@_query("replay_text", _with("""SELECT event_sequence, 'declare @p1 int set @p1=' || repeat('0', length(session_id::VARCHAR)) || ' exec sp_prepexec @p1 output ; EXEC sp_unprepare @p1;' AS replayed,
  ' sp_execute §, ' || repeat('1', 40) || 'E0' AS placeholder FROM cap"""))
def _(s, d):
    prep = F.concat(F.lit("declare @p1 int set @p1="), F.col("session_id"), F.lit(" exec sp_prepexec @p1 output"))
    run = F.concat(F.lit("x sp_execute "), F.col("session_id"), F.lit(", " + "1" * 40))
    return events(s, d).select("event_sequence", sql_text.replay_text(prep).alias("replayed"), F.substring(sql_text.replay_text(sql_text.placeholder_text(run)), 2, 1000).alias("placeholder"))


@_query("timeout_duration", _with("SELECT event_sequence, (session_id + 1)::BIGINT * 1000000 AS duration, 30000000::BIGINT AS other FROM cap"))
def _(s, d):
    t = F.concat(F.lit(parsers.TOOL_PREFIX + "Timeout["), F.col("session_id") + 1, F.lit("]"))
    return events(s, d).select("event_sequence", sql_text.timeout_duration(t).alias("duration"), sql_text.timeout_duration(F.lit(None).cast("string")).alias("other"))


@_query("interval_id", _with(f"SELECT event_sequence, a + (({_SECOND.format('start_time')} - a) // 3600 + 1) * 3600 AS interval_id FROM cap, (SELECT {_SECOND.format('min(start_time)')} AS a FROM cap)"))
def _(s, d):
    return analysis.with_interval(events(s, d), MINUTES).select("event_sequence", "interval_id")


@_query("offset_minutes", _with("SELECT event_sequence, date_diff('minute', TIMESTAMP '2024-01-01 00:00:59', start_time) AS offset_minutes FROM cap"))
def _(s, d):
    return events(s, d).select("event_sequence", clock.offset_minutes(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:59'"), F.col("start_time")).alias("offset_minutes"))


_PREPARED = """, calls AS (SELECT *, CASE WHEN sql_text LIKE '%exec sp_prepare %' THEN TRY_CAST(regexp_extract(sql_text, 'set @p1=([0-9]+)', 1) AS INTEGER)
    WHEN sql_text LIKE 'exec sp_execute %' THEN TRY_CAST(regexp_extract(sql_text, 'sp_execute ([0-9]+)', 1) AS INTEGER) END AS handle FROM cap WHERE event_type IN (2, -3))"""


@_query("resolve_prepared", _with("""SELECT event_sequence, handle, CASE WHEN sql_text LIKE 'exec sp_execute %' THEN last_value(CASE WHEN sql_text LIKE '%exec sp_prepare %' THEN regexp_extract(sql_text, 'N''(.*)''', 1) END IGNORE NULLS)
   OVER (PARTITION BY session_id, handle ORDER BY event_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS statement FROM calls""", _PREPARED.lstrip(", ")))
def _(s, d):
    return executions.resolve_prepared(events(s, d).where(F.col("event_type").isin(2, -3))).select("event_sequence", "handle", "statement")


@_query("workload_details", _with("SELECT * FROM details", _ALL))
def _(s, d):
    return _analysis(s, d)[0]


_SUMMARY = ", ".join(f"min({m}) AS min_{m}, max({m}) AS max_{m}, coalesce(sum({m}), 0)::BIGINT AS sum_{m}" for m in _METRICS)
_SUMMED = f"SELECT client_app_name AS application, database_name AS database, client_host_name AS host, server_principal_name AS login, {_SUMMARY}, min(start_time) AS min_execution_date, max(start_time) AS max_execution_date, count(*) AS execution_count FROM execs{{0}} GROUP BY ALL"


@_query("workload_summary", _with(_SUMMED.format(""), _ALL))
def _(s, d):
    return partials.summary(partials.partials(execs(s, d)))


@_query("coarser_details", _with("SELECT * FROM details", _execs_sql("cap", 360)))
def _(s, d):
    """Six-hour facts, rolled up from hourly partials."""
    parts = written(partials.partials(execs(s, d)), "partials")
    return partials.details(partials.coarser(parts, 360, events(s, d)))


_MERGED = ", ".join(
    [f"CASE WHEN n.k AND o.k THEN CASE WHEN n.{a}_{m} {op} o.{a}_{m} THEN n.{a}_{m} ELSE o.{a}_{m} END ELSE coalesce(o.{a}_{m}, n.{a}_{m}) END AS {a}_{m}" for m in (*_METRICS, "execution_date") for a, op in (("min", "<"), ("max", ">"))]
    + [f"coalesce(o.{c}, 0) + coalesce(n.{c}, 0) AS {c}" for c in (*(f"sum_{m}" for m in _METRICS), "execution_count")]
)


@_query("merge_summary", _with(
    f"SELECT coalesce(o.application, n.application) AS application, coalesce(o.database, n.database) AS database, coalesce(o.host, n.host) AS host, coalesce(o.login, n.login) AS login, {_MERGED} "
    "FROM s1 o FULL JOIN s2 n ON o.application IS NOT DISTINCT FROM n.application AND o.database IS NOT DISTINCT FROM n.database AND o.host IS NOT DISTINCT FROM n.host AND o.login IS NOT DISTINCT FROM n.login",
    *_BASE, f"s1 AS (SELECT *, true AS k FROM ({_SUMMED.format('1')}))", f"s2 AS (SELECT *, true AS k FROM ({_SUMMED.format('2')}))"))
def _(s, d):
    a, b = execs(s, d, f"start_time < TIMESTAMP_NTZ '{SPLIT}'"), execs(s, d, f"start_time >= TIMESTAMP_NTZ '{SPLIT}'")
    return analysis.merge_summary(analysis.workload_summary(a), analysis.workload_summary(b))


def _errors(s, d) -> DataFrame:
    kind = F.when(F.col("event_sequence") % 3 == 0, 7).when(F.col("event_sequence") % 3 == 1, 5).otherwise(F.col("event_type"))
    return events(s, d).withColumn("event_type", kind).withColumn("sql_text", F.col("client_app_name"))


@_query("execution_errors", _with(f"""SELECT a + (({_SECOND.format('start_time')} - a) // 3600 + 1) * 3600 AS interval_id, CASE event_sequence % 3 WHEN 0 THEN 'Error' ELSE 'Timeout' END AS error_type, client_app_name AS message, count(*) AS error_count
   FROM cap, (SELECT {_SECOND.format('min(start_time)')} AS a FROM cap) WHERE event_sequence % 3 < 2 GROUP BY ALL"""))
def _(s, d):
    return analysis.execution_errors(_errors(s, d), MINUTES)


@_query("intervals", _with("SELECT * FROM intervals", _ALL))
def _(s, d):
    return _analysis(s, d)[1]


@_query("assign_dictionary", _with("SELECT row_number() OVER (ORDER BY f.a, f.b, name) - 1 AS id, name FROM (SELECT client_app_name AS name, min({'a': start_time, 'b': event_sequence}) AS f FROM cap WHERE client_app_name IS NOT NULL GROUP BY 1) x"))
def _(s, d):
    return analysis.assign_dictionary(events(s, d), "client_app_name")


@_query("dimension_anti_merge", _with("SELECT DISTINCT client_host_name AS name, CASE WHEN client_host_name IN ('host_1', 'host_2') THEN 'old' ELSE 'new' END AS age FROM cap WHERE client_host_name IS NOT NULL"))
def _(s, d):
    names = events(s, d).select(F.col("client_host_name").alias("name")).where("name IS NOT NULL").distinct()
    return analysis.merge_new(names.where("name IN ('host_1', 'host_2')").withColumn("age", F.lit("old")), names.withColumn("age", F.lit("new")), "name")


_QUERIES_SQL = "SELECT sql_hash, x.a AS normalized_text, x.b AS example_text FROM (SELECT sql_hash, min_by({'a': template, 'b': sql_text}, {'t': start_time, 'q': event_sequence}) AS x FROM execs GROUP BY 1)"


@_query("normalized_queries", _with(_QUERIES_SQL, _ALL))
def _(s, d):
    return analysis.normalized_queries(execs(s, d))


@_query("batch_projection", _with(f"SELECT sql_hash AS query_hash, normalized_text AS query_template, example_text AS query_example FROM ({_QUERIES_SQL})", _ALL))
def _(s, d):
    return analysis.report_queries(analysis.normalized_queries(execs(s, d)))


@_query("points", _with("SELECT * FROM points", _ALL))
def _(s, d):
    return _analysis(s, d)[2]


@_query("filter_points", _with("SELECT * FROM points WHERE application IN ('app_click', 'app_view') AND database = 'db_2' AND event_offset BETWEEN 0 AND 20000", _ALL))
def _(s, d):
    return filters.filter_points(_analysis(s, d)[2], apps=["app_click", "app_view"], dbs=["db_2"], lo=-5, hi=20000)


@_query("workload_data", _with(f"""SELECT d.*, e.end_time, e.duration_minutes, e.elapsed_minutes, q.normalized_text FROM details d JOIN (SELECT *, sum(duration_minutes) OVER (ORDER BY end_time ROWS UNBOUNDED PRECEDING)::BIGINT AS elapsed_minutes FROM intervals) e USING (interval_id)
   JOIN ({_QUERIES_SQL}) q USING (sql_hash) WHERE application IS NOT NULL AND database IS NOT NULL AND host IS NOT NULL AND login IS NOT NULL""", _ALL))
def _(s, d):
    x = written(execs(s, d), "executions")  # read three times
    details = analysis.workload_details(x)
    return report.workload_data(details, analysis.intervals(details, MINUTES), analysis.normalized_queries(x))


@_query("elapsed_minutes", _with("SELECT *, sum(duration_minutes) OVER (ORDER BY end_time ROWS UNBOUNDED PRECEDING)::BIGINT AS elapsed_minutes FROM intervals", _ALL))
def _(s, d):
    return metrics.elapsed_minutes(_analysis(s, d)[1])


@_query("first_interval", _with("SELECT min_by(end_time, interval_id) AS first_end FROM intervals", _ALL))
def _(s, d):
    return report.first_interval(_analysis(s, d)[1])


@_query("choose_preaggregation", _with("SELECT count(*) AS interval_count, CASE WHEN count(*) > 2000 THEN 60 WHEN count(*) > 1000 THEN 30 WHEN count(*) > 500 THEN 15 ELSE 1 END AS preaggregation FROM intervals WHERE duration_minutes > 0", _ALL))
def _(s, d):
    return report.choose_preaggregation(_analysis(s, d)[1])


_PRE = ", ".join(f"trunc(avg(avg_{m}))::BIGINT AS avg_{m}, min(min_{m}) AS min_{m}, max(max_{m}) AS max_{m}, sum(sum_{m})::BIGINT AS sum_{m}" for m in _METRICS)


@_query("preaggregate_points", _with(f"SELECT event_offset // 1440 * 1440 AS event_offset, duration_minutes % 1440 AS interval_duration, sql_hash, {_NAMES}, {_PRE}, sum(execution_count)::BIGINT AS execution_count FROM points GROUP BY 1, 2, sql_hash, {_NAMES}", _ALL))
def _(s, d):
    return report.preaggregate(_analysis(s, d)[2], 1440)


_TOTALS = """SELECT sql_hash, sum(sum_duration)::BIGINT AS sum_duration_us, round(avg(avg_duration), 6) AS avg_duration_us, sum(sum_cpu)::BIGINT AS sum_cpu_us, round(avg(avg_cpu), 6) AS avg_cpu_us,
  sum(sum_reads)::BIGINT AS sum_reads, round(avg(avg_reads), 6) AS avg_reads, sum(execution_count)::BIGINT AS execution_count FROM points{0} GROUP BY 1"""


@_query("query_totals", _with(_TOTALS.format(""), _ALL))
def _(s, d):
    return report.query_totals(_analysis(s, d)[2])


@_query("top_queries", _with(_TOTALS.format("") + " ORDER BY sum_duration_us DESC, sql_hash LIMIT 10", _ALL))
def top_queries(s, d):
    return report.top_queries(report.query_totals(_analysis(s, d)[2]), n=10)


@_query("series_cpu", _with("SELECT event_offset, sum(sum_cpu)::BIGINT AS total FROM points GROUP BY 1", _ALL))
def _(s, d):
    return report.series(_analysis(s, d)[2], "cpu")


@_query("series_duration", _with("SELECT event_offset, sum(sum_duration)::BIGINT AS total FROM points GROUP BY 1", _ALL))
def _(s, d):
    return report.series(_analysis(s, d)[2], "duration")


@_query("series_batches", _with("SELECT event_offset, sum(execution_count * 100 // ((CASE WHEN duration_minutes = 0 THEN 1 ELSE duration_minutes END) * 60))::BIGINT AS batches_per_second FROM points GROUP BY 1", _ALL))
def _(s, d):
    # a hundred times the counts, as the adapter's are below one a second
    return report.series_batches(_analysis(s, d)[2].withColumn("execution_count", F.col("execution_count") * 100))


@_query("series_time_axis", _with("SELECT event_offset, sum(sum_cpu)::BIGINT AS total, (SELECT min_by(end_time, interval_id) FROM intervals) + to_minutes(event_offset) AS at_time FROM points GROUP BY 1", _ALL))
def _(s, d):
    details, ivals, pts = _analysis(s, d)
    return report.series_time_axis(report.series(pts, "cpu"), report.first_interval(ivals))


@_query("series_axis_compared", _with("SELECT 'baseline' AS side, event_offset, sum(sum_cpu)::BIGINT AS total, event_offset::DOUBLE AS at_offset FROM points1 GROUP BY 2 UNION ALL SELECT 'benchmark', event_offset, sum(sum_cpu)::BIGINT, event_offset::DOUBLE FROM points2 GROUP BY 2", *_BASE))
def _(s, d):
    """Two workloads on one axis of offsets."""
    base, bench = (report.series_time_axis(report.series(pts, "cpu")).withColumn("side", F.lit(side)) for pts, side in zip(_sides(s, d), ("baseline", "benchmark"), strict=True))
    return base.unionByName(bench)


_ONE = "SELECT A FROM T WHERE ID {IN}"


def _one_hash() -> int:
    import hashlib

    return int(hashlib.md5(_ONE.encode()).hexdigest()[:15], 16)


@_query("query_duration_series", _with(f"SELECT event_offset, round(avg(avg_duration), 6) AS avg_duration_us FROM points WHERE sql_hash = {_one_hash()} GROUP BY 1", _ALL))
def _(s, d):
    return report.query_series(_analysis(s, d)[2], _one_hash())


@_query("distinct_dimensions", _with("SELECT DISTINCT kind, name FROM (SELECT 'application' AS kind, application AS name FROM p UNION ALL SELECT 'database', database FROM p UNION ALL SELECT 'host', host FROM p UNION ALL SELECT 'login', login FROM p)", *_BASE, "p AS (SELECT * FROM points1 UNION ALL SELECT * FROM points2)"))
def _(s, d):
    return report.distinct_dimensions(*_sides(s, d))


_COMPARED = ", ".join(
    f"CASE WHEN b.sql_hash IS NULL THEN k.{m} ELSE b.{m} END AS {m}, CASE WHEN b.sql_hash = k.sql_hash THEN k.{m} ELSE 0 END AS {m}2, CASE WHEN b.sql_hash = k.sql_hash THEN k.{m} - b.{m} ELSE 0 END AS diff_{m}" for m in report.MEASURES
)


@_query("compare_queries", _with(f"SELECT coalesce(b.sql_hash, k.sql_hash) AS sql_hash, CASE WHEN b.sql_hash IS NULL THEN 'benchmark' ELSE 'baseline' END AS side, {_COMPARED} FROM ({_TOTALS.format('1')}) b FULL JOIN ({_TOTALS.format('2')}) k ON b.sql_hash = k.sql_hash", *_BASE))
def _(s, d):
    a, b = _sides(s, d)
    return report.compare_queries(report.query_totals(a), report.query_totals(b))


def _dims_sql(n: str, suffix: str) -> str:
    sums = ", ".join(f"sum(sum_{m})::BIGINT AS sum_{m}{suffix}, round(avg(avg_{m}), 6) AS avg_{m}{suffix}" for m in _METRICS)
    return f"(SELECT {_NAMES}, {sums}, sum(execution_count)::BIGINT AS execution_count{suffix} FROM points{n} WHERE sql_hash = {_one_hash()} GROUP BY ALL)"


_DIMS = ", ".join(f"coalesce({c}{x}, 0) AS {c}{x}" for x in ("", "2") for c in (*(f"{a}_{m}" for m in _METRICS for a in ("sum", "avg")), "execution_count"))


@_query("compare_query_dims", _with(f"SELECT {_NAMES}, {_DIMS} FROM {_dims_sql('1', '')} a FULL JOIN {_dims_sql('2', '2')} b USING ({_NAMES})", *_BASE))
def _(s, d):
    return report.compare_query_dims(*_sides(s, d), _one_hash())


# a third of the rows have one key, one session in 20 a key of its side alone, and keys and values may be null
_KEYED = "CASE WHEN session_id = {0} THEN '{1}' WHEN session_id % 3 = 0 THEN 'hot' ELSE client_app_name || '_' || session_id END"
_OUTER_SQL = f"""l AS (SELECT {_KEYED.format(1, 'left')} AS k, event_sequence AS n, session_id % 2 + NULLIF(session_id % 4, 1) AS v FROM cap WHERE event_type IN (2, -3)),
  r AS (SELECT {_KEYED.format(2, 'right')} AS k, database_name AS m, NULLIF(sum(cpu), 0)::BIGINT AS w FROM cap WHERE database_name <> 'db_1' OR cpu IS NULL GROUP BY 1, 2)"""


def _outer_sides(s, d) -> tuple[DataFrame, DataFrame]:
    e = events(s, d)
    left = e.where("event_type IN (2, -3)").select(F.expr(_KEYED.format(1, "left")).alias("k"), F.col("event_sequence").alias("n"), F.expr("session_id % 2 + nullif(session_id % 4, 1)").alias("v"))
    right = e.where("database_name <> 'db_1' OR cpu IS NULL").groupBy(F.expr(_KEYED.format(2, "right")).alias("k"), F.col("database_name").alias("m")).agg(F.expr("nullif(sum(cpu), 0)").alias("w"))
    return left, right


@_query("full_outer_by_key", _with("SELECT CASE WHEN l.n IS NULL THEN r.k ELSE l.k END AS k, coalesce(l.n, 0) AS n, CASE WHEN l.n IS NULL THEN 9 ELSE v END AS v, coalesce(m, 'none') AS m, CASE WHEN m IS NULL THEN -1 ELSE w END AS w FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k", _OUTER_SQL))
def _(s, d):
    return report.full_outer_salted(*_outer_sides(s, d), ["k"], {"n": 0, "v": 9, "m": "none", "w": -1}, hot_rows=1000)


@_query("replay_schedule", _with("""SELECT event_sequence, start_time, worker, sql_text, offset_ms, is_reset, coalesce(CASE WHEN lag(is_reset) OVER w THEN 0 ELSE greatest(offset_ms - lag(offset_ms) OVER w, 0) END, 0) AS delay_ms FROM (
   SELECT *, date_diff('microsecond', min(start_time) OVER (), start_time) / 1000 AS offset_ms, session_id || '_' || coalesce(database_name, '') AS worker, coalesce(sql_text LIKE '%sp_reset_connection%', false) AS is_reset FROM cap_first) WINDOW w AS (PARTITION BY worker ORDER BY start_time, event_sequence)""",
    "cap_first AS (SELECT * FROM cap WHERE event_type IN (2, -3))"))
def _(s, d):
    return executions.replay_schedule(events(s, d).where(F.col("event_type").isin(2, -3)))


@_query("ordered_events", _with(f"SELECT {_CAP_COLUMNS} FROM cap"))
def _(s, d):
    return report.ordered_events(events(s, d))


@_query("latest_two_workloads", _with("SELECT max(CASE WHEN rn = 1 THEN name END) AS latest, max(CASE WHEN rn = 2 THEN name END) AS previous FROM (SELECT name, row_number() OVER (ORDER BY created DESC, name DESC) AS rn FROM (SELECT client_host_name AS name, max(start_time) AS created FROM cap GROUP BY 1))"))
def _(s, d):
    return analysis.latest_two_workloads(events(s, d).groupBy(F.col("client_host_name").alias("name")).agg(F.max("start_time").alias("created")))


# server metrics

_SNAP = """daily AS (SELECT date_trunc('day', ts) AS day, coalesce(CASE t WHEN 'click' THEN 'PAGEIOLATCH_SH' WHEN 'view' THEN 'CXPACKET' WHEN 'purchase' THEN 'LCK_M_X' WHEN 'signup' THEN 'ASYNC_NETWORK_IO' WHEN 'error' THEN 'CUSTOM_WAIT' END, 'OTHER_WAIT') AS wait_type,
  ts >= TIMESTAMP '2024-01-21' AS later, sum(c)::BIGINT AS ms, count(*) AS n FROM base GROUP BY ALL),
snaps AS (SELECT date_diff('day', TIMESTAMP '2000-01-01', day) AS snapshot_no, wait_type, (sum(ms) OVER w)::BIGINT AS wait_sec, (sum(ms) OVER w - sum(n) OVER w)::BIGINT AS resource_sec, (sum(n) OVER w)::BIGINT AS signal_sec, (sum(n) OVER w)::BIGINT AS wait_count
  FROM daily WINDOW w AS (PARTITION BY wait_type, later ORDER BY day ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS previous_no, sum(wait_count) < lag(sum(wait_count)) OVER (ORDER BY snapshot_no) AS reset FROM snaps GROUP BY 1),
deltas AS (SELECT s.snapshot_no, s.wait_type, CASE WHEN previous_no IS NULL THEN 0 WHEN reset THEN s.wait_sec ELSE s.wait_sec - p.wait_sec END AS wait_sec, CASE WHEN previous_no IS NULL THEN 0 WHEN reset THEN s.resource_sec ELSE s.resource_sec - p.resource_sec END AS resource_sec,
  CASE WHEN previous_no IS NULL THEN 0 WHEN reset THEN s.signal_sec ELSE s.signal_sec - p.signal_sec END AS signal_sec, CASE WHEN previous_no IS NULL THEN 0 WHEN reset THEN s.wait_count ELSE s.wait_count - p.wait_count END AS wait_count
  FROM snaps s JOIN totals USING (snapshot_no) LEFT JOIN snaps p ON p.snapshot_no = previous_no AND p.wait_type = s.wait_type WHERE previous_no IS NULL OR reset OR s.wait_sec - p.wait_sec > 0)"""


def _snapshots(s, d) -> DataFrame:
    from pyspark.sql import Window

    later = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-21 00:00:00'")
    daily = adapter.metric_snapshots(s, d).groupBy("day", "wait_type", later.alias("later")).agg(F.sum("c").alias("ms"), F.count("*").alias("n"))
    w = Window.partitionBy("wait_type", "later").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ms, n = F.sum("ms").over(w), F.sum("n").over(w)
    return daily.select(F.timestamp_diff("DAY", F.expr(clock.EPOCH), F.col("day")).alias("snapshot_no"), "wait_type", ms.alias("wait_sec"), (ms - n).alias("resource_sec"), n.alias("signal_sec"), n.alias("wait_count"))


@_query("wait_deltas", _with("SELECT * FROM deltas", _SNAP))
def _(s, d):
    return metrics.wait_deltas(_snapshots(s, d))


@_query("filter_waits", _with("SELECT * REPLACE (CASE WHEN snapshot_no % 3 = 0 AND wait_type <> 'CXPACKET' THEN 'LAZYWRITER_SLEEP' ELSE wait_type END AS wait_type) FROM snaps WHERE wait_count > 0 AND wait_sec > 0 AND NOT (snapshot_no % 3 = 0 AND wait_type <> 'CXPACKET')", _SNAP))
def _(s, d):
    idle = F.when((F.col("snapshot_no") % 3 == 0) & (F.col("wait_type") != "CXPACKET"), "LAZYWRITER_SLEEP").otherwise(F.col("wait_type"))
    return filters.filter_waits(_snapshots(s, d).withColumn("wait_type", idle))


@_query("wait_stats", _with("SELECT snapshot_no // 7 AS interval_id, wait_type, sum(wait_sec)::BIGINT AS wait_sec, sum(resource_sec)::BIGINT AS resource_sec, sum(signal_sec)::BIGINT AS signal_sec, sum(wait_count)::BIGINT AS wait_count FROM deltas GROUP BY 1, 2", _SNAP))
def _(s, d):
    return metrics.wait_stats(metrics.wait_deltas(_snapshots(s, d)).withColumn("interval_id", F.expr("snapshot_no div 7")))


@_query("top_waits", _with("SELECT * FROM deltas ORDER BY wait_sec DESC, wait_type, snapshot_no LIMIT 5", _SNAP))
def _(s, d):
    return report.top_waits(metrics.wait_deltas(_snapshots(s, d)), 5)


@_query("waits_snapshot", _with("SELECT wait_type, round(max(wait_sec)::DECIMAL(20, 0) / 1000, 2)::DECIMAL(16, 2) AS wait_sec, round(max(resource_sec)::DECIMAL(20, 0) / 1000, 2)::DECIMAL(16, 2) AS resource_sec, round(max(signal_sec)::DECIMAL(20, 0) / 1000, 2)::DECIMAL(16, 2) AS signal_sec, max(wait_count) AS wait_count FROM snaps GROUP BY 1 HAVING max(wait_sec) >= 5", _SNAP))
def _(s, d):
    raw = _snapshots(s, d).select("wait_type", F.col("wait_sec").alias("wait_time_ms"), F.col("signal_sec").alias("signal_wait_time_ms"), F.col("wait_count").alias("waiting_tasks_count"))
    return metrics.waits_snapshot(raw)


_METRIC_INTERVALS = "mi AS (SELECT DISTINCT snapshot_no AS interval_id, TIMESTAMP '2000-01-01' + to_days(snapshot_no::INTEGER) AS end_time, 1440 AS duration_minutes FROM snaps), me AS (SELECT *, sum(duration_minutes) OVER (ORDER BY end_time ROWS UNBOUNDED PRECEDING)::BIGINT AS elapsed_minutes FROM mi)"


def _metric_intervals(snaps: DataFrame) -> DataFrame:
    return snaps.select(F.col("snapshot_no").alias("interval_id")).distinct().select("interval_id", F.timestamp_add("DAY", F.col("interval_id").cast("int"), F.expr(clock.EPOCH)).alias("end_time"), F.lit(1440).alias("duration_minutes"))


@_query("wait_report", _with("""SELECT interval_id, end_time, elapsed_minutes, wait_type, CASE wait_type WHEN 'PAGEIOLATCH_SH' THEN 'Buffer IO' WHEN 'CXPACKET' THEN 'Parallelism' WHEN 'LCK_M_X' THEN 'Lock' WHEN 'ASYNC_NETWORK_IO' THEN 'Network IO' ELSE '<n/a>' END AS wait_category,
   wait_sec * 1000 AS wait_ms, resource_sec * 1000 AS resource_ms, signal_sec * 1000 AS signal_ms, wait_count FROM deltas d JOIN me ON me.interval_id = d.snapshot_no""", _SNAP, _METRIC_INTERVALS))
def _(s, d):
    snaps = _snapshots(s, d)
    return metrics.wait_report(metrics.wait_deltas(snaps).withColumnRenamed("snapshot_no", "interval_id"), _metric_intervals(snaps))


# rules inside each other, the empty one among them
_RULES = {"": "Other", "P": "Page", "PAGE": "Page", "PAGEIO": "Page IO", "PAGEIOLATCH_SH": "Page IO, shared", "LCK_M": "Lock", "LCK_M_XX": "none", "C": "C", "CX": "Parallel"}


@_query("wait_categories", _with("""SELECT interval_id, end_time, elapsed_minutes, wait_type, CASE wait_type WHEN 'CUSTOM_WAIT' THEN 'Named' WHEN 'PAGEIOLATCH_SH' THEN 'Page IO, shared' WHEN 'CXPACKET' THEN 'Parallel' WHEN 'LCK_M_X' THEN 'Lock' ELSE 'Other' END AS wait_category,
   wait_sec * 1000 AS wait_ms, resource_sec * 1000 AS resource_ms, signal_sec * 1000 AS signal_ms, wait_count FROM deltas d JOIN me ON me.interval_id = d.snapshot_no""", _SNAP, _METRIC_INTERVALS))
def _(s, d):
    """Categories by a table of names, which repeats a row, and by nested rules for the others."""
    snaps = _snapshots(s, d)
    rules = s.createDataFrame(list(_RULES.items()), "prefix string, category string")
    named = s.createDataFrame([("CUSTOM_WAIT", "Named")] * 2, "wait_type string, category string")
    return metrics.wait_report(metrics.wait_deltas(snaps).withColumnRenamed("snapshot_no", "interval_id"), _metric_intervals(snaps), named, rules)


_DISK = """dd AS (SELECT date_trunc('day', ts) AS day, 'db_' || u % 4 AS database_name, 'file_' || u % 3 AS physical_filename, sum(c)::BIGINT AS a, sum(k)::BIGINT AS b, count(*) AS n FROM base GROUP BY ALL),
ds AS (SELECT date_diff('day', TIMESTAMP '2000-01-01', day) AS snapshot_no, database_name, physical_filename, (sum(a) OVER w)::BIGINT AS a, (sum(b) OVER w)::BIGINT AS b, (sum(n) OVER w)::BIGINT AS n FROM dd WINDOW w AS (PARTITION BY database_name, physical_filename ORDER BY day ROWS UNBOUNDED PRECEDING)),
dp AS (SELECT snapshot_no AS no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS previous_no FROM (SELECT DISTINCT snapshot_no FROM ds)),
disk AS (SELECT n.snapshot_no, n.database_name, n.physical_filename, 'log' AS logical_filename, 'ROWS' AS file_type, NULL::VARCHAR AS volume_mount_point, n.a - p.a AS read_latency_ms, n.n - p.n AS reads, n.b - p.b AS read_bytes, n.b - p.b AS write_latency_ms, n.n - p.n AS writes, n.a - p.a AS write_bytes,
  n.a AS cum_read_latency_ms, n.n AS cum_reads, n.b AS cum_read_bytes, n.b AS cum_write_latency_ms, n.n AS cum_writes, n.a AS cum_write_bytes FROM ds n JOIN dp ON dp.no = n.snapshot_no JOIN ds p ON p.snapshot_no = previous_no AND p.database_name = n.database_name AND p.physical_filename = n.physical_filename)"""


def _disk(s, d) -> DataFrame:
    from pyspark.sql import Window

    daily = adapter.metric_snapshots(s, d).groupBy("day", "database_name", "physical_filename").agg(F.sum("c").alias("a"), F.sum("k").alias("b"), F.count("*").alias("n"))
    w = Window.partitionBy("database_name", "physical_filename").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b, n = (F.sum(c).over(w) for c in "abn")
    return daily.select(
        F.timestamp_diff("DAY", F.expr(clock.EPOCH), F.col("day")).alias("snapshot_no"), "database_name", "physical_filename", F.lit("log").alias("logical_filename"), F.lit("ROWS").alias("file_type"), F.lit(None).cast("string").alias("volume_mount_point"),
        a.alias("read_latency_ms"), n.alias("reads"), b.alias("read_bytes"), b.alias("write_latency_ms"), n.alias("writes"), a.alias("write_bytes"),
    )


@_query("disk_deltas", _with("SELECT * FROM disk", _DISK))
def _(s, d):
    return metrics.disk_deltas(_disk(s, d))


@_query("disk_perf", _with("SELECT snapshot_no // 7 AS interval_id, database_name, physical_filename, logical_filename, file_type, volume_mount_point, round(avg(read_latency_ms), 6) AS read_latency_ms, round(avg(write_latency_ms), 6) AS write_latency_ms, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("reads", "read_bytes", "writes", "write_bytes")) + ", " + ", ".join(f"max(cum_{c}) AS cum_{c}" for c in metrics.DISK) + " FROM disk GROUP BY ALL", _DISK))
def _(s, d):
    out = metrics.disk_perf(metrics.disk_deltas(_disk(s, d)).withColumn("interval_id", F.expr("snapshot_no div 7")))
    return out.withColumns({c: F.round(c, 6) for c in ("read_latency_ms", "write_latency_ms")})


_COUNTERS = f"counters AS (SELECT {_SECOND.format('ts')} // 86400 * 86400 AS interval_id, 'AVG_CPU_USAGE' AS name, least(greatest(value, 0), 100) AS value FROM base)"
_COUNTED = "SELECT interval_id, name, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM counters GROUP BY 1, 2"


def _counters(s, d) -> DataFrame:
    return adapter.user_events(s, d).select((F.floor(clock.seconds(F.col("ts")) / 86400) * 86400).cast("long").alias("interval_id"), F.lit("AVG_CPU_USAGE").alias("name"), F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)).alias("value"))


@_query("performance_counters", _with(_COUNTED, _COUNTERS))
def _(s, d):
    return metrics.performance_counters(_counters(s, d)).withColumn("avg_value", F.round("avg_value", 6))


@_query("counter_report", _with(f"SELECT c.interval_id, {_AT.format('c.interval_id')} AS end_time, 1440::BIGINT * row_number() OVER (ORDER BY c.interval_id) AS elapsed_minutes, name, min_value, max_value, avg_value FROM ({_COUNTED}) c", _COUNTERS))
def _(s, d):
    c = metrics.performance_counters(_counters(s, d)).withColumn("avg_value", F.round("avg_value", 6))
    ivals = c.select("interval_id").distinct().select("interval_id", clock.from_seconds(F.col("interval_id")).alias("end_time"), F.lit(1440).alias("duration_minutes"))
    return metrics.counter_report(c, ivals)


@_query("counter_ratio", _with("SELECT trunc(sum((c::DOUBLE / 100000 * 100)::FLOAT::DOUBLE))::INTEGER AS avg_cpu_percent FROM (SELECT u, min(c) AS c FROM base GROUP BY u)"))
def _(s, d):
    """Ratio counters that the adapter's events imply: one pool for each user."""
    pools = adapter.user_events(s, d).groupBy("u").agg(F.min("c").alias("c"))
    row = lambda name, value, kind: F.struct(F.lit("SQLServer:Resource Pool Stats").alias("object_name"), F.lit(name).alias("counter_name"), F.col("u").cast("string").alias("instance_name"), value.alias("cntr_value"), F.lit(kind).alias("cntr_type"))
    both = pools.select(F.explode(F.array(row("CPU usage %", F.col("c"), 537003264), row("CPU usage % base", F.lit(100000).cast("long"), 1073939712))).alias("x"))
    return metrics.counter_ratio(both.select("x.*"))


@_query("cpu_recent_average", _with(f"SELECT e, trunc(round(avg(v) OVER (PARTITION BY u % 7 ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 6))::INTEGER AS avg_cpu FROM (SELECT e, u, least(greatest(value, 0), 100) AS v, {_SECOND.format('ts')} AS s FROM base)"))
def _(s, d):
    samples = adapter.user_events(s, d).select("e", (F.col("u") % 7).alias("server"), clock.seconds(F.col("ts")).alias("second"), F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)).alias("value"))
    return metrics.cpu_recent(samples, 1440).select("e", "avg_cpu")


# ingestion

_XE_NAMES = {-3: "sql_batch_starting", 2: "rpc_starting", 3: "sql_batch_completed", 1: "rpc_completed"}


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def xe_documents(df: DataFrame) -> DataFrame:
    """Events as Extended Events XML."""
    name = F.create_map(*[F.lit(x) for k, v in _XE_NAMES.items() for x in (k, v)])[F.col("event_type")]

    def node(kind: str, key: str, value):
        return F.coalesce(F.concat(F.lit(f'<{kind} name="{key}"><value>'), value.cast("string"), F.lit(f"</value></{kind}>")), F.lit(""))

    text = F.when(F.col("event_type").isin(3, -3), node("data", "batch_text", _escaped(F.col("sql_text")))).otherwise(node("data", "statement", _escaped(F.col("sql_text"))))
    fields = [node("data", k, F.col(c)) for k, c in (("cpu_time", "cpu"), ("duration", "duration"), ("logical_reads", "reads"), ("writes", "writes"))]
    actions = [node("action", k, F.col(c)) for k, c in (("event_sequence", "event_sequence"), ("session_id", "session_id"), ("client_app_name", "client_app_name"), ("client_hostname", "client_host_name"), ("database_name", "database_name"), ("server_principal_name", "server_principal_name"))]
    head = F.concat(F.lit('<event name="'), name, F.lit('" timestamp="'), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z">'))
    return df.select(F.concat(head, text, *fields, *actions, F.lit("</event>")).alias("event_data"))


@_query("xe_events", _with(f"SELECT {_CAP_COLUMNS} FROM cap"))
def _(s, d):
    return parsers.parse_xe(xe_documents(events(s, d, spread=True)))


_CLASSES = {2: 11, -3: 13, 1: 10, 3: 12}


def trace_rows(df: DataFrame) -> DataFrame:
    cls = F.create_map(*[F.lit(x) for k, v in _CLASSES.items() for x in (k, v)])[F.col("event_type")]
    return df.select(
        cls.alias("EventClass"), F.col("client_app_name").alias("ApplicationName"), F.col("database_name").alias("DatabaseName"), F.col("client_host_name").alias("HostName"), F.col("server_principal_name").alias("LoginName"),
        F.col("session_id").alias("SPID"), F.col("sql_text").alias("TextData"), F.col("start_time").alias("StartTime"), F.col("reads").alias("Reads"), F.col("writes").alias("Writes"), F.col("cpu").alias("CPU"), F.col("duration").alias("Duration"), F.col("event_sequence").alias("EventSequence"),
    )


@_query("trace_events", _with(f"SELECT {_CAP_COLUMNS.replace('cpu', 'cpu * 1000 AS cpu')} FROM cap"))
def _(s, d):
    return parsers.parse_trace(trace_rows(events(s, d)))


def _xe(name, *fields):
    """An XML event of one kind; fields are (kind, key, value)."""
    nodes = [F.coalesce(F.concat(F.lit(f'<{kind} name="{key}"><value>'), value.cast("string"), F.lit(f"</value></{kind}>")), F.lit("")) for kind, key, value in fields]
    return F.concat(F.lit(f'<event name="{name}" timestamp="'), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z">'), *nodes, F.lit("</event>"))


@_query("reset_login_text", _with(f"SELECT event_sequence, 2 AS event_type, '{parsers.NONPOOLED}' AS sql_text FROM cap WHERE session_id % 2 = 1"))
def _(s, d):
    """Logins: those from a pool are no events, others reset their connection."""
    login = _xe("login", ("data", "is_cached", F.when(F.col("session_id") % 2 == 0, "true").otherwise("false")), ("action", "event_sequence", F.col("event_sequence")))
    return parsers.parse_xe(events(s, d, spread=True).select(login.alias("event_data"))).select("event_sequence", "event_type", "sql_text")


@_query("user_error_events", _with(f"""SELECT event_sequence, CASE WHEN session_id % 3 = 0 THEN 7 ELSE 5 END AS event_type, client_host_name AS sql_text, CASE WHEN session_id % 3 = 0 THEN 0 ELSE session_id * 1000000 END::BIGINT AS cpu,
   CASE WHEN session_id % 3 = 0 THEN 0 ELSE session_id * 1000000 END::BIGINT AS duration FROM cap WHERE session_id % 3 < 2"""))
def _(s, d):
    """User events: errors, timeouts of the capture tool, and timeouts of other tools, which go."""
    third, session = F.col("session_id") % 3, F.col("session_id").cast("string")
    mark = F.when(third == 1, F.concat(F.lit(parsers.TOOL_PREFIX + "Timeout["), session, F.lit("]"))).when(third == 2, F.concat(F.lit("other "), session))
    event = _xe("user_event", ("data", "event_id", F.when(third == 0, parsers.ERROR_EVENT).otherwise(parsers.TIMEOUT_EVENT)), ("data", "user_info", mark), ("data", "user_data", F.col("client_host_name")), ("action", "event_sequence", F.col("event_sequence")))
    return parsers.parse_xe(events(s, d, spread=True).select(event.alias("event_data"))).select("event_sequence", "event_type", "sql_text", "cpu", "duration")


@_query("with_ids", _with("""SELECT coalesce(i.id, -1) AS client_app_name_id, count(*) AS n FROM cap LEFT JOIN (SELECT row_number() OVER (ORDER BY f.a, f.b, name) - 1 AS id, name FROM (SELECT client_app_name AS name, min({'a': start_time, 'b': event_sequence}) AS f FROM cap WHERE client_app_name IS NOT NULL GROUP BY 1) x) i
   ON i.name = cap.client_app_name GROUP BY 1"""))
def _(s, d):
    e = events(s, d)
    return analysis.with_ids(e, analysis.assign_dictionary(e, "client_app_name"), "client_app_name").groupBy("client_app_name_id").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_queries(spark, sf_dir)
