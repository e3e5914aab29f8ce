"""Filters of capture events and of report points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types. Fixed values.
BATCH_STARTING, MESSAGE, RPC_COMPLETED, RPC_STARTING, BATCH_COMPLETED, COUNTER, TIMEOUT, WAIT_STATS, ERROR, DISK_PERF = -3, 0, 1, 2, 3, 4, 5, 6, 7, 8
STARTS, COMPLETIONS = (RPC_STARTING, BATCH_STARTING), (RPC_COMPLETED, BATCH_COMPLETED)
ALWAYS_KEPT = (COUNTER, TIMEOUT, WAIT_STATS, ERROR, DISK_PERF)

#: Parts of statements that a capture skips. Fixed values, compared with case.
SKIPPED_PARTS = ("sp_cursor ", "sp_cursorfetch ", "sp_cursorclose ", "sp_cursoroption ", "sp_cursorunprepare ", "fn_xe_file_target_read_file", "ALTER EVENT SESSION", "fn_trace_getinfo")
SKIPPED_STARTS = ("KILL", "insert bulk")

#: Wait types that mean an idle server. Fixed values.
BENIGN_WAITS = tuple(
    """BROKER_EVENTHANDLER BROKER_RECEIVE_WAITFOR BROKER_TASK_STOP BROKER_TO_FLUSH BROKER_TRANSMITTER CHECKPOINT_QUEUE CHKPT CLR_AUTO_EVENT CLR_MANUAL_EVENT
    CLR_SEMAPHORE DBMIRROR_DBM_EVENT DBMIRROR_EVENTS_QUEUE DBMIRROR_WORKER_QUEUE DBMIRRORING_CMD DIRTY_PAGE_POLL DISPATCHER_QUEUE_SEMAPHORE EXECSYNC FSAGENT
    FT_IFTS_SCHEDULER_IDLE_WAIT FT_IFTSHC_MUTEX HADR_CLUSAPI_CALL HADR_FILESTREAM_IOMGR_IOCOMPLETION HADR_LOGCAPTURE_WAIT HADR_NOTIFICATION_DEQUEUE HADR_TIMER_TASK
    HADR_WORK_QUEUE KSOURCE_WAKEUP LAZYWRITER_SLEEP LOGMGR_QUEUE MEMORY_ALLOCATION_EXT ONDEMAND_TASK_QUEUE PARALLEL_REDO_DRAIN_WORKER PARALLEL_REDO_LOG_CACHE
    PARALLEL_REDO_TRAN_LIST PARALLEL_REDO_WORKER_SYNC PARALLEL_REDO_WORKER_WAIT_WORK PREEMPTIVE_HADR_LEASE_MECHANISM PREEMPTIVE_SP_SERVER_DIAGNOSTICS
    PREEMPTIVE_OS_LIBRARYOPS PREEMPTIVE_OS_COMOPS PREEMPTIVE_OS_CRYPTOPS PREEMPTIVE_OS_PIPEOPS PREEMPTIVE_OS_AUTHENTICATIONOPS PREEMPTIVE_OS_GENERICOPS
    PREEMPTIVE_OS_VERIFYTRUST PREEMPTIVE_OS_FILEOPS PREEMPTIVE_OS_DEVICEOPS PREEMPTIVE_OS_QUERYREGISTRY PREEMPTIVE_OS_WRITEFILE PREEMPTIVE_XE_CALLBACKEXECUTE
    PREEMPTIVE_XE_DISPATCHER PREEMPTIVE_XE_GETTARGETSTATE PREEMPTIVE_XE_SESSIONCOMMIT PREEMPTIVE_XE_TARGETINIT PREEMPTIVE_XE_TARGETFINALIZE
    PWAIT_ALL_COMPONENTS_INITIALIZED PWAIT_DIRECTLOGCONSUMER_GETNEXT QDS_PERSIST_TASK_MAIN_LOOP_SLEEP QDS_ASYNC_QUEUE
    QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP REQUEST_FOR_DEADLOCK_SEARCH RESOURCE_QUEUE SERVER_IDLE_CHECK SLEEP_BPOOL_FLUSH SLEEP_DBSTARTUP SLEEP_DCOMSTARTUP
    SLEEP_MASTERDBREADY SLEEP_MASTERMDREADY SLEEP_MASTERUPGRADED SLEEP_MSDBSTARTUP SLEEP_SYSTEMTASK SLEEP_TASK SLEEP_TEMPDBSTARTUP SNI_HTTP_ACCEPT
    SP_SERVER_DIAGNOSTICS_SLEEP SQLTRACE_BUFFER_FLUSH SQLTRACE_INCREMENTAL_FLUSH_SLEEP SQLTRACE_WAIT_ENTRIES WAIT_FOR_RESULTS WAITFOR WAITFOR_TASKSHUTDOWN
    WAIT_XTP_HOST_WAIT WAIT_XTP_OFFLINE_CKPT_NEW_LOG WAIT_XTP_CKPT_CLOSE WAIT_XTP_RECOVERY XE_BUFFERMGR_ALLPROCESSED_EVENT XE_DISPATCHER_JOIN XE_DISPATCHER_WAIT
    XE_LIVE_TARGET_TVF XE_TIMER_EVENT""".split()
)


def name_filter(column: Column, names: list[str]) -> Column:
    """True where a name passes: any of the plain names, or, if there are none, none of the
    ``^`` ones. Case doesn't matter; a null name fails plain names and passes negated ones."""
    wanted = [n.lower() for n in names if not n.startswith("^")]
    if wanted:
        return F.coalesce(F.lower(column).isin(wanted), F.lit(False))
    unwanted = [n[1:].lower() for n in names]
    return F.coalesce(~F.lower(column).isin(unwanted), F.lit(True)) if unwanted else F.lit(True)


def filter_events(df: DataFrame, app: list[str] = (), db: list[str] = (), host: list[str] = (), login: list[str] = ()) -> DataFrame:
    """Events that pass all four filters; other kinds than executions always do."""
    columns = (("client_app_name", app), ("database_name", db), ("client_host_name", host), ("server_principal_name", login))
    passes = reduce(lambda a, b: a & b, [name_filter(F.col(c), list(n)) for c, n in columns if n], F.lit(True))
    return df.where(passes | F.col("event_type").isin(*ALWAYS_KEPT))


def filter_event_types(df: DataFrame) -> DataFrame:
    """Starting and completed batches and calls, and all other kinds but messages of unknown type."""
    return df.where(F.col("event_type").isin(*STARTS, *COMPLETIONS, *ALWAYS_KEPT, MESSAGE))


def is_skipped(text: Column) -> Column:
    parts = [text.contains(p) for p in SKIPPED_PARTS] + [text.startswith(p) for p in SKIPPED_STARTS]
    return F.coalesce(text, F.lit("")).eqNullSafe("") | reduce(lambda a, b: a | b, parts)


def skip_internal(df: DataFrame) -> DataFrame:
    return df.where(~is_skipped(F.col("sql_text")))


def drop_empty_executions(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.length("sql_text"), F.lit(0)) > 0)


def drop_noise_templates(df: DataFrame) -> DataFrame:
    return df.where(F.col("template").isNotNull())


def filter_waits(df: DataFrame) -> DataFrame:
    return df.where(~F.col("wait_type").isin(*BENIGN_WAITS) & (F.col("wait_count") > 0) & (F.col("wait_sec") > 0))


def time_bounded(df: DataFrame, start_at: str, minutes: int = 0) -> DataFrame:
    """Events from ``start_at`` on, for ``minutes`` (0: without end)."""
    begin = F.lit(start_at).cast("timestamp_ntz")
    df = df.where(F.col("start_time") >= begin)
    return df.where(F.col("start_time") < F.timestamp_add("MINUTE", F.lit(minutes), begin)) if minutes else df


def filter_points(points: DataFrame, apps=None, hosts=None, dbs=None, logins=None, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Points of the chosen names (None: all) with lo <= offset <= hi; a negative lo counts as 0."""
    for column, names in (("application", apps), ("host", hosts), ("database", dbs), ("login", logins)):
        if names is not None:
            points = points.where(F.col(column).isin(list(names)))
    points = points.where(F.col("event_offset") >= max(0, lo))
    return points.where(F.col("event_offset") <= hi) if hi is not None else points


def map_database(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Databases renamed by a map; names that it lacks stay."""
    if not mapping:
        return df
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("database_name", F.coalesce(names[F.col("database_name")], F.col("database_name")))
