"""Event rows from Extended Events XML and from trace rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylog.functions.barrier import once
from quaylog.functions.sql_text import clean_text, decode_utf16, timeout_duration

#: Text given to a login that isn't pooled.
NONPOOLED = "exec sp_reset_connection /*Nonpooled*/"
XE_SCHEMA = "_name string, _timestamp string, data array<struct<_name:string,value:string>>, action array<struct<_name:string,value:string>>"
#: Events as servers write them: fields, then actions, each a name and one text without markup. Possessive, so linear and without
#: recursion. Attributes are fixed, as one that is given twice is an error; so is "]]>" in a text. Signs are listed, as ranges are slower.
_SIGN = r"[^<&\]" + "".join(rf"\x{i:02x}" for i in range(32) if chr(i) not in "\t\n") + "]"
_TEXT = rf"{_SIGN}*+(?:(?:&(?:lt|gt|amp|quot|apos);|\](?!\]>)){_SIGN}*+)*+"
_BODY = rf'(?: package="\w*+")?+>(?:<type name="\w*+" package="\w*+"(?:/>|></type>))?+<value>{_TEXT}</value>(?:<text>{_TEXT}</text>)?+</'
PLAIN = (
    r'\A<event name="\w++"(?: package="\w*+")?+(?: id="\d++")?+(?: version="\d++")?+ timestamp="[\w:.+-]*+">'
    + "".join(rf'(?:<{kind} name="\w++"{_BODY}{kind}>)*+' for kind in ("data", "action"))
    + r"</event>\z"
)
#: Of a plain event's nodes the names, in their order, and the texts, without the white space around them.
DATA_NAME, ACTION_NAME, VALUE = r'<data name="(\w++)', r'<action name="(\w++)', r"<value>[ \t\n]*+((?:[^< \t\n]++|[ \t\n]++(?!<))*+)"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
#: The fields and actions that events are made of. Fixed values.
FIELDS = (
    "event_id", "user_info", "user_data", "statement", "batch_text", "sql_text", "is_cached", "duration", "cpu_time", "logical_reads", "writes", "event_sequence",
    "client_app_name", "client_hostname", "database_name", "username", "server_principal_name", "session_id",
)
#: Event types by event name and by trace class. Fixed values.
XE_TYPES = {"sql_batch_completed": 3, "rpc_completed": 1, "sql_batch_starting": -3, "rpc_starting": 2, "login": 2, "attention": 5, "user_event": 7}
TRACE_TYPES = {10: 1, 11: 2, 12: 3, 13: -3, 14: 2, 82: 5}
ERROR_EVENT, TIMEOUT_EVENT = 83, 82
#: What the marks of a capture tool's own timeout events begin with; give that of the tool that took the capture.
TOOL_PREFIX = "Capture."


def _decoded(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def parse_xe(df: DataFrame, xml_col: str = "event_data", tool_prefix: str = TOOL_PREFIX) -> DataFrame:
    """One row per event of a kind that is known; pooled logins and other tools' timeouts are gone.

    The XML is parsed once; of fields and actions of one name the last counts. Columns that
    ``df`` has besides the XML stay. A parser is set up for each text, which is most of its cost, so
    events of the plain form are read by regular expressions, and all others by ``from_xml``, with the same rows.
    """
    known = F.create_map(*[F.lit(x) for k, v in XE_TYPES.items() for x in (k, v)])
    xml, plain = F.col(xml_col), F.col("_plain")
    d = df.withColumn("_plain", once(F.coalesce(xml.rlike(PLAIN), F.lit(False))))
    d = d.withColumn("_x", once(F.when(~plain, F.from_xml(xml, XE_SCHEMA))))
    head = {"_event": (F.regexp_extract(xml, r'name="(\w++)"', 1), "_x._name"), "_time": (F.regexp_extract(xml, r' timestamp="([^"]*+)"', 1), "_x._timestamp")}
    d = d.withColumns({k: once(F.when(plain, v).otherwise(F.col(x))) for k, (v, x) in head.items()})
    d = d.withColumn("_type", known[F.col("_event")]).where("_type IS NOT NULL")
    none = F.array().cast("array<struct<_name:string,value:string>>")
    d = d.withColumn("_nodes", once(F.when(~plain, F.concat(F.coalesce("_x.data", none), F.coalesce("_x.action", none)))))
    all_of = lambda pattern: F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))
    both = {"_names": (F.concat(all_of(DATA_NAME), all_of(ACTION_NAME)), "_nodes._name"), "_values": (all_of(VALUE), "_nodes.value")}
    d = d.withColumns({k: once(F.reverse(F.when(plain, v).otherwise(F.col(x)))) for k, (v, x) in both.items()})
    # in a step of their own: together with what uses them they are a method of more than the 8,000 bytes that the JVM compiles
    fields = F.array(*(F.get("_values", (F.array_position("_names", name) - 1).cast("int")) for name in FIELDS))
    d = d.withColumn("_fields", once(F.when(plain & xml.contains("&"), F.transform(fields, _decoded)).otherwise(fields)))

    def field(name: str) -> Column:
        return F.get("_fields", F.lit(FIELDS.index(name)))

    def number(name: str, kind: str = "long") -> Column:
        return field(name).try_cast(kind)

    name, user_id = F.col("_event"), number("event_id", "int")
    ours = F.coalesce(field("user_info"), F.lit("")).startswith(tool_prefix)
    kind = F.when((name == "user_event") & (user_id == TIMEOUT_EVENT), F.when(ours, 5)).otherwise(F.col("_type"))
    timeout, error = F.col("event_type") == 5, F.col("event_type") == 7
    text = (
        F.when(name == "login", NONPOOLED)
        .when(name == "user_event", field("user_data"))
        .when(F.col("_type").isin(1, 2), field("statement"))
        .when(F.col("_type").isin(3, -3), field("batch_text"))
        .otherwise(field("sql_text"))
    )
    d = d.withColumn("event_type", kind).where((name != "login") | (F.lower(F.coalesce(field("is_cached"), F.lit("false"))) != "true")).where("event_type IS NOT NULL")
    duration = F.when(error & (name == "user_event"), 0).when(timeout & (name == "user_event"), timeout_duration(field("user_info"))).otherwise(number("duration"))
    extra = [c for c in df.columns if c != xml_col]
    return d.withColumn("_duration", duration.cast("long")).select(
        *extra,
        number("event_sequence").alias("event_sequence"),
        "event_type",
        F.to_timestamp_ntz(F.regexp_replace("_time", r"(Z|[+-]\d\d:?\d\d)$", "")).alias("start_time"),
        field("client_app_name").alias("client_app_name"),
        field("client_hostname").alias("client_host_name"),
        field("database_name").alias("database_name"),
        F.coalesce(field("username"), field("server_principal_name")).alias("server_principal_name"),
        number("session_id", "int").alias("session_id"),
        clean_text(text).alias("sql_text"),
        F.when(error & (name == "user_event"), F.lit(0).cast("long")).when(timeout, F.col("_duration")).otherwise(number("cpu_time")).alias("cpu"),
        F.col("_duration").alias("duration"),
        number("logical_reads").alias("reads"),
        number("writes").alias("writes"),
    )


def parse_trace(df: DataFrame, tool_prefix: str = TOOL_PREFIX) -> DataFrame:
    """One row per trace row of a known class. Columns are found by name in any case; those
    that a trace lacks are null."""
    have = {c.lower(): c for c in df.columns}

    def column(name: str, kind: str) -> Column:
        return F.col(have[name.lower()]).cast(kind) if name.lower() in have else F.lit(None).cast(kind)

    known = F.create_map(*[F.lit(x) for k, v in TRACE_TYPES.items() for x in (k, v)])
    cls, data = column("EventClass", "int"), column("TextData", "string")
    d = df.withColumn("event_type", known[cls]).where("event_type IS NOT NULL")
    d = d.where((cls != 14) | (column("EventSubClass", "int") == 1)).where((cls != 82) | data.startswith(f"{tool_prefix}Timeout["))
    timeout = F.col("event_type") == 5
    text = F.when(cls == 14, NONPOOLED).when(timeout, F.coalesce(decode_utf16(column("BinaryData", "binary")), data)).otherwise(data)
    lasted = timeout_duration(data)
    return d.select(
        F.when(~timeout, column("EventSequence", "long")).alias("event_sequence"),
        "event_type",
        column("StartTime", "timestamp_ntz").alias("start_time"),
        column("ApplicationName", "string").alias("client_app_name"),
        column("HostName", "string").alias("client_host_name"),
        column("DatabaseName", "string").alias("database_name"),
        column("LoginName", "string").alias("server_principal_name"),
        column("SPID", "int").alias("session_id"),
        clean_text(text).alias("sql_text"),
        F.when(timeout, lasted).otherwise(column("CPU", "long") * 1000).alias("cpu"),
        F.when(timeout, lasted).otherwise(column("Duration", "long")).alias("duration"),
        F.when(~timeout, column("Reads", "long")).alias("reads"),
        F.when(~timeout, column("Writes", "long")).alias("writes"),
    )


def check_trace_format(df: DataFrame) -> bool:
    """Whether one of the first 100 rows has a sequence number and a session."""
    return not df.limit(100).where("EventSequence IS NOT NULL AND SPID IS NOT NULL").isEmpty()
