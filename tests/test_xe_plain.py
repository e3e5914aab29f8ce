"""Events of the plain form are read by regular expressions, all others by from_xml, with the same rows."""

from pyspark.sql import functions as F

from quaylog.plans import queries as plans
from quaylog.sources import parsers

SF = "/root/testdata/sf0.001"
HEAD = '<event name="{}" package="sqlserver" timestamp="2024-01-01T00:00:01.500Z">'


def _data(name, value, kind="data", before="", after=""):
    return f'<{kind} name="{name}">{before}<value>{value}</value>{after}</{kind}>'


def _documents():
    values = (
        "", "  ", "a", " a  b \n", "\ta\t", "a \n", "a&amp;lt;b&lt;&gt;&quot;&apos;", "a]]>b", "a]]b]", "]", "]]", "a\rb\r\nc", "&#x0D;a&#x20;", "\x01", "\x00", "\x1f", "a\xa0  ", "￾", "a \x85 b\x7f\x9f", "\U0001f600 &amp;",
        "&lt; ", " &lt;", "&no;", "&", "<b>x</b>", "<!-- c -->x", "<![CDATA[x<y]]>", "name=\"session_id\"><value", "' \"", "x" * 100_000, "&lt;]" * 100_000, " " * 100_000 + "x y" * 50_000 + "\n" * 100_000, "12 ", "+7", "1e3",
    )
    number = '<type name="int32" package="package0"/>'
    bodies = [_data("statement", v) + _data("session_id", v, "action") for v in values] + [
        _data("statement", "x", before=number, after="<text>OK</text>"), _data("statement", "x", before=number.replace("/>", "></type>")), _data("statement", "x", after="<text> & </text>"), _data("statement", "x", after="<text><i/></text>"),
        _data("statement", "x") + _data("statement", "y"), _data("statement", "x") + _data("statement", "y", "action"), _data("statement", "y", "action") + _data("statement", "x"), _data("statement", "x") + _data("statement", ""),
        '<data name="statement"/>', '<data name="statement"><value/></data>', '<data name="statement"></data>', '<data name="statement" name="x"><value>y</value></data>', '<data package="p" name="statement"><value>y</value></data>',
        '<data name="statement" package="p"><value>y</value></data>', "<data name='statement'><value>y</value></data>", _data("statement", "x") + " \n", "text" + _data("statement", "x"), "", _data("statement", "x") * 2_000,
        _data("statement", "x")[:-1], _data("statement", "x") + "<other/>", _data("state&amp;ment", "x"), _data("statement", "x", "DATA"),
    ]
    kinds = ("rpc_completed", "login", "attention", "other", "user_event")
    docs = [HEAD.format(kinds[0]) + b + "</event>" for b in bodies] + [HEAD.format(k) + _data("is_cached", " true ") + _data("sql_text", " q&amp;") + _data("event_id", "82") + _data("user_info", "Capture.Timeout[3]") + "</event>" for k in kinds]
    one = docs[2]
    return docs + [f" {one}", f"{one}\n", f"{one}x", one + one, one.replace("event", "row"), one[:-3], "", None, one.replace(' package="sqlserver"', ' id="1" version="2"'), f'<?xml version="1.0"?>{one}', one.replace("2024", "&#50;024"), one.replace(".500Z", ".5+01:00")]


def _rows(spark):
    df = spark.createDataFrame(list(enumerate(_documents())), "i int, event_data string")
    return sorted(map(str, parsers.parse_xe(df).collect()))


def test_plain_events_are_read_as_from_xml_reads_them(spark, monkeypatch):
    got = _rows(spark)
    monkeypatch.setattr(parsers, "PLAIN", r"\A(?!)")
    assert got == _rows(spark) and len(got) > 60


def _struct(schema):
    return "struct<" + schema.replace(" string", ":string").replace(" array", ":array") + ">"


def test_plain_events_need_no_parser(spark, monkeypatch):
    """Setting up a parser for each event was most of the work."""
    want = plans.events(spark, SF).where("sql_text IS NOT NULL")
    monkeypatch.setattr(parsers.F, "from_xml", lambda xml, schema: F.lit(None).cast(_struct(schema)))
    got = plans.QUERIES["xe_events"](spark, SF).where("sql_text IS NOT NULL").select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_events_are_spread_before_they_are_widened(spark):
    """A file of one row group is one task's scan."""
    assert plans.events(spark, SF).rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert all(plans.QUERIES[q](spark, SF).rdd.getNumPartitions() >= 4 for q in ("xe_events", "reset_login_text", "user_error_events"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_methods_of_events_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = plans.QUERIES["xe_events"](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
