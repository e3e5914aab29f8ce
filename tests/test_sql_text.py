import random

from pyspark.sql import functions as F

from quaylog.functions import sql_text

CASES = [
    ("exec dbo.add_order @customer=N'Ada',@item=N'778899'", "EXEC DBO.ADD_ORDER @CUSTOMER = {STR}, @ITEM = {STR}"),
    ("exec add_note @body=N'they''re late', @rating=4.5", "EXEC ADD_NOTE @BODY = {STR}, @RATING = {NUM}"),
    ("exec save_doc @xml=N'<order id=\"5\"><line qty=\"2\"/></order>'", "EXEC SAVE_DOC @XML = {STR}"),
    ("select a from t where id in (5,34) -- note", "SELECT A FROM T WHERE ID {IN}"),
    ("/* a /* b */ c */ select 'x -- y', 0xAF, -3", "SELECT {STR}, {BINARY}, {##}"),
    ("exec sp_reset_connection", None),
    ("exec sp_reset_connection /*Nonpooled*/", None),
    ("exec sp_cursorfetch 1,2,3", None),
    (None, ""),
    ("", ""),
    ("declare @p1 int set @p1=7 exec sp_prepare @p1 output,NULL,N'select ''a'' from t' select @p1", "{PREPARING} SELECT {STR} FROM T"),
    ("exec sp_prepexec @p1 output,N'@a int',N'select 1 from t'", "{PREPARED} SELECT 1 FROM T"),
    ("exec sp_cursoropen @p1 output,N'select * from t where a = 3'", "{CURSOR} SELECT * FROM T WHERE A = {##}"),
    ("EXEC sp_executesql N'select 1',N'@a int'", "SELECT {##}"),
    ("declare @t AS dbo insert x exec dbo.p1 @p=@t READONLY", "EXECUTE DBO.P1"),
]


def test_templates(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, sql_text string")
    got = {r["i"]: r["template"] for r in sql_text.normalize_sql(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_long_literals_do_not_overflow(spark):
    texts = ["select '" + "x" * 200_000 + "'", "select '" + "''" * 50_000 + "'", "x" * 1_100_000, "select 'open"]
    df = spark.createDataFrame([(t,) for t in texts], "sql_text string")
    got = [r["template"] for r in sql_text.normalize_sql(df).collect()]
    assert got[0] == "SELECT {STR}" and got[2] == "{SQL>1MB}" and got[3] == "SELECT 'OPEN" and len(got[1]) <= 4000


def scan_comments(text):
    """Comments by hand, sign by sign."""
    out, state, i = [], 0, 0
    while i < len(text):
        two, one = text[i : i + 2], text[i]
        if state == 0 and two in ("--", "/*"):
            state, i = (2 if two == "--" else 3), i + 2
            continue
        if state > 2:
            if two in ("/*", "*/"):
                state, i = (state + 1 if two == "/*" else 0 if state == 3 else state - 1), i + 2
            else:
                i += 1
            continue
        if state == 2 and one in "\r\n":
            state = 0
        if state != 2:
            out.append(one)
        if one == "'" and state < 2:
            state = 1 - state
        i += 1
    return "".join(out)


def test_comments(spark):
    rng = random.Random(1)
    parts = ["a", "'", "''", "--", "-", "/", "*", "/*", "*/", "\n", "\r", " ", "b c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a -- b\nc", "a /* b /* c */ d */ e", "'--' /* x", "'open -- x", "", "/*/ /* x */ */ y", "/*" * 300 + "x" + "*/" * 300 + "y", "/* /* */ */" * 2000 + "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", sql_text.strip_comments(F.col("t")).alias("s")).collect()
    assert all(r["s"] == scan_comments(r["t"]) for r in got)


def test_calls(spark):
    df = spark.createDataFrame([("declare @p1 int set @p1=42 exec sp_prepexec @p1 output",), ("exec sp_execute 12,3",), ("select " + "9" * 39,)], "t string")
    rows = df.select(sql_text.replay_text(F.col("t")).alias("r"), sql_text.call_kind(F.col("t")).alias("k"), sql_text.call_handle(F.col("t")).alias("h")).collect()
    assert rows[0]["r"] == "declare @p1 int set @p1=00 exec sp_prepexec @p1 output ; EXEC sp_unprepare @p1;"
    assert (rows[1]["k"], rows[1]["h"]) == ("SP_EXECUTE", 12)
    assert rows[2]["r"] == "select " + "9" * 39 + "E0"


def test_trimming_looks_at_ends_only(spark):
    rng = random.Random(3)
    texts = [None, "", " ", *sql_text.WHITE, *("".join(rng.choice(sql_text.WHITE + "ab​é") for _ in range(rng.randrange(9))) for _ in range(500)), "a" + " " * 100_000 + "b"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sql_text.trim_all(F.col("t")).alias("s"))
    assert all(r["s"] == (r["t"] and r["t"].strip(sql_text.WHITE)) for r in out.collect())
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_steps_that_are_left_out_change_nothing(spark):
    rng = random.Random(5)
    parts = ["A", " ", "  ", "\t", " ", "é", "'", "''", "N", "{STR}", "0X1F", "@B = 1", "IN (", "{##}", ")", ",", "= -1.5"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(12))),) for _ in range(2000)] + [(None,)], "t string")
    t = F.col("t")
    plain = F.replace(F.regexp_replace(F.replace(t, F.lit("''"), F.lit("{STR}")), r"'[^']*+(?:''[^']*+)*+'|'[^']*+'", "{STR}"), F.lit("N{STR}"), F.lit("{NSTR}"))
    plain = F.regexp_replace(F.regexp_replace(plain, "0X[0-9ABCDEF]++", "{BINARY}"), r"([(\s,=\-><!&|+*/%~$])[-.\d]++", r"$1{##}")
    pairs = [(sql_text.constants(t), plain)] + [(sql_text._where(sign, step)(t), step(t)) for sign, step in (("@", sql_text.param_values), ("{", sql_text.in_lists), (",", sql_text.spread_csv))]
    pairs.append((F.when(sql_text._uneven(t), sql_text.collapse_spaces(t)).otherwise(t), sql_text.collapse_spaces(t)))
    for one, other in pairs:
        assert df.where(~one.eqNullSafe(other)).isEmpty()


def test_methods_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    from quaylog.operators import analysis, partials
    from quaylog.sources import adapter

    events = adapter.workload_events(spark, "/root/testdata/sf0.001").withColumn("interval_id", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no stages before it runs
    try:
        stages = partials.partials(analysis.templated(events))._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
