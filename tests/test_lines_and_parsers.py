"""Golden inputs for lines, severities, formats and parsers."""

import pytest
from pyspark.sql import functions as F

from embermill.functions.fields import field_float, field_get, field_string
from embermill.functions.lines import is_continuation, quick_timestamp
from embermill.functions.severity import parse_severity, severity_label, severity_number
from embermill.operators.formats import classify, lock_formats
from embermill.operators.parsers import parse_events


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in rows.withColumn("y", make(F.col("x"))).orderBy("i").collect()]


def events(spark, lines, fmt, **options):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq bigint, raw string")
    return parse_events(rows, F.lit(fmt), **options).orderBy("seq").collect()


def fields(row):
    return {f["key"]: f["value"] for f in row["fields"]}


def test_severity_spellings(spark):
    words = ["fatal", "CRITICAL", "E", "W", "verbose", "trace", "Warning", "dbg", "i", "t", "", None]
    assert column(spark, words, parse_severity) == [
        "fatal", "fatal", "error", "warn", "unknown", "trace", "warn", "debug", "info", "unknown", "unknown", "unknown",
    ]
    assert column(spark, ["trace", "fatal", "unknown"], severity_number) == [0, 5, 0]
    assert column(spark, ["err", "error"], severity_label) == ["???", "ERROR"]


def test_continuation_lines(spark):
    yes = ["  - tray 7 still wet", "\tpump=off", "at orchard.Valve", "Caused by: low tide", "Caused by a leak", "Traceback of the ferry", 'File "quay"',
           "... and so on", "}", "}, done", "]", "goroutine nine", "from lib/tide.rb:88", "from moor.py:3 in dock"]
    no = ["valve 3 opened", '[{"pump":1}]', "attic light on", "From moor.py:3", "", "from shore to shore", "causes: none", None]
    assert column(spark, yes + no, is_continuation) == [True] * len(yes) + [False] * len(no)


def test_quick_timestamps(spark):
    got = column(spark, [
        "2031-07-04T05:06:07.25+02:00 ferry", "2031-07-04 05:06:07 ferry", '{"ts":1940907967250,"dock":4}', '{"timestamp":   1940907967250}', "1940907967 ferry",
        "ferry at 2031-07-04", "2031-00-04T05:06:07", "2031-02-30T00:00:00", "19409079670 ferry", "", None, "2031-07-04T24:00:00", "2031-07-04T05:06:60",
    ], quick_timestamp)
    s = 1940907967
    assert got[:2] == [s * 10**9 + 25 * 10**7, s * 10**9]
    assert got[2:5] == [1940907967250 * 10**6] * 2 + [s * 10**9]
    assert got[5:7] == [None, None] and got[8:12] == [None] * 4
    assert got[7] == 1930176000 * 10**9  # rolls over to the second of March
    assert got[12] == (s + 53) * 10**9


JSON = [
    ('{"datetime":"2031-07-04T05:06:07Z","log_level":"Err","message":"gangway stuck","app":"ferry","trace_id":"berth/9"}', "error", "gangway stuck", "ferry", "berth/9"),
    ('{"service":"tide","time":"2031-07-04T05:06:07Z","request_id":"q.8","level":"WRN","body":"low \\u00e9tale"}', "warn", "low \u00e9tale", "tide", "q.8"),
    ('{"text":"pump primed","timestamp":1940907967250,"severity":"information","application":"orchard","traceId":"row 3"}', "info", "pump primed", "orchard", "row 3"),
    ('{"x-trace-id":"b2","component":"sluice","t":1940907967,"log":"gate at 40 %","lvl":"dbg"}', "debug", "gate at 40 %", "sluice", "b2"),
    ('{"lvl":"w","level":"f","msg":"first","msg":"second"}', "unknown", "second", None, None),
    ('{ }', "unknown", "{ }", None, None),
    ('{"severity":true,"log":"moored"}', "unknown", "moored", None, None),
    ('{"berths":[4,9],"open":false}', "unknown", '{"berths":[4,9],"open":false}', None, None),
    ('moored at dusk', "unknown", "moored at dusk", None, None),
]


def test_json(spark):
    rows = events(spark, [x[0] for x in JSON], "json")
    assert [(r["severity"], r["message"], r["service"], r["trace_id"]) for r in rows] == [x[1:] for x in JSON]
    assert rows[2]["ts_nanos"] == 1940907967250 * 10**6 and rows[3]["ts_nanos"] == 1940907967 * 10**9


def test_json_types(spark):
    (row,) = events(spark, ['{"log":"tide","depth":-7,"drift":2.5e-3,"open":false,"pilot":null,"berth":"north","box":{"crew":[2,{"mate":1}]}}'], "json")
    f = fields(row)
    assert {k: v["kind"] for k, v in f.items()} == {
        "depth": "int", "drift": "float", "open": "bool", "pilot": "null", "berth": "string", "box": "string",
    }
    assert f["depth"]["i"] == -7 and f["open"]["b"] is False and f["box"]["s"] == '{"crew":[2,{"mate":1}]}' and abs(f["drift"]["f"] - 0.0025) < 1e-12


LOGFMT = [
    ('depth=4.25 component=tide severity=warning text="water over sill" datetime=2031-07-04T05:06:07Z berth=north request_id=q.8', "warn", "water over sill", "tide", "q.8"),
    ('trace="berth/9" application=ferry log=moored loglevel=ERR t=1940907967', "error", "moored", "ferry", "berth/9"),
    ('body="gate shut" log_level=ftl app=sluice', "fatal", "gate shut", "sluice", None),
    ('lvl=inf msg="crew=2 mate=1" pilot=ann', "info", "crew=2 mate=1", None, None),
    ('message=early message=late component=quay severity=dbg', "debug", "late", "quay", None),
]


def test_logfmt(spark):
    rows = events(spark, [x[0] for x in LOGFMT], "logfmt")
    assert [(r["severity"], r["message"], r["service"], r["trace_id"]) for r in rows] == [x[1:] for x in LOGFMT]
    assert fields(rows[0])["depth"]["f"] == 4.25 and fields(rows[0])["berth"]["s"] == "north"
    assert rows[1]["ts_nanos"] == 1940907967 * 10**9
    (row,) = events(spark, ["crew=12 drift=.5 open=false tide=3m rope=\"40\" log=x"], "logfmt")
    assert {k: v["kind"] for k, v in fields(row).items()} == {"crew": "int", "drift": "float", "open": "bool", "tide": "string", "rope": "int"}


FREE = [
    ("2031-07-04T05:06:07.5Z FATAL [Sluice] gate torn off", "fatal", "Sluice", "gate torn off"),
    ("2031-07-04 05:06:07 dbg tide table read", "debug", None, "tide table read"),
    ("2031-07-04 05:06:07 [Warning] rope frayed", "warn", None, "rope frayed"),
    ("err no pilot", "error", None, "no pilot"),
    ("gulls on the quay", "unknown", None, "gulls on the quay"),
    ("1940907967 inf lamp lit", "info", None, "lamp lit"),
    ("2031-07-04T05:06:07-03:00 trace [Winch] turn 8", "trace", "Winch", "turn 8"),
    ("WRN: fog", "warn", None, "fog"),
    ("crit hull breached", "fatal", None, "hull breached"),
    ("errand run", "unknown", None, "errand run"),
    ("debug", "debug", None, "debug"),
    ("", "unknown", None, ""),
    ("  ", "unknown", None, "  "),
]


def test_free_text(spark):
    rows = events(spark, [x[0] for x in FREE], "unstructured")
    assert [(r["severity"], r["service"], r["message"]) for r in rows] == [x[1:] for x in FREE]


def test_syslog(spark):
    lines = [
        "<134>Jul  4 05:06:07 quay2 winchd[58]: turn 8 of 9",
        "Jul  4 05:06:08 quay3 moord[6]: <warn>  rope frayed",
        "Jul  4 05:06:09 quay4 tided: table read.",
        "<912>Jul  4 05:06:10 q m: error: adrift",
    ]
    rows = events(spark, lines, "syslog_bsd")
    assert [(r["severity"], r["service"]) for r in rows] == [("info", "winchd"), ("warn", "moord"), ("unknown", "tided"), ("error", "m")]
    assert fields(rows[0])["pid"]["i"] == 58 and fields(rows[0])["hostname"]["s"] == "quay2"
    assert rows[2]["message"] == "table read."
    line = '<165>1 2031-07-04T05:06:07.250Z quay.example winchd 58 TURN [rope@9 m="40"] turn 8'
    (row,) = events(spark, [line], "syslog_ietf")
    assert (row["severity"], row["service"], row["message"]) == ("info", "winchd", "turn 8") and row["ts_nanos"] == 1940907967250 * 10**6
    (old,) = events(spark, [line], "syslog_ietf", compat=True)
    assert fields(old)["hostname"]["s"] == "1"


FORMATS = [
    ('{"lvl":"dbg","log":"moored","berth":9}', "json"),
    ('time=2031-07-04T05:06:07Z level=error msg="gangway stuck" berth=9 crew=2', "logfmt"),
    ("2031-07-04 05:06:07 FATAL [Sluice] gate torn off", "unstructured"),
    ("berth=9 crew=2 drift=0.5 rope=40", "kv_pairs"),
    ("<134>Jul  4 05:06:07 quay2 winchd[58]: turn 8 of 9", "syslog_bsd"),
    ("<165>1 2031-07-04T05:06:07Z quay2 winchd 58 - - turn 8", "syslog_ietf"),
    ('192.0.2.9 - ann [04/Jul/2031:05:06:07 +0200] "POST /berths HTTP/1.1" 201 17', "clf"),
]


def test_formats(spark):
    assert column(spark, [x[0] for x in FORMATS], classify) == [x[1] for x in FORMATS]


def test_format_lock_ties_and_holds(spark):
    lines = ['{"log":"moored"}'] * 4 + ["gulls on the quay"] * 8
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "a b")], "source_id int, seq int, raw string")
    got = {(r["source_id"], r["seq"]): r["format"] for r in lock_formats(rows).collect()}
    assert {got[1, i] for i in range(12)} == {"json"} and got[2, 0] == "unstructured"


def test_field_lookup(spark):
    rows = parse_events(spark.createDataFrame([(0, "a=1 a=2 b=x c=1.5")], "seq bigint, raw string"), F.lit("kv_pairs"))
    f = F.col("fields")
    (r,) = rows.select(field_get(f, "a")["i"].alias("a"), field_string(f, "a").alias("s"), field_float(f, "a").alias("fa"), field_float(f, "b").alias("fb"), field_float(f, "c").alias("fc")).collect()
    assert tuple(r) == (1, None, 1.0, None, 1.5)


@pytest.mark.parametrize("fmt", ["json", "logfmt", "syslog_bsd", "syslog_ietf", "unstructured"])
def test_long_and_odd_lines(spark, fmt):
    lines = ["", " " * 3, "A" * 200_000, "=" * 5000, '"' * 5000, "[" * 5000, "a=" + "\\\"" * 5000, '{"msg":"' + "A" * 2000 + '"}']
    assert len(events(spark, lines, fmt)) == len(lines)
