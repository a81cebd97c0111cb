"""One query for each operator over the driver's tables, with its DuckDB equivalent.

Log lines are rendered from ``events``; oracles select the original columns, so
they do not depend on the parsers.  Time intervals fit the data (hours, days).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.functions import fields as fld
from embermill.functions import lines as ln
from embermill.functions import severity as sev
from embermill.operators import anomaly, correlate, filters, formats, groups, parsers, stats, templates, traces
from embermill.plans import render
from embermill.sources import text as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3600, 86400
#: The last instant of the generated events' month, the "now" of all reports.
NOW = "2024-01-31 00:00:00"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


EV = """WITH ev AS (SELECT event_id AS seq, ts, user_id, event_type, value, props,
 epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'debug' ELSE 'info' END AS severity,
 CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 2 END AS sev_num,
 event_type || '-svc' AS service, 't' || user_id AS trace_id, user_id % 4 AS source_id,
 event_type || ' by user ' || user_id || ' took ' || CAST(floor(value) AS BIGINT) || 'ms' AS message,
 event_type || ' by user <*> took <*>' AS template FROM events)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    kind = F.col("event_type")
    return rows.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        "user_id",
        "event_type",
        "value",
        F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", "debug").otherwise("info").alias("level"),
        F.concat(kind, F.lit("-svc")).alias("svc"),
        F.concat(F.lit("t"), F.col("user_id")).alias("trace"),
        (F.col("user_id") % 4).alias("source_id"),
        F.concat(kind, F.lit(" by user "), F.col("user_id"), F.lit(" took "), F.floor("value"), F.lit("ms")).alias("msg"),
    )


#: What groups and traces use of an event: the rest is not parsed for them.
_GROUPED = ("severity", "message", "service", "ts_nanos")
_TRACED = ("severity", "trace_id", "ts_nanos")


def _iso():
    return F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def logfmt(rows: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("ts="), _iso(), F.lit(" level="), F.col("level"), F.lit(' msg="'), F.col("msg"), F.lit('" service='), F.col("svc"),
        F.lit(" trace_id="), F.col("trace"), F.lit(" value="), F.col("value").cast("string"), F.lit(" n="), F.col("seq"), F.lit(" ok=true"),
    )
    return rows.withColumn("raw", line)


def json_line(rows: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit('{"ts":'), F.unix_millis("at"), F.lit(',"level":"'), F.col("level"), F.lit('","msg":"'), F.col("msg"), F.lit('","service":"'),
        F.col("svc"), F.lit('","trace_id":"'), F.col("trace"), F.lit('","value":'), F.col("value").cast("string"), F.lit(',"n":'), F.col("seq"),
        F.lit(',"ok":true,"extra":null,"tags":{"a":1}}'),
    )
    return rows.withColumn("raw", line)


def _pri():
    level = F.col("level")
    return F.when(level == "error", 131).when(level == "warn", 132).when(level == "debug", 135).otherwise(134)


def bsd_line(rows: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("<"), _pri(), F.lit(">"), F.date_format("at", "MMM dd HH:mm:ss"), F.lit(" host"), F.col("source_id"), F.lit(" "), F.col("svc"),
        F.lit("["), F.col("user_id"), F.lit("]: "), F.col("msg"),
    )
    return rows.withColumn("raw", line)


def ietf_line(rows: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("<"), _pri(), F.lit(">1 "), _iso(), F.lit(" host"), F.col("source_id"), F.lit(" "), F.col("svc"), F.lit(" "), F.col("user_id"),
        F.lit(' ID1 [x@1 k="v"] '), F.col("msg"),
    )
    return rows.withColumn("raw", line)


def free_line(rows: DataFrame) -> DataFrame:
    line = F.concat(_iso(), F.lit(" "), F.upper("level"), F.lit(" ["), F.col("svc"), F.lit("] "), F.col("msg"))
    return rows.withColumn("raw", line)


def kv_line(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", F.concat(F.lit("user="), F.col("user_id"), F.lit(" kind="), F.col("event_type"), F.lit(" cost="), F.col("value").cast("string")))


def mixed(rows: DataFrame) -> DataFrame:
    """A format for each fifth of the users."""
    own = rows
    for i, f in enumerate((json_line, logfmt, bsd_line, free_line, kv_line)):
        own = f(own).withColumnRenamed("raw", f"raw{i}")
    pick = F.get(F.array(*[F.col(f"raw{i}") for i in range(5)]), (F.col("user_id") % 5).cast("int"))
    return own.withColumn("raw", pick).drop(*[f"raw{i}" for i in range(5)])


def parsed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events as parsed from their logfmt lines: the table that most queries branch off. ``columns``: those used (all)."""
    rows = logfmt(events(spark, sf_dir)).select("source_id", "seq", "raw")
    return parsers.parse_events(rows, F.lit("logfmt"), columns=columns or tuple(parsers.COLUMNS))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.split_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])


DOC_LINES = """WITH dl AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS raw FROM (
 SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(
 CASE WHEN text LIKE '%' || chr(10) THEN left(text, len(text) - 1) ELSE text END, chr(10)) END AS l FROM documents)))
"""

# ------------------------------------------------------------------ sources


@query(DOC_LINES + "SELECT doc_id, count(*) AS n_lines, CAST(sum(len(raw)) AS BIGINT) AS n_chars FROM dl GROUP BY doc_id")
def scan_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("raw")).cast("bigint").alias("n_chars"))


@query(DOC_LINES + "SELECT doc_id, line_no, raw FROM dl")
def line_split(spark, sf_dir):
    return doc_lines(spark, sf_dir)


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http%/_%1'")
def glob_match(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.where(F.col("url").rlike(src.glob_regex("http*/?*1"))).select("page_id", "url")


@query(EV + "SELECT seq AS event_id, source_id, message AS raw, row_number() OVER (ORDER BY us, source_id, seq) AS merged FROM ev")
def merge_sources(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("at").alias("ts"), "source_id", F.col("seq").alias("event_id"), F.col("msg").alias("raw"))
    parts = [rows.where(F.col("source_id") == i) for i in range(4)]
    merged = src.merge_sources(*parts, order=("ts", "source_id", "event_id"))
    return merged.select("event_id", "source_id", "raw", F.col("seq").alias("merged"))


@query(EV + "SELECT seq, service FROM ev ORDER BY seq DESC LIMIT 256")
def ring_last_n(spark, sf_dir):
    return src.ring(events(spark, sf_dir).select("seq", F.col("svc").alias("service")), 256)


@query(EV + "SELECT seq, CASE source_id WHEN 0 THEN 'api' WHEN 1 THEN 'web' WHEN 2 THEN 'db' ELSE '<unknown>' END AS source_name FROM ev")
def source_lookup(spark, sf_dir):
    registry = spark.createDataFrame([(0, "api"), (1, "web"), (2, "db")], "source_id bigint, name string")
    return src.name_sources(events(spark, sf_dir), registry).select("seq", "source_name")


# ------------------------------------------------------------------ lines


@query(DOC_LINES + r"""SELECT doc_id, line_no, coalesce(regexp_matches(raw, '^( |\t|at |Caused by[: ]|Traceback |File "|\.\.\. |goroutine |\}|\])')
 OR (starts_with(raw, 'from ') AND (contains(raw, '.rb:') OR contains(raw, '.py:'))), false) AS continuation FROM dl""")
def continuation_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", ln.is_continuation(F.col("raw")).alias("continuation"))


@query(EV + "SELECT seq, us * 1000 AS iso, us // 1000 * 1000000 AS ms, s * 1000000000 AS sec, CAST(NULL AS BIGINT) AS none FROM ev")
def quick_timestamp(spark, sf_dir):
    rows = events(spark, sf_dir)
    q = ln.quick_timestamp
    return rows.select(
        "seq",
        q(F.concat(_iso(), F.lit(" x"))).alias("iso"),
        q(F.concat(F.lit('{"ts": '), F.unix_millis("at"), F.lit("}"))).alias("ms"),
        q(F.concat(F.unix_seconds("at"), F.lit(" ERROR x"))).alias("sec"),
        q(F.col("msg")).alias("none"),
    )


@query(EV + """SELECT seq, severity AS plain, severity AS upper, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warn' WHEN 'debug' THEN 'unknown' ELSE 'info' END AS letter, 'unknown' AS other FROM ev""")
def severity_parse(spark, sf_dir):
    p = sev.parse_severity
    return events(spark, sf_dir).select(
        "seq", p(F.col("level")).alias("plain"), p(F.concat(F.upper("level"), F.lit("ING"))).alias("upper"),
        p(F.substr("level", F.lit(1), F.lit(1))).alias("letter"), p(F.concat(F.lit("x"), F.col("level"))).alias("other"),
    )


@query(EV + "SELECT seq, upper(severity) AS label, CAST(sev_num AS INTEGER) AS number, '???' AS none FROM ev")
def severity_label(spark, sf_dir):
    return events(spark, sf_dir).select(
        "seq", sev.severity_label(F.col("level")).alias("label"), sev.severity_number(F.col("level")).cast("int").alias("number"),
        sev.severity_label(F.col("svc")).alias("none"),
    )


@query(EV + "SELECT seq, us * 1000 - lag(us) OVER (PARTITION BY trace_id ORDER BY us, seq) * 1000 AS elapsed_ns, trace_id FROM ev")
def event_order(spark, sf_dir):
    from pyspark.sql import Window as W

    before = F.lag("ts_nanos").over(W.partitionBy("trace_id").orderBy("ts_nanos", "seq"))
    return parsed(spark, sf_dir).select("seq", (F.col("ts_nanos") - before).alias("elapsed_ns"), "trace_id")


@query(EV + "SELECT seq, seq AS n, CAST(seq AS DOUBLE) AS n_float, value, CAST(NULL AS VARCHAR) AS missing, true AS ok FROM ev")
def field_get(spark, sf_dir):
    f = F.col("fields")
    return parsed(spark, sf_dir).select(
        "seq", fld.field_get(f, "n")["i"].alias("n"), fld.field_float(f, "n").alias("n_float"), fld.field_float(f, "value").alias("value"),
        fld.field_string(f, "nothing").alias("missing"), fld.field_get(f, "ok")["b"].alias("ok"),
    )


# ------------------------------------------------------------------ formats and parsers

_FORMAT = "CASE user_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' WHEN 2 THEN 'syslog_bsd' WHEN 3 THEN 'unstructured' ELSE 'kv_pairs' END"


@query(EV + f"SELECT seq, {_FORMAT} AS format FROM ev")
def format_classify(spark, sf_dir):
    return mixed(events(spark, sf_dir)).select("seq", formats.classify(F.col("raw")).alias("format"))


@query(EV + f"""SELECT seq, {_FORMAT} AS format FROM ev""")
def format_lock(spark, sf_dir):
    rows = mixed(events(spark, sf_dir)).withColumn("source_id", F.col("user_id") % 5)
    return formats.lock_formats(rows).select("seq", "format")


@query(EV + """SELECT seq, CASE WHEN user_id % 5 IN (0, 1, 2, 3) THEN severity ELSE 'unknown' END AS severity,
 CASE WHEN user_id % 5 = 4 THEN NULL ELSE service END AS service, CASE WHEN user_id % 5 < 2 THEN trace_id END AS trace_id FROM ev""")
def parse_dispatch(spark, sf_dir):
    rows = mixed(events(spark, sf_dir)).withColumn("format", formats.classify(F.col("raw")))
    return parsers.parse_events(rows).select("seq", "severity", "service", "trace_id")


_CORE = "seq, severity, CAST(sev_num AS INTEGER) AS sev_num, message, trace_id, service"


@query(EV + f"SELECT {_CORE}, us // 1000 * 1000000 AS ts_nanos, 5 AS n_fields FROM ev")
def parse_json(spark, sf_dir):
    out = parsers.parse_events(json_line(events(spark, sf_dir)), F.lit("json"))
    return out.select("seq", "severity", F.col("sev_num").cast("int").alias("sev_num"), "message", "trace_id", "service", "ts_nanos", F.size("fields").alias("n_fields"))


@query(EV + "SELECT seq, us // 1000 * 1000000 AS from_ms, s * 1000000000 AS from_s, us * 1000 AS from_text FROM ev")
def json_timestamp(spark, sf_dir):
    t = parsers.json_timestamp
    rows = events(spark, sf_dir)
    return rows.select(
        "seq", t(F.lit("int"), F.unix_millis("at").cast("string")).alias("from_ms"), t(F.lit("int"), F.unix_seconds("at").cast("string")).alias("from_s"),
        t(F.lit("string"), _iso()).alias("from_text"),
    )


@query(EV + """SELECT seq, 'float' AS value_kind, value, 'int' AS n_kind, seq AS n, 'bool' AS ok_kind, 'null' AS extra_kind, 'string' AS tags_kind, '{"a":1}' AS tags FROM ev""")
def json_field_types(spark, sf_dir):
    out = parsers.parse_events(json_line(events(spark, sf_dir)), F.lit("json"))
    g = lambda k: fld.field_get(F.col("fields"), k)
    value = F.coalesce(g("value")["f"], g("value")["i"].cast("double"))
    return out.select(
        "seq", F.when(g("value")["kind"].isin("int", "float"), "float").alias("value_kind"), value.alias("value"), g("n")["kind"].alias("n_kind"),
        g("n")["i"].alias("n"), g("ok")["kind"].alias("ok_kind"), g("extra")["kind"].alias("extra_kind"), g("tags")["kind"].alias("tags_kind"), g("tags")["s"].alias("tags"),
    )


@query(EV + f"SELECT {_CORE}, us * 1000 AS ts_nanos, 3 AS n_fields FROM ev")
def parse_kv(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "seq", "severity", F.col("sev_num").cast("int").alias("sev_num"), "message", "trace_id", "service", "ts_nanos", F.size("fields").alias("n_fields")
    )


@query(EV + "SELECT seq, 'float' AS value_kind, value, 'int' AS n_kind, seq AS n, 'bool' AS ok_kind, true AS ok FROM ev")
def kv_field_types(spark, sf_dir):
    g = lambda k: fld.field_get(F.col("fields"), k)
    return parsed(spark, sf_dir).select(
        "seq", g("value")["kind"].alias("value_kind"), g("value")["f"].alias("value"), g("n")["kind"].alias("n_kind"), g("n")["i"].alias("n"),
        g("ok")["kind"].alias("ok_kind"), g("ok")["b"].alias("ok"),
    )


_SYSLOG = "SELECT seq, severity, message, service, 'host' || source_id AS hostname, user_id AS pid FROM ev"


def _syslog_columns(out):
    f = F.col("fields")
    return out.select("seq", "severity", "message", "service", fld.field_string(f, "hostname").alias("hostname"), fld.field_get(f, "pid")["i"].alias("pid"))


@query(EV + _SYSLOG)
def parse_syslog(spark, sf_dir):
    return _syslog_columns(parsers.parse_events(bsd_line(events(spark, sf_dir)), F.lit("syslog_bsd")))


@query(EV + _SYSLOG)
def parse_syslog_ietf(spark, sf_dir):
    return _syslog_columns(parsers.parse_events(ietf_line(events(spark, sf_dir)), F.lit("syslog_ietf")))


@query("SELECT seq, pri, CASE WHEN pri > 255 THEN 'unknown' WHEN pri % 8 <= 2 THEN 'fatal' WHEN pri % 8 = 3 THEN 'error' WHEN pri % 8 = 4 THEN 'warn' WHEN pri % 8 <= 6 THEN 'info' ELSE 'debug' END AS severity FROM (SELECT event_id AS seq, event_id % 300 AS pri FROM events)")
def syslog_pri(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", (F.col("seq") % 300).alias("pri"))
    return rows.withColumn("severity", parsers.pri_severity(F.col("pri")))


@query(EV + "SELECT seq, severity AS marked, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warn' ELSE 'unknown' END AS plain FROM ev")
def syslog_infer_sev(spark, sf_dir):
    i = parsers.infer_severity
    return events(spark, sf_dir).select(
        "seq", i(F.concat(F.lit("<"), F.col("level"), F.lit("> "), F.col("msg"))).alias("marked"), i(F.concat(F.upper("level"), F.lit(" "), F.col("msg"))).alias("plain")
    )


@query(EV + "SELECT seq, severity, message, service, us * 1000 AS ts_nanos FROM ev")
def parse_fallback(spark, sf_dir):
    out = parsers.parse_events(free_line(events(spark, sf_dir)), F.lit("unstructured"))
    return out.select("seq", "severity", "message", "service", "ts_nanos")


_SCHEMA = """, f AS (SELECT source_id, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS k FROM ev), t AS (SELECT source_id, count(*) AS n FROM f WHERE k <= 64 GROUP BY source_id)
SELECT source_id, key, n AS occurrences, main_type, CAST(1.0 AS DOUBLE) AS frequency, main_type <> 'bool' AS is_numeric FROM t, (VALUES ('value', 'float'), ('n', 'int'), ('ok', 'bool')) v(key, main_type)"""


@query(EV + _SCHEMA)
def schema_infer(spark, sf_dir):
    return formats.infer_schema(parsed(spark, sf_dir, "fields")).select("source_id", "key", "occurrences", "main_type", "frequency", "is_numeric")


@query(EV + _SCHEMA)
def schema_stable(spark, sf_dir):
    return formats.stable_fields(formats.infer_schema(parsed(spark, sf_dir, "fields"))).select(
        "source_id", "key", "occurrences", "main_type", "frequency", "is_numeric"
    )


# ------------------------------------------------------------------ filters


def _filter(name: str, predicate: Callable[[], filters.Predicate], where: str) -> None:
    def run(spark, sf_dir):
        return filters.display(parsed(spark, sf_dir), predicate()).select("seq", "severity", "service")

    QUERIES[name] = run
    ORACLES[name] = EV + f"SELECT seq, severity, service FROM ev WHERE {where}"


_c = filters.clause
_filter("filter_severity_gte", lambda: filters.all_of(_c("severity_gte", "warn")), "sev_num >= 3")
_filter("filter_severity_eq", lambda: filters.all_of(_c("severity_eq", "debug")), "severity = 'debug'")
_filter("filter_service_eq", lambda: filters.all_of(_c("service_eq", "click-svc")), "service = 'click-svc'")
_filter("filter_trace_id", lambda: filters.all_of(_c("trace_id_eq", "t7")), "trace_id = 't7'")
_filter("filter_message_contains", lambda: filters.all_of(_c("message_contains", "user 1")), "contains(message, 'user 1')")
_filter("filter_field_eq", lambda: filters.all_of(_c("field_eq", "n", "42")), "seq = 42")
_filter("filter_field_cmp", lambda: filters.all_of(_c("field_gt", "value", 100.0), _c("field_lt", "value", 200.0)), "value > 100 AND value < 200")
_filter("filter_and", lambda: filters.all_of(_c("severity_gte", "warn"), _c("message_contains", "purchase")), "sev_num >= 3 AND contains(message, 'purchase')")
_filter("filter_or", lambda: filters.any_of(_c("severity_gte", "error"), _c("service_eq", "view-svc")), "sev_num >= 4 OR service = 'view-svc'")
_filter("filter_not", lambda: filters.all_of(~_c("service_eq", "view-svc"), ~_c("field_gt", "nothing", 1.0)), "service <> 'view-svc'")
_filter("intent_errors", lambda: filters.parse_intent("show errors related to users"), "sev_num >= 4 AND contains(message, 'user')")
_filter("intent_service", lambda: filters.parse_intent("warnings from purchase-svc"), "sev_num >= 3 AND service = 'purchase-svc'")
_filter("intent_failing", lambda: filters.parse_intent("why is signup down"), "sev_num >= 4 AND contains(message, 'signup') AND contains(message, 'down')")
_filter("intent_words", lambda: filters.parse_intent("clicks over 30s service:click-svc"), "service = 'click-svc' AND contains(message, 'click')")


@query(EV + f"SELECT seq, severity, service FROM ev WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def filter_last(spark, sf_dir):
    since = filters.last(F.lit(NOW).cast("timestamp"), filters.parse_duration("7d"))
    return filters.display(parsed(spark, sf_dir, "severity", "service", "ts_nanos"), since=since).select("seq", "severity", "service")


@query(EV + f"SELECT seq, severity, service FROM ev WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND sev_num >= 2 AND contains(message, 'click')")
def display_filter(spark, sf_dir):
    since = filters.last(F.lit(NOW).cast("timestamp"), filters.parse_duration("72h"))
    return filters.display(parsed(spark, sf_dir, *_GROUPED), filters.all_of(_c("message_contains", "click")), "info", since).select("seq", "severity", "service")


# ------------------------------------------------------------------ templates

_TOKENS = "list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda t: t <> '')[1:64]"
_MASKED = f"list_transform({_TOKENS}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') OR (len(t) >= 2 AND starts_with(t, '\"') AND ends_with(t, '\"')) THEN '<*>' ELSE left(t, 48) END)"


def _talk(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query(f"SELECT conv_id, turn, array_to_string({_TOKENS}, '|') AS tokens, CAST(len({_TOKENS}) AS INTEGER) AS n FROM conversations")
def tokenize(spark, sf_dir):
    t = templates.tokenize(F.col("text"))
    return _talk(spark, sf_dir).select("conv_id", "turn", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n"))


@query(f"SELECT conv_id, turn, array_to_string({_MASKED}, ' ') AS template FROM conversations")
def template_mask(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", templates.template(F.col("text")).alias("template"))


@query("""SELECT a.event_type AS l, b.event_type AS r, CASE WHEN a.event_type = b.event_type THEN 1.0 ELSE round(5.0 / 6, 6) END AS similarity
 FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b""")
def template_similarity(spark, sf_dir):
    names = groups.with_template(parsed(spark, sf_dir, "message")).select("template").distinct().withColumn("tokens", F.split("template", " "))
    one = names.select(F.col("tokens").alias("a"), F.lit(1).alias("k"))
    two = names.select(F.col("tokens").alias("b"), F.lit(1).alias("k"))
    both = one.join(two, "k")
    return both.select(F.get("a", 0).alias("l"), F.get("b", 0).alias("r"), F.round(templates.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def _fnv(text: str) -> str:
    return f"""CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({text} || ' ', ''), lambda c: CAST(ord(c) AS UHUGEINT))),
 lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR)"""


@query(EV + f"SELECT DISTINCT template, {_fnv('template')} AS template_hash FROM ev")
def template_hash(spark, sf_dir):
    names = groups.with_template(parsed(spark, sf_dir, "message")).select("template").distinct()
    return names.withColumn("template_hash", templates.template_hash(F.col("template")).cast("string"))


@query(EV + "SELECT seq, severity, service FROM ev WHERE template = 'click by user <*> took <*>'")
def filter_template(spark, sf_dir):
    rows = groups.with_template(parsed(spark, sf_dir))
    rows = rows.withColumn("template_hash", templates.template_hash(F.col("template")))
    wanted = templates.template_hash(F.lit("click by user <*> took <*>"))
    return rows.where(F.col("template_hash") == wanted).select("seq", "severity", "service")


@query(EV + f"SELECT seq, '<*> by user <*> took <*>' AS template, {_fnv(chr(39) + '<*> by user <*> took <*>' + chr(39))} AS template_hash FROM ev")
def drain_templates(spark, sf_dir):
    out = templates.drain_templates(parsed(spark, sf_dir, "message"))
    return out.select("seq", "template", F.col("template_hash").cast("string").alias("template_hash"))


@query()
def drain_documents(spark, sf_dir):
    """The fold over free text lines; no SQL form: tests hold it against a scalar model."""
    rows = doc_lines(spark, sf_dir).withColumn("seq", F.col("doc_id") * 1_000_000 + F.col("line_no"))
    out = templates.drain_templates(rows, "raw", hash_mode="as_emitted")
    return out.select("seq", "template", F.col("template_hash").cast("string").alias("template_hash"))


# ------------------------------------------------------------------ groups

_GROUPS = """, g AS (SELECT template, count(*) AS count, arg_min(message, seq) AS exemplar, arg_min(service, seq) AS service, max(sev_num) AS max_sev,
 any_value(severity) AS severity, count(DISTINCT source_id) AS source_count, min(us) AS first_us, max(us) AS last_us,
 CAST(sum(CASE WHEN s // 86400 = epoch_us(TIMESTAMP '2024-01-30') // 1000000 // 86400 THEN 1 ELSE 0 END) AS BIGINT) AS count_short,
 CAST(sum(CASE WHEN s // 86400 = epoch_us(TIMESTAMP '2024-01-29') // 1000000 // 86400 THEN 1 ELSE 0 END) AS BIGINT) AS count_prev_short
 FROM ev GROUP BY template), tr AS (SELECT *, CASE WHEN count_prev_short = 0 AND count_short = 0 THEN 'gone' WHEN count_prev_short = 0 THEN 'new'
 WHEN count_short / count_prev_short > 1.5 THEN 'rising' WHEN count_short / count_prev_short < 0.67 THEN 'falling' ELSE 'stable' END AS trend FROM g),
 sc AS (SELECT *, exp(-(epoch_us(TIMESTAMP '2024-01-30 23:59:59') / 1e6 - last_us / 1e6) / 86400.0) * log2(count_short + 1.0) * CASE severity WHEN 'debug' THEN 0.2 WHEN 'info' THEN 0.5
 WHEN 'warn' THEN 2.0 ELSE 5.0 END * CASE trend WHEN 'rising' THEN 2.0 WHEN 'new' THEN 1.5 WHEN 'stable' THEN 1.0 WHEN 'falling' THEN 0.7 ELSE 0.1 END * log2(source_count + 1.0) AS score FROM tr)
"""
_LATE = "2024-01-30 23:59:59"


def _scored(spark, sf_dir, rows=None):
    import datetime

    now = datetime.datetime(2024, 1, 30, 23, 59, 59, tzinfo=datetime.timezone.utc)
    return groups.scored_groups(parsed(spark, sf_dir, *_GROUPED) if rows is None else rows, DAY, float(DAY), now)


@query(EV + f"SELECT {_fnv('template')} AS template_hash, template, count(*) AS count FROM ev GROUP BY template")
def group_by_template(spark, sf_dir):
    return groups.group_stats(parsed(spark, sf_dir, *_GROUPED)).select(F.col("template_hash").cast("string").alias("template_hash"), "template", "count")


@query(EV + _GROUPS + "SELECT template, count, exemplar, service, severity, source_count, first_us, last_us FROM g")
def group_stats(spark, sf_dir):
    return groups.group_stats(parsed(spark, sf_dir, *_GROUPED)).select(
        "template", "count", "exemplar", "service", "severity", "source_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us")
    )


@query(EV + _GROUPS + "SELECT template, count_short, count_prev_short FROM g")
def group_windows(spark, sf_dir):
    return groups.group_windows(groups.with_template(parsed(spark, sf_dir, "message", "ts_nanos")), F.lit(_LATE).cast("timestamp"), DAY)


@query(EV + _GROUPS + "SELECT template, trend FROM tr")
def group_trend(spark, sf_dir):
    return _scored(spark, sf_dir).select("template", "trend")


@query(EV + _GROUPS + "SELECT template, round(score, 6) AS score FROM sc")
def group_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("template", F.round("score", 6).alias("score"))


@query(EV + _GROUPS + "SELECT template, count, exemplar, severity, trend, source_count, round(score, 6) AS score FROM sc ORDER BY score DESC, template LIMIT 20")
def top_groups(spark, sf_dir):
    return groups.top_groups(_scored(spark, sf_dir)).select(
        "template", "count", "exemplar", "severity", "trend", "source_count", F.round("score", 6).alias("score")
    )


@query(EV + "SELECT service, count(DISTINCT source_id) AS sources FROM ev GROUP BY service")
def source_set(spark, sf_dir):
    return parsed(spark, sf_dir, "service").groupBy("service").agg(F.count_distinct("source_id").alias("sources"))


@query(EV + """SELECT count(*) AS events_total, count(DISTINCT template) AS groups, count(DISTINCT trace_id) AS traces, CAST(0 AS BIGINT) AS drops,
 round(count(*) / ((max(us) - min(us)) / 1e6), 9) AS events_per_sec FROM ev""")
def pipeline_stats(spark, sf_dir):
    return groups.pipeline_stats(parsed(spark, sf_dir, "message", "trace_id", "ts_nanos")).withColumn("events_per_sec", F.round("events_per_sec", 9))


# ------------------------------------------------------------------ statistics

_SERIES = ", ser AS (SELECT s // 3600 * 3600 AS tick, CAST(count(*) AS DOUBLE) AS sample FROM ev GROUP BY 1)"


def _series(spark, sf_dir, rows=None):
    # Some hundred ticks; detectors that read it in one plan share its shuffle.
    return anomaly.rate_series(parsed(spark, sf_dir, "ts_nanos") if rows is None else rows, HOUR)


@query(EV + _SERIES + " SELECT tick, sample FROM ser")
def rate_series(spark, sf_dir):
    return _series(spark, sf_dir)


_EWMA = EV.replace("WITH ev", "WITH RECURSIVE ev") + _SERIES + """, num AS (SELECT tick, sample, row_number() OVER (ORDER BY tick) AS k FROM ser),
 ew AS (SELECT k, tick, sample, sample AS fast, sample AS slow FROM num WHERE k = 1 UNION ALL SELECT n.k, n.tick, n.sample,
 n.sample * (1 - pow(1 - {fast}, (n.tick - e.tick) / 3600.0)) + e.fast * pow(1 - {fast}, (n.tick - e.tick) / 3600.0),
 n.sample * (1 - pow(1 - {slow}, (n.tick - e.tick) / 3600.0)) + e.slow * pow(1 - {slow}, (n.tick - e.tick) / 3600.0) FROM ew e JOIN num n ON n.k = e.k + 1)
""".format(fast=stats.ewma_alpha(10, 1), slow=stats.ewma_alpha(300, 1))


@query(_EWMA + "SELECT tick, sample, round(fast, 6) AS ewma FROM ew")
def ewma(spark, sf_dir):
    out = stats.ewma(_series(spark, sf_dir), "tick", "sample", stats.ewma_alpha(10, 1), HOUR)
    return out.withColumn("ewma", F.round("ewma", 6))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def streaming_stats(spark, sf_dir):
    out = stats.streaming_stats(events(spark, sf_dir), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "stddev")})


_Z = """, zz AS (SELECT tick, sample, count(*) OVER w AS n, avg(sample) OVER w AS m, stddev_samp(sample) OVER w AS sd FROM ser
 WINDOW w AS (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), z AS (SELECT tick, sample, CASE WHEN n >= 2 AND sd > 0 THEN (sample - m) / sd END AS z, n + 1 AS seen FROM zz)
"""


@query(EV + _SERIES + _Z + "SELECT tick, sample, round(z, 6) AS z FROM z")
def zscore(spark, sf_dir):
    return stats.running_zscore(_series(spark, sf_dir), "tick", "sample").withColumn("z", F.round("z", 6))


@query(EV + _SERIES + _Z + "SELECT tick, round(1 - 1 / (1 + 0.1 * z * z), 6) AS score FROM z")
def zscore_norm(spark, sf_dir):
    z = stats.running_zscore(_series(spark, sf_dir), "tick", "sample")
    return z.select("tick", F.round(stats.normalized_z(F.col("z")), 6).alias("score"))


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type")
def hll_distinct(spark, sf_dir):
    rows = events(spark, sf_dir)
    est = stats.hll_estimate(stats.hll_registers(rows, "user_id", ["event_type"]), ["event_type"])
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(est, "event_type").select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"))


@query("SELECT count(DISTINCT user_id) AS exact, true AS near FROM events")
def hll_merge(spark, sf_dir):
    rows = events(spark, sf_dir)
    merged = stats.hll_merge(stats.hll_registers(rows, "user_id", ["event_type"]), [])
    est = stats.hll_estimate(merged, []).withColumn("k", F.lit(1))
    exact = rows.agg(F.count_distinct("user_id").alias("exact")).withColumn("k", F.lit(1))
    return exact.join(est, "k").select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"))


@query("SELECT CAST(user_id AS VARCHAR) AS item, count(*) AS exact, true AS no_less, true AS near FROM events GROUP BY user_id")
def cms_frequency(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("item", F.col("user_id").cast("string"))
    exact = rows.groupBy("item").agg(F.count("*").alias("exact"))
    est = stats.cms_estimate(stats.cms_cells(rows, "item"), exact)
    total = rows.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    both = exact.join(est, "item").withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    return both.select("item", "exact", (F.col("estimate") >= F.col("exact")).alias("no_less"), (F.col("estimate") <= F.col("exact") + 0.001 * F.col("total") + 1).alias("near"))


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS item, count(*) AS n FROM events GROUP BY 1),
 p AS (SELECT r AS row, ('0x' || substr(md5(r || ':' || item), 1, 8))::BIGINT % 8192 AS cell, n FROM c, range(4) t(r))
 SELECT CAST(row AS INTEGER) AS row, cell, CAST(floor(sum(n) * 0.5) AS BIGINT) AS count FROM p GROUP BY 1, 2""")
def cms_decay(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("item", F.col("user_id").cast("string"))
    return stats.cms_decay(stats.cms_cells(rows, "item"), 0.5).select("row", "cell", "count")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def quantiles_exact(spark, sf_dir):
    out = stats.quantiles_exact(events(spark, sf_dir), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("SELECT event_type, true AS p50, true AS p95, true AS p99 FROM events GROUP BY event_type")
def quantiles_approx(spark, sf_dir):
    rows = events(spark, sf_dir)
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    span = [F.percentile("value", F.lit(min(1.0, max(0.0, q + d)))).alias(f"{n}_{i}") for n, q in at.items() for i, d in ((0, -0.01), (1, 0.01))]
    bounds = rows.groupBy("event_type").agg(*span)
    approx = stats.quantiles_approx(rows, "value", ["event_type"])
    return bounds.join(approx, "event_type").select("event_type", *[F.col(n).between(F.col(f"{n}_0"), F.col(f"{n}_1")).alias(n) for n in at])


@query("SELECT epoch_us(ts) // 1000000 // 86400 * 86400 AS start_s, count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def tumbling_bucket(spark, sf_dir):
    return stats.tumbling(events(spark, sf_dir), "at", "value", DAY).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


@query("""WITH b AS (SELECT epoch_us(ts) // 1000000 // 3600 * 3600 AS start_s, count(*) AS n FROM events GROUP BY 1)
 SELECT start_s, CAST(sum(n) OVER (ORDER BY start_s RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
 round(sum(n) OVER (ORDER BY start_s RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) / 86400.0, 9) AS rate FROM b""")
def time_window_rate(spark, sf_dir):
    return stats.window_rate(events(spark, sf_dir), "at", HOUR, 24).withColumn("rate", F.round("rate", 9))


def _words(text):
    return F.filter(F.split(text, "[ \t\n]+"), lambda t: t != "")


def signed(rows):
    """``rows`` with words, all of the text's, and their signature as sig."""
    return rows.withColumn("words", _words(F.col("text"))).withColumn("sig", stats.minhash_signature(F.col("words")))


@query("SELECT conv_id, turn, true AS whole, true AS same FROM conversations")
def minhash_signature(spark, sf_dir):
    """Whole texts are signed; the signature has no SQL form: it must be that of the reversed words, merged from two parts."""
    again = F.reverse("words")
    head, tail = F.slice(again, 1, 64), F.slice(again, 65, F.greatest(F.size(again), F.lit(1)))
    merged = F.zip_with(stats.minhash_signature(head), stats.minhash_signature(tail), lambda a, b: F.least(a, b))
    return signed(_talk(spark, sf_dir)).select(
        "conv_id", "turn", (F.size("sig") == F.when(F.size("words") == 0, 0).otherwise(64)).alias("whole"), (F.col("sig") == merged).alias("same")
    )


@query()
def minhash_neardup(spark, sf_dir):
    """Copies with their class, and pairs of classes with near signatures; the hash has no SQL form: tests compare exact similarities."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", _words(F.col("text")).alias("tokens"))
    return stats.minhash_pairs(rows, "doc_id", "tokens", 0.9)


# ------------------------------------------------------------------ anomaly, correlation

_RATE = _EWMA + _Z.lstrip() + """, ra AS (SELECT z.tick, CASE WHEN z >= 3 THEN 'rate_spike' WHEN z <= -3 AND slow > 1 THEN 'rate_drop' END AS kind, 1 - 1 / (1 + 0.1 * z * z) AS score,
 z.sample AS observed, slow AS expected, z AS deviation FROM z JOIN ew ON z.tick = ew.tick WHERE seen >= 30 AND z IS NOT NULL AND abs(fast - slow) >= 1)
, rf AS (SELECT * FROM ra WHERE kind IS NOT NULL)
"""
_CU = """, cb AS (SELECT ew.k, ew.tick, ew.sample, slow AS mean, stddev_samp(ew.sample) OVER (ORDER BY ew.tick) AS sd FROM ew),
 cu AS (SELECT k, tick, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, 0 AS rest, NULL::VARCHAR AS kind, 0.0::DOUBLE AS score, sample AS observed, mean AS expected, 0.0::DOUBLE AS deviation FROM cb WHERE k = 1
 UNION ALL SELECT x.k, x.tick, CASE WHEN up THEN 0.0 ELSE nh END, CASE WHEN NOT up AND down THEN 0.0 ELSE nl END,
 CASE WHEN up OR down THEN 30 WHEN resting THEN rest - 1 ELSE rest END, CASE WHEN up THEN 'change_point_up' WHEN down THEN 'change_point_down' END,
 least(1.0, CASE WHEN up THEN nh ELSE nl END / 10), x.sample, x.mean, CASE WHEN up THEN n ELSE -n END
 FROM (SELECT *, live AND nh > 5 AS up, live AND NOT nh > 5 AND nl > 5 AS down FROM (SELECT *, CASE WHEN live THEN greatest(0.0, hi + n - 0.5) ELSE hi END AS nh,
 CASE WHEN live THEN greatest(0.0, lo - n - 0.5) ELSE lo END AS nl FROM (SELECT b.k, b.tick, b.sample, b.mean, c.hi, c.lo, c.rest, (b.sample - b.mean) / nullif(b.sd, 0) AS n,
 b.k >= 30 AND c.rest > 0 AS resting, b.k >= 30 AND c.rest <= 0 AND b.sd > 0 AS live FROM cu c JOIN cb b ON b.k = c.k + 1)))x)
, cf AS (SELECT tick, kind, score, observed, expected, deviation FROM cu WHERE kind IS NOT NULL)
"""
_FIRED = "SELECT tick, kind, round(score, 6) AS score, observed, round(expected, 6) AS expected, round(deviation, 6) AS deviation FROM "
_R, _U = anomaly.Rate(HOUR, 10.0 * HOUR, 300.0 * HOUR), anomaly.Cusum(HOUR, 300.0 * HOUR)


def _rounded(fired):
    return fired.withColumns({c: F.round(c, 6) for c in ("score", "expected", "deviation")})


@query(_RATE + _FIRED + "rf")
def rate_anomaly(spark, sf_dir):
    return _rounded(anomaly.rate_anomalies(_series(spark, sf_dir), _R))


@query(_RATE + _CU + _FIRED + "cf")
def cusum_anomaly(spark, sf_dir):
    return _rounded(anomaly.cusum_anomalies(_series(spark, sf_dir), _U))


_ALERTS = """, fi AS (SELECT * FROM rf UNION ALL SELECT * FROM cf), isl AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY tick) AS island FROM
 (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY kind ORDER BY tick) > 108000 THEN 1 WHEN lag(tick) OVER (PARTITION BY kind ORDER BY tick) IS NULL THEN 1 ELSE 0 END AS new FROM fi)),
 al AS (SELECT *, row_number() OVER (ORDER BY first_fired, kind) AS alert_id FROM (SELECT kind, min(tick) AS first_fired, max(tick) AS last_fired, count(*) AS fire_count, max(score) AS score,
 arg_max(observed, tick) AS observed, arg_min(expected, tick) AS expected FROM isl GROUP BY kind, island)),
 si AS (SELECT CASE kind WHEN 'rate_drop' THEN 'rate_change' ELSE 'anomaly_alert' END AS kind, tick AS onset, score AS magnitude,
 CASE WHEN starts_with(kind, 'change_point') THEN 'sustained rate shift' ELSE 'event rate anomaly' END AS label, kind AS detector FROM fi)
, co AS (SELECT *, row_number() OVER (PARTITION BY effect_id ORDER BY strength DESC, cause_peak, cause_kind, cause_label, cause_detector) AS rank FROM (
 SELECT a.alert_id AS effect_id, s.kind AS cause_kind, s.label AS cause_label, s.onset AS cause_peak, s.detector AS cause_detector, a.first_fired - s.onset AS lag,
 (1 - (a.first_fired - s.onset) / 1080000.0) * s.magnitude AS strength FROM al a JOIN si s ON a.first_fired - s.onset BETWEEN 0 AND 1080000
 WHERE NOT (s.onset = a.first_fired AND s.detector = a.kind)))
"""


def _firings(spark, sf_dir, rows=None):
    series = _series(spark, sf_dir, rows)
    return anomaly.rate_anomalies(series, _R).unionByName(anomaly.cusum_anomalies(series, _U))


def _alerts(spark, sf_dir, rows=None, now=None):
    return anomaly.alerts(_firings(spark, sf_dir, rows), now, 30 * HOUR)


def _causes(spark, sf_dir, rows=None):
    fired = _firings(spark, sf_dir, rows)
    effects = anomaly.alerts(fired, idle_s=30 * HOUR).select(
        F.col("alert_id").alias("effect_id"), F.col("first_fired").alias("e_onset"), F.col("kind").alias("e_detector")
    )
    return correlate.correlate(effects, correlate.alert_signals(fired), 300 * HOUR)


@query(_RATE + _CU + _ALERTS + "SELECT alert_id, kind, first_fired, last_fired, fire_count, round(score, 6) AS score, observed, round(expected, 6) AS expected FROM al")
def alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select(
        "alert_id", "kind", "first_fired", "last_fired", "fire_count", F.round("score", 6).alias("score"), "observed", F.round("expected", 6).alias("expected")
    )


_NOW_S = "epoch_us(TIMESTAMP '2024-01-30 23:59:59') // 1000000"


@query(_RATE + _CU + _ALERTS + f"SELECT alert_id, kind, CASE WHEN {_NOW_S} - last_fired > 108000 THEN 'resolved' ELSE 'active' END AS state FROM al")
def alert_state(spark, sf_dir):
    now = F.unix_seconds(F.lit(_LATE).cast("timestamp"))
    return _alerts(spark, sf_dir, now=now).select("alert_id", "kind", "state")


@query(EV + _GROUPS + f""", top AS (SELECT *, row_number() OVER (ORDER BY score DESC, exemplar) AS place FROM sc)
 SELECT 'group_spike' AS kind, {_NOW_S} AS onset, least(1.0, count_short / 100.0) AS magnitude, left(exemplar, 128) AS label FROM top WHERE place <= 5 AND trend = 'rising'""")
def group_signals(spark, sf_dir):
    now = F.unix_seconds(F.lit(_LATE).cast("timestamp"))
    return correlate.group_signals(_scored(spark, sf_dir).withColumn("tick", now)).select("kind", "onset", "magnitude", "label")


@query(_RATE + _CU + _ALERTS + "SELECT kind, onset, round(magnitude, 6) AS magnitude, label, detector FROM si")
def signals(spark, sf_dir):
    return correlate.alert_signals(_firings(spark, sf_dir)).select("kind", "onset", F.round("magnitude", 6).alias("magnitude"), "label", "detector")


@query(_RATE + _CU + _ALERTS + "SELECT effect_id, rank, cause_kind, cause_label, lag, round(strength, 6) AS strength FROM co WHERE rank <= 8")
def correlate_causes(spark, sf_dir):
    return _causes(spark, sf_dir).select("effect_id", F.col("rank").cast("bigint").alias("rank"), "cause_kind", "cause_label", "lag", F.round("strength", 6).alias("strength"))


@query(_RATE + _CU + _ALERTS + "SELECT effect_id, count(*) AS n_causes, round(max(strength), 6) AS confidence FROM co WHERE rank <= 8 GROUP BY effect_id")
def hypotheses(spark, sf_dir):
    return correlate.hypotheses(_causes(spark, sf_dir)).select("effect_id", "n_causes", F.round("confidence", 6).alias("confidence"))


@query("""WITH e AS (SELECT event_id AS l, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'error'), p AS (SELECT event_id AS r, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'purchase')
 SELECT l, r, e.s - p.s AS lag FROM e JOIN p ON e.s - p.s BETWEEN 0 AND 3600""")
def range_join(spark, sf_dir):
    rows = events(spark, sf_dir)
    effect = rows.where("event_type = 'error'").select(F.col("seq").alias("l"), F.unix_seconds("at").alias("es"))
    cause = rows.where("event_type = 'purchase'").select(F.col("seq").alias("r"), F.unix_seconds("at").alias("ps"))
    return correlate.range_join(effect, cause, "es", "ps", HOUR).select("l", "r", (F.col("es") - F.col("ps")).alias("lag"))


# ------------------------------------------------------------------ traces

_TRACES = """, p AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS place FROM ev), t AS (SELECT trace_id, count(*) AS event_count, arg_min(us, seq) AS started_us, max(us) AS ended_us,
 max(sev_num) AS max_sev FROM p WHERE place <= 64 GROUP BY trace_id)
"""


def _traces(spark, sf_dir, **options):
    return traces.traces(parsed(spark, sf_dir, *_TRACED), **options)


@query(EV + _TRACES + "SELECT trace_id, event_count, started_us, ended_us FROM t")
def trace_groups(spark, sf_dir):
    return _traces(spark, sf_dir).select("trace_id", "event_count", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


@query(EV + _TRACES + "SELECT trace_id, CASE WHEN event_count < 2 THEN 0 ELSE ended_us - started_us END AS duration_us FROM t")
def trace_duration(spark, sf_dir):
    return _traces(spark, sf_dir).select("trace_id", "duration_us")


@query(EV + _TRACES + "SELECT trace_id, CASE WHEN max_sev >= 4 THEN 'failure' ELSE 'unknown' END AS outcome FROM t")
def trace_outcome(spark, sf_dir):
    return _traces(spark, sf_dir).select("trace_id", "outcome")


@query(EV + _TRACES + "SELECT trace_id, CAST(place AS INTEGER) AS place, seq, severity, message, service FROM p WHERE place <= 64")
def trace_events(spark, sf_dir):
    return traces.trace_events(parsed(spark, sf_dir, *_TRACED, "message", "service"))


@query(EV + """, m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY trace_id ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS new FROM ev),
 i AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT trace_id, count(*) AS event_count, min(us) AS started_us, max(us) AS ended_us FROM i GROUP BY trace_id, k""")
def trace_sessions(spark, sf_dir):
    return traces.trace_sessions(parsed(spark, sf_dir, *_TRACED), 6 * HOUR).select("trace_id", "event_count", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


# ------------------------------------------------------------------ sinks


@query(EV + "SELECT seq, 'event' AS type, severity, message, service, trace_id, CAST(seq AS VARCHAR) AS n FROM ev")
def event_json(spark, sf_dir):
    out = render.event_json(parsed(spark, sf_dir))
    g = lambda k: F.get_json_object("json", f"$.{k}")
    return out.select("seq", *[g(k).alias(k) for k in ("type", "severity", "message", "service", "trace_id")], g("fields.n").alias("n"))


@query(_RATE + _CU + _ALERTS.rstrip() + _GROUPS.replace(", g AS", ", g AS", 1) + _TRACES + """SELECT (SELECT count(*) FROM ev) AS events_total, (SELECT least(20, count(*)) FROM g) AS n_groups,
 (SELECT least(128, count(*)) FROM al) AS n_alerts, (SELECT least(8, count(DISTINCT effect_id)) FROM co) AS n_hypotheses, (SELECT least(20, count(*)) FROM t WHERE max_sev >= 4) AS n_failed""")
def triage_summary(spark, sf_dir):
    # One parse, kept while the report of one row is made of it, and given up again.
    rows = groups.with_template(parsed(spark, sf_dir, *_GROUPED, "trace_id")).persist()
    n = lambda c: F.size(c).cast("bigint")
    try:
        out = render.triage_summary(
            rows, _scored(spark, sf_dir, rows), _alerts(spark, sf_dir, rows), correlate.hypotheses(_causes(spark, sf_dir, rows)), traces.traces(rows)
        ).select(
            F.col("stats.events_total").alias("events_total"), n("top_groups").alias("n_groups"), n("anomalies").alias("n_alerts"),
            n("hypotheses").alias("n_hypotheses"), n("failed_traces").alias("n_failed"),
        )
        return spark.createDataFrame(out.collect(), out.schema)
    finally:
        rows.unpersist()
