"""Line parsers as expressions: each gives one struct of an event's columns from a raw line."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embermill.functions.fields import ALIASES, FIELDS, KNOWN, inferred_kind, no_fields, value_of
from embermill.functions.lines import quick_timestamp
from embermill.functions.severity import parse_severity, severity_number


#: An event's columns as parsed, in order, with their types.
COLUMNS = {"severity": "string", "message": "string", "trace_id": "string", "service": "string", "fields": FIELDS, "ts_nanos": "bigint"}


def _event(columns: frozenset[str], **make: Callable[[], Column]) -> Column:
    """The wanted columns of an event as a struct."""
    return F.struct(*[make[c]().cast(COLUMNS[c]).alias(c) for c in COLUMNS if c in columns])


def _computed(df: DataFrame, value: Column) -> DataFrame:
    """``df`` with the members of a struct as columns, computed once.

    A generator over one struct is a border that neither projections nor filters
    are moved across, so nothing above it evaluates the parse again.
    """
    one = df.withColumn("_parse", value)
    return one.select(*[F.col(c) for c in df.columns], F.inline(F.array("_parse")))


def _null() -> Column:
    return F.lit(None)


# ------------------------------------------------------------------ JSON


ENTRIES = "array<struct<key:string,kind:string,text:string,nested:boolean>>"

# A member of an object, behind its brace or the last member's comma; containers of up to six levels.
_FLAT = r'(?:"(?:[^"\\]|\\.)*+"|[^"{}\[\]])*+'
_BOX = rf"[{{\[]{_FLAT}[}}\]]"
for _ in range(5):
    _BOX = rf"[{{\[]{_FLAT}(?:{_BOX}{_FLAT})*+[}}\]]"
_MEMBER = rf'(?:^\s*\{{|\G(?!^)\s*,)\s*"((?:[^"\\]|\\.)*+)"\s*:\s*("(?:[^"\\]|\\.)*+"|[-+0-9.eE]++(?=\s*[,}}]|\s*$)|true|false|null|{_BOX})'


def json_entries(line: Column) -> Column:
    """array<struct<key, kind, text, nested>> of a JSON object's top level; nested values are their text.

    A line that breaks off or is damaged gives the members in front of the damage.
    """
    parsed = F.from_json(line, "map<string,variant>")

    def entry(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        name = (
            F.when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), F.lit("int"))
            .when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), F.lit("float"))
            .when(kind == "BOOLEAN", F.lit("bool"))
            .when(kind == "VOID", F.lit("null"))
            .otherwise(F.lit("string"))
        )
        nested = kind.rlike("^(?:OBJECT|ARRAY)")
        text = F.when(nested, F.to_json(e["value"])).otherwise(F.try_variant_get(e["value"], "$", "string"))
        return F.struct(e["key"].alias("key"), name.alias("kind"), text.alias("text"), nested.alias("nested"))

    whole = F.transform(F.map_entries(parsed), entry)
    return F.coalesce(whole, _members(line))


def _members(line: Column) -> Column:
    """The members in front of an object's damage; none where there is no object."""

    def plain(quoted: Column) -> Column:
        return F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), 0)

    def entry(k: Column, v: Column) -> Column:
        first = F.left(v, F.lit(1))
        kind = (
            F.when(v.isin("true", "false"), F.lit("bool"))
            .when(v == "null", F.lit("null"))
            .when(first.isin('"', "{", "["), F.lit("string"))
            .when(v.try_cast("bigint").isNotNull() & ~v.rlike("[.eE]"), F.lit("int"))
            .otherwise(F.lit("float"))
        )
        text = F.when(first == '"', plain(v)).when(v != "null", v)
        return F.struct(
            plain(F.concat(F.lit('"'), k, F.lit('"'))).alias("key"), kind.alias("kind"), text.alias("text"), first.isin("{", "[").alias("nested")
        )

    part = lambda i: F.regexp_extract_all(line, F.lit(_MEMBER), F.lit(i))
    return F.zip_with(part(1), part(2), entry)


def json_timestamp(kind: Column, text: Column) -> Column:
    whole, real = text.try_cast("bigint"), text.try_cast("double")
    ms = F.when(whole > 946684800000, whole * 1_000_000).when(whole > 946684800, whole * 1_000_000_000)
    return (
        F.when(kind == "string", quick_timestamp(text))
        .when(kind == "int", ms)
        .when(kind == "float", (real * 1e9).cast("bigint"))
    )


def _last(keys: Column, values: Column, names: tuple[str, ...] | list[str]) -> Column:
    """The value of the last of these keys, from arrays in reverse order; null if there is none."""
    at = [F.nullif(F.array_position(keys, n), F.lit(0)) for n in names]
    return F.get(values, ((F.least(*at) if len(at) > 1 else at[0]) - 1).cast("int"))


def _json_event(line: Column, entries: Column, columns: frozenset[str]) -> Column:
    """Known keys by name (the last one wins, text only), the rest as fields in their order.

    A line that is not a JSON object keeps its raw text as the message.
    """
    back = F.reverse(entries)
    texts = F.reverse(F.filter(entries, lambda e: (e["kind"] == "string") & ~e["nested"]))

    def text_of(column: str) -> Column:
        return _last(texts["key"], texts["text"], ALIASES[column])

    stamp = [_last(back["key"], back[part], ALIASES["timestamp"]) for part in ("kind", "text")]
    fields = F.transform(
        F.slice(F.filter(entries, lambda e: ~e["key"].isin(*KNOWN)), 1, 64),
        lambda e: F.struct(e["key"].alias("key"), value_of(e["kind"], e["text"]).alias("value")),
    )
    return _event(
        columns,
        severity=lambda: F.coalesce(parse_severity(text_of("severity")), F.lit("unknown")),
        message=lambda: F.coalesce(text_of("message"), line),
        trace_id=lambda: text_of("trace_id"),
        service=lambda: text_of("service"),
        fields=lambda: fields,
        ts_nanos=lambda: F.coalesce(json_timestamp(*stamp), quick_timestamp(line)),
    )


# ------------------------------------------------------------------ key=value

# A key is tried where a run begins or a pair ended, so long runs stay linear.
_PAIR = r'(?:\G|(?<![^ =\t]))([^ =\t]++)=("[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^ \t]+)'


PAIRS = "struct<keys:array<string>,texts:array<string>>"


def kv_pairs(line: Column) -> Column:
    """struct<keys, texts>, in order; quotes are taken off, escapes stay as they are."""
    part = lambda i: F.regexp_extract_all(line, F.lit(_PAIR), F.lit(i))
    bare = lambda v: F.when(F.startswith(v, F.lit('"')), F.regexp_replace(v, r'^"|"$', "")).otherwise(v)
    return F.struct(part(1).alias("keys"), F.transform(part(2), bare).alias("texts"))


def _kv_event(line: Column, pairs: Column, columns: frozenset[str]) -> Column:
    aliases = {k: [a for a in v if a != "x-trace-id"] for k, v in ALIASES.items()}
    known = [a for v in aliases.values() for a in v]
    keys, texts = F.reverse(pairs["keys"]), F.reverse(pairs["texts"])

    def last(column: str) -> Column:
        return _last(keys, texts, aliases[column])

    both = F.zip_with(pairs["keys"], pairs["texts"], lambda k, v: F.struct(k.alias("key"), v.alias("text")))
    rest = F.slice(F.filter(both, lambda p: ~p["key"].isin(*known)), 1, 64)
    kinds = F.transform(rest, lambda p: F.struct(p["key"].alias("key"), p["text"].alias("text"), inferred_kind(p["text"]).alias("kind")))
    fields = F.transform(kinds, lambda p: F.struct(p["key"].alias("key"), value_of(p["kind"], p["text"]).alias("value")))
    return _event(
        columns,
        severity=lambda: F.coalesce(parse_severity(last("severity")), F.lit("unknown")),
        message=lambda: F.coalesce(last("message"), line),
        trace_id=lambda: last("trace_id"),
        service=lambda: last("service"),
        fields=lambda: fields,
        ts_nanos=lambda: F.coalesce(quick_timestamp(last("timestamp")), quick_timestamp(line)),
    )


# ------------------------------------------------------------------ syslog


def pri_severity(pri: Column) -> Column:
    level = F.pmod(pri, F.lit(8))
    name = (
        F.when(level <= 2, "fatal").when(level == 3, "error").when(level == 4, "warn").when(level <= 6, "info").otherwise("debug")
    )
    return F.when(pri.between(0, 255), name).otherwise("unknown")


def infer_severity(message: Column) -> Column:
    """From a message's own mark, where the header has none."""
    low = F.lower(F.substr(message, F.lit(1), F.lit(7)))
    out = F.lit("unknown")
    for mark, level in (("<error>", "error"), ("<warn>", "warn"), ("<info>", "info"), ("<debug>", "debug")):
        out = F.when(F.startswith(low, F.lit(mark)), F.lit(level)).otherwise(out)
    plain = F.when(low.rlike("^(?:error|err:)"), F.lit("error")).when(low.rlike("^warn"), F.lit("warn"))
    return F.when(out != "unknown", out).otherwise(F.coalesce(plain, F.lit("unknown")))


_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{8}(?:\.[0-9]+)?(?:Z|[+-][0-9:]+)?"
_BSD = rf"^(?:<([0-9]{{1,4}})>)?[ \t]*(?:{_ISO}|[A-Z][a-z]{{2}} [ 0-9][0-9] [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?[ \t]*([^ ]*)[ \t]*([^: \[]*)(?:\[([^\]]*)\]?)?:?[ \t]*(.*)$"
_IETF = rf"^<([0-9]{{1,4}})>[1-9][0-9]{{0,2}} ({_ISO}|-) ([^ ]+) ([^ ]+) ([^ ]+) [^ ]+ (?:-|(?:\[(?:[^\]\\]|\\.)*+\])+) ?(.*)$"


def _syslog(
    line: Column, columns: frozenset[str], pri: Column, host: Column, app: Column, pid: Column, message: Column, own_time: Column | None = None
) -> Column:
    level = F.when(pri != "", pri_severity(pri.try_cast("int"))).otherwise(F.lit("unknown"))
    empty = F.array().cast(FIELDS)
    host_field = F.array(F.struct(F.lit("hostname").alias("key"), value_of(F.lit("string"), host).alias("value")))
    pid_kind = F.when(pid.rlike(r"^[+-]?[0-9]+$"), F.lit("int")).otherwise(F.lit("string"))
    pid_field = F.array(F.struct(F.lit("pid").alias("key"), value_of(pid_kind, pid).alias("value")))
    fields = F.concat(
        F.when(host != "", host_field.cast(FIELDS)).otherwise(empty), F.when(pid != "", pid_field.cast(FIELDS)).otherwise(empty)
    )
    body = F.when(message != "", message).otherwise(line)
    return _event(
        columns,
        severity=lambda: F.when((level == "unknown") & (message != ""), infer_severity(message)).otherwise(level),
        message=lambda: body,
        trace_id=_null,
        service=lambda: F.when(app != "", app),
        fields=lambda: fields,
        ts_nanos=lambda: quick_timestamp(line) if own_time is None else F.coalesce(quick_timestamp(own_time), quick_timestamp(line)),
    )


def _syslog_bsd(line: Column, columns: frozenset[str]) -> Column:
    g = [F.regexp_extract(line, _BSD, i) for i in range(1, 6)]
    return _syslog(line, columns, *g)


def _syslog_ietf(line: Column, columns: frozenset[str]) -> Column:
    """Version, time stamp, host, application, process, message id and structured data, then the message."""
    dash = lambda c: F.when(c == "-", F.lit("")).otherwise(c)
    g = [F.regexp_extract(line, _IETF, i) for i in range(1, 7)]
    parsed = _syslog(line, columns, g[0], dash(g[2]), dash(g[3]), dash(g[4]), g[5], own_time=g[1])
    return F.when(line.rlike(_IETF), parsed).otherwise(_syslog_bsd(line, columns))


# ------------------------------------------------------------------ free text

_STAMP = rf"^(?:{_ISO}|[1-9][0-9]{{9}}(?=[ \t]|$))?[ \t]*"
_WORD = r"(?i)^(fatal|critical|crit|error|err|warning|warn|wrn|info|inf|debug|dbg|trace)(?=[ :\t\]]|$):?"


def _fallback(line: Column, columns: frozenset[str]) -> Column:
    rest = F.regexp_replace(line, _STAMP, "")
    boxed = F.regexp_extract(rest, r"^\[([^\]]{1,18})\]", 1)
    boxed_level = F.when(boxed != "", parse_severity(boxed)).otherwise(F.lit("unknown"))
    word = F.regexp_extract(rest, _WORD, 1)
    word_level = F.when(word != "", parse_severity(word)).otherwise(F.lit("unknown"))
    level = F.when(boxed_level != "unknown", boxed_level).otherwise(word_level)
    after = (
        F.when(boxed_level != "unknown", F.regexp_replace(rest, r"^\[[^\]]*\][ \t]*", ""))
        .when(word_level != "unknown", F.regexp_replace(rest, _WORD + r"[ \t]*", ""))
        .otherwise(rest)
    )
    service = F.regexp_extract(after, r"^\[([^\] ]{1,48})\]", 1)
    body = F.when(service != "", F.regexp_replace(after, r"^\[[^\]]*\][ \t]*", "")).otherwise(after)
    return _event(
        columns,
        severity=lambda: level,
        message=lambda: F.when(body != "", body).otherwise(line),
        trace_id=_null,
        service=lambda: F.when(service != "", service),
        fields=no_fields,
        ts_nanos=lambda: quick_timestamp(line),
    )


def parse_events(
    lines: DataFrame, fmt: str | Column = "format", line: str = "raw", compat: bool = False, columns: Iterable[str] = tuple(COLUMNS)
) -> DataFrame:
    """Lines (with their other columns) as events: ``columns`` of them, sev_num beside severity and ts beside ts_nanos.

    What a report does not use need not be built.  ``compat`` reads IETF syslog with the BSD rules.
    """
    kind = F.col(fmt) if isinstance(fmt, str) else fmt
    wanted = frozenset(columns)
    is_json, is_kv = kind.isin("json", "json_lines"), kind.isin("kv_pairs", "logfmt")
    own = [c for c in lines.columns if c not in {*COLUMNS, "sev_num", "ts"} - {line, fmt if isinstance(fmt, str) else line}]
    raw = F.col(line)
    # Members and pairs are read once for all columns made of them.
    read = F.struct(F.when(is_json, json_entries(raw)).cast(ENTRIES).alias("_entries"), F.when(is_kv, kv_pairs(raw)).cast(PAIRS).alias("_pairs"))
    parts = _computed(lines.select(*own), read)
    event = (
        F.when(is_json, _json_event(raw, F.coalesce("_entries", F.array().cast(ENTRIES)), wanted))
        .when(is_kv, _kv_event(raw, F.col("_pairs"), wanted))
        .when(kind == "syslog_bsd", _syslog_bsd(raw, wanted))
        .when(kind == "syslog_ietf", _syslog_bsd(raw, wanted) if compat else _syslog_ietf(raw, wanted))
        .otherwise(_fallback(raw, wanted))
    )
    out = _computed(parts, event).drop("_entries", "_pairs")
    more = {}
    if "severity" in wanted:
        more["sev_num"] = severity_number(F.col("severity"))
    if "ts_nanos" in wanted:
        more["ts"] = F.timestamp_micros(F.expr("ts_nanos div 1000"))
    return out.withColumns(more)
