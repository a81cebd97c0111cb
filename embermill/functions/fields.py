"""Typed field values: array<struct<key, value>> with first match on lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind:string,s:string,i:bigint,f:double,b:boolean>"
FIELDS = f"array<struct<key:string,value:{VALUE}>>"

# Keys that name an event's own columns.
ALIASES = {
    "timestamp": ("timestamp", "ts", "time", "@timestamp", "datetime", "t"),
    "severity": ("level", "severity", "lvl", "loglevel", "log_level"),
    "message": ("message", "msg", "log", "text", "body"),
    "trace_id": ("trace_id", "traceId", "trace", "x-trace-id", "request_id"),
    "service": ("service", "service_name", "app", "application", "component"),
}
KNOWN = tuple(k for keys in ALIASES.values() for k in keys)

_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def value_of(kind: Column, text: Column) -> Column:
    """A typed value from its kind and its text."""
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", text).alias("s"),
        F.when(kind == "int", text.try_cast("bigint")).alias("i"),
        F.when(kind == "float", text.try_cast("double")).alias("f"),
        F.when(kind == "bool", text == "true").alias("b"),
    )


def inferred_kind(text: Column) -> Column:
    """Plain decimal syntax is a number, true and false are booleans, the rest is text."""
    return (
        F.when(text.rlike(_INT) & text.try_cast("bigint").isNotNull(), F.lit("int"))
        .when(text.rlike(_FLOAT), F.lit("float"))
        .when(text.isin("true", "false"), F.lit("bool"))
        .otherwise(F.lit("string"))
    )


def no_fields() -> Column:
    return F.array().cast(FIELDS)


def field_get(fields: Column, key: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["key"] == key), 0)["value"]


def field_string(fields: Column, key: str) -> Column:
    return field_get(fields, key)["s"]


def field_float(fields: Column, key: str) -> Column:
    value = field_get(fields, key)
    return F.coalesce(value["f"], value["i"].cast("double"))
