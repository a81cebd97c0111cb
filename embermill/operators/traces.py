"""Request traces: aggregates, outcomes, sessions and ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

ID_BYTES, MAX_EVENTS = 36, 64


def traced(events: DataFrame) -> DataFrame:
    return events.where(F.col("trace_id").isNotNull()).withColumn("trace_id", F.substr("trace_id", F.lit(1), F.lit(ID_BYTES)))


def traces(events: DataFrame, extended: bool = False, max_events: int | None = MAX_EVENTS) -> DataFrame:
    """One row for each trace id: events, start, end, duration, outcome.

    Only a trace's first ``max_events`` count; None lifts that and needs no order
    at all. ``extended``: a trace without errors is a success.
    """
    rows = traced(events)
    if max_events is not None:
        place = F.row_number().over(W.partitionBy("trace_id").orderBy("seq"))
        rows = rows.withColumn("place", place).where(F.col("place") <= max_events)
    found = rows.groupBy("trace_id").agg(
        F.count("*").alias("event_count"),
        F.min_by("ts", "seq").alias("started"),
        F.max("ts").alias("ended"),
        F.max("sev_num").alias("max_sev"),
    )
    micros = F.when(F.col("event_count") < 2, F.lit(0)).otherwise(F.unix_micros("ended") - F.unix_micros("started"))
    outcome = F.when(F.col("max_sev") >= 4, "failure").otherwise("success" if extended else "unknown")
    return found.withColumns({"duration_us": micros.cast("bigint"), "outcome": outcome}).drop("max_sev")


def trace_events(events: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    place = F.row_number().over(W.partitionBy("trace_id").orderBy("seq")).cast("int")
    return traced(events).withColumn("place", place).where(F.col("place") <= max_events).select(
        "trace_id", "place", "seq", "severity", "message", "service"
    )


def trace_sessions(events: DataFrame, gap_s: int = 30) -> DataFrame:
    """A trace whose events pause for more than ``gap_s`` goes on as a new one; for batch and streams."""
    window = F.session_window("ts", f"{gap_s} seconds")
    return traced(events).groupBy("trace_id", window.alias("w")).agg(
        F.count("*").alias("event_count"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max("sev_num").alias("max_sev")
    ).drop("w")
