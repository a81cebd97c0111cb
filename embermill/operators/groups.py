"""Grouping of events by template: aggregates, windows, trend, score and top groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embermill.functions.severity import severity_name
from embermill.operators.templates import template, template_hash

# Weights of a group's severity and trend in its score.
SEVERITY_WEIGHT = {"trace": 0.1, "debug": 0.2, "info": 0.5, "warn": 2.0, "error": 5.0, "fatal": 10.0, "unknown": 0.3}
TREND_WEIGHT = {"rising": 2.0, "new": 1.5, "stable": 1.0, "falling": 0.7, "gone": 0.1}


def _weight(column: Column, table: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in table.items():
        out = F.when(column == name, F.lit(w)).otherwise(out)
    return out


def with_template(events: DataFrame, message: str = "message") -> DataFrame:
    return events.withColumn("template", template(F.col(message)))


def group_stats(events: DataFrame, *more: Column) -> DataFrame:
    """One row for each template: hash, count, exemplar, service, severity, sources, first and last time.

    Partial aggregation does the work before the shuffle; hashes are of groups, not
    of events. ``more``: further aggregates of the same pass.
    """
    named = events if "template" in events.columns else with_template(events)
    found = named.where(F.col("template") != "").groupBy("template").agg(
        F.count("*").alias("count"),
        F.min_by(F.substr("message", F.lit(1), F.lit(255)), "seq").alias("exemplar"),
        F.min_by("service", F.when(F.col("service").isNotNull(), F.col("seq"))).alias("service"),
        F.max("sev_num").alias("max_sev"),
        F.count_distinct("source_id").alias("source_count"),
        F.min_by("ts", "seq").alias("first_seen"),
        F.max_by("ts", "seq").alias("last_seen"),
        *more,
    )
    return found.withColumns({"template_hash": template_hash(F.col("template")), "severity": severity_name(F.col("max_sev"))})


def window_counts(now: Column, seconds: int) -> tuple[Column, Column]:
    """Aggregates: events in the window that ends with ``now``'s, and in the one before it (missing ones count 0)."""
    # floor of the epoch by the window: aligned to the epoch, dense by construction
    at = F.floor(F.unix_seconds("ts") / seconds)
    last = F.floor(F.unix_seconds(now) / seconds)
    return (
        F.sum((at == last).cast("bigint")).alias("count_short"),
        F.sum((at == last - 1).cast("bigint")).alias("count_prev_short"),
    )


def group_windows(events: DataFrame, now: Column, seconds: int) -> DataFrame:
    named = events if "template" in events.columns else with_template(events)
    return named.where(F.col("template") != "").groupBy("template").agg(*window_counts(now, seconds))


def trend(short: Column, previous: Column) -> Column:
    ratio = short / previous
    return (
        F.when((previous == 0) & (short == 0), "gone")
        .when(previous == 0, "new")
        .when(ratio > 1.5, "rising")
        .when(ratio < 0.67, "falling")
        .otherwise("stable")
    )


def score(age_s: Column, short: Column, severity: Column, trend_: Column, sources: Column, decay_s: float) -> Column:
    return (
        F.exp(-age_s / F.lit(float(decay_s)))
        * F.log2(short + F.lit(1.0))
        * _weight(severity, SEVERITY_WEIGHT)
        * _weight(trend_, TREND_WEIGHT)
        * F.log2(sources + F.lit(1.0))
    )


def latest(events: DataFrame) -> DataFrame:
    """One row: the last event's time, for a cross-check against a fixed now."""
    return events.agg(F.max("ts").alias("now"))


def scored_groups(events: DataFrame, seconds: int = 60, decay_s: float = 30.0, now=None) -> DataFrame:
    """Group statistics with windows, trend and score at ``now`` (a literal; by default the last event's time)."""
    at = F.lit(now if now is not None else latest(events).first()["now"])
    both = group_stats(events, *window_counts(at, seconds))
    both = both.withColumn("trend", trend(F.col("count_short"), F.col("count_prev_short")))
    age = F.unix_micros(at) / 1e6 - F.unix_micros("last_seen") / 1e6
    return both.withColumn(
        "score", score(age, F.col("count_short"), F.col("severity"), F.col("trend"), F.col("source_count"), decay_s)
    )


def top_groups(groups: DataFrame, k: int = 20) -> DataFrame:
    return groups.orderBy(F.round("score", 9).desc(), "template").limit(k)


def pipeline_stats(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """One row of counters; with ``alerts``, their number too. A batch drops nothing: unlike a bounded buffer, it reads all."""
    named = events if "template" in events.columns else with_template(events)
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    out = named.agg(
        F.count("*").alias("events_total"),
        F.count_distinct(F.when(F.col("template") != "", F.col("template"))).alias("groups"),
        F.count_distinct("trace_id").alias("traces"),
        F.lit(0).cast("bigint").alias("drops"),
        F.when(span > 0, F.count("*") / span).alias("events_per_sec"),
    )
    if alerts is None:
        return out
    one = alerts.agg(F.count("*").alias("alerts"))  # one row each
    return out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
