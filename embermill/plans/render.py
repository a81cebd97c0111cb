"""Event rows and the triage summary as JSON, and terminal text for collected top results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embermill.functions.severity import LABELS
from embermill.operators.groups import pipeline_stats, top_groups


def event_json(events: DataFrame) -> DataFrame:
    """One JSON object for each event; null and empty parts are left out."""
    value = lambda v: F.coalesce(v["s"], v["i"].cast("string"), v["f"].cast("string"), v["b"].cast("string"))
    fields = F.when(
        F.size("fields") > 0,
        F.map_from_entries(
            F.transform(
                F.filter("fields", lambda f: F.lit(True)), lambda f: F.struct(f["key"], value(f["value"]))
            )
        ),
    )
    parts: list[Column] = [F.lit("event").alias("type"), F.col("severity"), F.col("message"), F.col("service"), F.col("trace_id")]
    if "template_hash" in events.columns:
        parts.append(F.when(F.col("template_hash") != 0, F.col("template_hash").cast("string")).alias("template_hash"))
    return events.select("seq", F.to_json(F.struct(*parts, fields.alias("fields"))).alias("json"))


def triage_summary(events: DataFrame, groups: DataFrame, alerts: DataFrame, hypotheses: DataFrame, traces: DataFrame, k: int = 20) -> DataFrame:
    """One row: counters, top groups, alerts, hypotheses and failed traces, as nested arrays of bounded length."""

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    top = top_groups(groups, k).select((-F.round("score", 3)).alias("order"), "exemplar", "count", "severity", "trend", "service", F.round("score", 3).alias("score"))
    parts = [
        pipeline_stats(events).select(F.struct("*").alias("stats")),
        listed(top, "top_groups", "order", "exemplar", "count", "severity", "trend", "service", "score"),
        listed(alerts.orderBy("alert_id").limit(128), "anomalies", "alert_id", "kind", "first_fired", "last_fired", "fire_count", F.round("score", 3).alias("score")),
        listed(hypotheses.orderBy("effect_id").limit(8), "hypotheses", "effect_id", "n_causes", F.round("confidence", 3).alias("confidence")),
        listed(traces.where("outcome = 'failure'").orderBy(F.desc("event_count"), "trace_id").limit(k), "failed_traces", "trace_id", "event_count", "duration_us"),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:  # each side is one row
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


_COLORS = {"trace": 90, "debug": 90, "info": 36, "warn": 33, "error": 31, "fatal": 35}


def event_line(severity: str, message: str, service: str | None = None, color: bool = False) -> str:
    label = LABELS.get(severity, "???").ljust(5)
    if color and severity in _COLORS:
        label = f"\x1b[{_COLORS[severity]}m{label}\x1b[0m"
    return f"{label} {'[' + service + '] ' if service else ''}{message}"


def group_block(rows: list, width: int = 80) -> str:
    """Collected top groups as a block: count, trend, severity and exemplar."""
    marks = {"rising": "^", "falling": "v", "new": "*", "gone": "-", "stable": "="}
    lines = [f"{r['count']:>8} {marks.get(r['trend'], ' ')} {LABELS.get(r['severity'], '???'):<5} {r['exemplar'][:width]}" for r in rows]
    return "\n".join(["   count   sev   exemplar", *lines])


def alert_banner(row) -> str:
    return f"!! {row['kind']} x{row['fire_count']} score {row['score']:.2f} observed {row['observed']:.1f} expected {row['expected']:.1f}"


def trace_tree(trace_id: str, rows: list) -> str:
    out = [f"trace {trace_id} ({len(rows)} events)"]
    for i, r in enumerate(rows):
        out.append(("  `- " if i == len(rows) - 1 else "  |- ") + event_line(r["severity"], r["message"], r["service"]))
    return "\n".join(out)
