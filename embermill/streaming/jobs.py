"""The triage operators on streams: the same expressions, with watermarks and keyed state.

Late rows beyond the watermark are left out of windowed results; state lives as
long as the watermark or, in keyed folds, until a key was idle for ``idle_ms``, in
place of fixed table sizes. A run over what is there now (``availableNow``) wants
``idle_ms=None``: waiting for time to pass never ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embermill.functions.lines import is_continuation
from embermill.operators.formats import classify
from embermill.operators.groups import with_template
from embermill.operators.parsers import parse_events
from embermill.operators.templates import MAX_TOKENS, WILDCARD, mask, tokenize


def parsed_stream(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """Raw lines (raw, and any source columns) as events; each line's own format unless one is given.

    Stateless: continuation lines are dropped, the rest parsed where they are read.
    """
    kept = lines.where(~is_continuation(F.col("raw")))
    kind = F.lit(fmt) if fmt else classify(F.col("raw"))
    return with_template(parse_events(kept, kind))


def group_windows(events: DataFrame, window: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """Per tumbling window and template: count, largest severity, an exemplar and the last time."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "template")
        .agg(F.count("*").alias("count"), F.max("sev_num").alias("max_sev"), F.min("message").alias("exemplar"), F.max("ts").alias("last_seen"))
    )


def sliding_rate(events: DataFrame, window: str = "60 seconds", slide: str = "1 second", delay: str = "60 seconds") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n"))


def trace_sessions(events: DataFrame, gap: str = "30 seconds", delay: str = "60 seconds") -> DataFrame:
    return (
        events.where(F.col("trace_id").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), F.substr("trace_id", F.lit(1), F.lit(36)).alias("trace_id"))
        .agg(F.count("*").alias("event_count"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max("sev_num").alias("max_sev"))
    )


def drain(events: DataFrame, threshold: float = 0.5, idle_ms: int | None = 3_600_000) -> DataFrame:
    """(seq, template) as emitted, by clusters kept in state for each token count."""
    rows = events.select(F.col("seq").cast("bigint").alias("seq"), mask(tokenize(F.col("message"))).alias("tokens"))
    rows = rows.withColumn("n", F.least(F.size("tokens"), F.lit(MAX_TOKENS)))

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        clusters: list[list[str]] = json.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, tokens in zip(pdf["seq"].tolist(), (list(t) for t in pdf["tokens"])):
            best, best_same = -1, -1
            for i, own in enumerate(clusters):
                same = sum(x == y or WILDCARD in (x, y) for x, y in zip(own, tokens))
                if same > best_same and same >= threshold * len(tokens):
                    best, best_same = i, same
            if not tokens:
                out.append((seq, ""))
                continue
            if best < 0:
                clusters.append(tokens)
                best = len(clusters) - 1
            else:
                clusters[best] = [x if x == y else WILDCARD for x, y in zip(clusters[best], tokens)]
            out.append((seq, " ".join(clusters[best])))
        state.update((json.dumps(clusters),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["seq", "template"])

    return rows.groupBy("n").applyInPandasWithState(
        step, "seq bigint, template string", "clusters string", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    )


def detect(ticks: DataFrame, z: float = 3.0, warmup: int = 30, idle_ms: int | None = 86_400_000) -> DataFrame:
    """Spikes and drops over (series, tick, sample) as ticks come in: count, mean and squared deviations are the state."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import math

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values("tick", kind="stable")
        out = []
        for tick, x in zip(pdf["tick"].tolist(), pdf["sample"].tolist()):
            sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            score = (x - mean) / sd if sd > 0 else None
            n += 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
            if score is not None and n >= warmup and abs(score) >= z:
                out.append((key[0], tick, "rate_spike" if score > 0 else "rate_drop", float(score)))
        state.update((n, mean, m2))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["series", "tick", "kind", "deviation"])

    return ticks.groupBy("series").applyInPandasWithState(
        step, "series string, tick bigint, kind string, deviation double", "n long, mean double, m2 double", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    )
