"""The triage engine: lines are parsed once and kept, and every report branches off that table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embermill.functions.lines import is_continuation
from embermill.operators import anomaly, correlate, filters, groups, traces
from embermill.operators.formats import lock_formats
from embermill.operators.parsers import parse_events


@dataclass(frozen=True)
class Intervals:
    """Reference times in seconds; sparse data wants longer ones."""

    tick: int = 1
    window: int = 60
    trace_gap: int = 30
    alert_idle: int = 30
    correlation: int = 300
    decay: float = 30.0


class Triage:
    """Batch triage of (source_id, seq, raw) lines.

    Filters belong to ``events`` alone: they never reach below the aggregates.
    """

    def __init__(self, lines: DataFrame, intervals: Intervals = Intervals(), parsed: DataFrame | None = None):
        self.every = intervals
        if parsed is None:
            kept = lines.where(~is_continuation(F.col("raw")))
            parsed = parse_events(lock_formats(kept)).drop("format", "raw")
        # Kept in memory and on disk, and made again from lines if an executor is lost.
        self.parsed = groups.with_template(parsed).persist()
        self._now = None
        self._kept: dict[str, DataFrame] = {"parsed": self.parsed}

    def release(self) -> None:
        """Give up what is kept."""
        for df in self._kept.values():
            df.unpersist()

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make().persist()
        return self._kept[name]

    def events(self, predicate: filters.Predicate = filters.Predicate(), min_severity: str | None = None, last_s: int | None = None) -> DataFrame:
        since = None
        if last_s is not None:
            since = filters.last(F.lit(self.now()), last_s)
        return filters.display(self.parsed, predicate, min_severity, since)

    def groups(self) -> DataFrame:
        return self._keep("groups", lambda: groups.scored_groups(self.parsed, self.every.window, self.every.decay, self.now()))

    def top_groups(self, k: int = 20) -> DataFrame:
        return groups.top_groups(self.groups(), k)

    def rates(self) -> DataFrame:
        return self._keep("rates", lambda: anomaly.rate_series(self.parsed, self.every.tick))

    def firings(self) -> DataFrame:
        return self._keep("firings", self._firings)

    def _firings(self) -> DataFrame:
        t = self.every.tick
        series = self.rates()
        rate = anomaly.rate_anomalies(series, anomaly.Rate(tick_s=t, fast_s=10.0 * t, slow_s=300.0 * t))
        shift = anomaly.cusum_anomalies(series, anomaly.Cusum(tick_s=t, target_s=300.0 * t))
        return rate.unionByName(shift)

    def alerts(self) -> DataFrame:
        """Alerts with their state at the last event's time: active, or resolved when idle for long."""
        return self._keep("alerts", lambda: anomaly.alerts(self.firings(), F.unix_seconds(F.lit(self.now())), self.every.alert_idle))

    def now(self):
        """The last event's time, found once."""
        if self._now is None:
            self._now = groups.latest(self.parsed).first()["now"]
        return self._now

    def signals(self) -> DataFrame:
        """Firings, and the rising ones of the top groups at the last event's time."""
        rising = self.groups().withColumn("tick", F.unix_seconds(F.lit(self.now())))
        return correlate.alert_signals(self.firings()).unionByName(correlate.group_signals(rising))

    def hypotheses(self) -> DataFrame:
        effects = self.alerts().select(
            F.col("alert_id").alias("effect_id"), F.col("first_fired").alias("e_onset"), F.col("kind").alias("e_detector")
        )
        return correlate.hypotheses(correlate.correlate(effects, self.signals(), self.every.correlation))

    def traces(self, extended: bool = False) -> DataFrame:
        return traces.traces(self.parsed, extended)

    def summary(self, k: int = 20) -> DataFrame:
        from embermill.plans.render import triage_summary

        return triage_summary(self.parsed, self.groups(), self.alerts(), self.hypotheses(), self.traces(), k)
