"""Rate anomalies, change points and alerts over a series of ticks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from embermill.operators.stats import ewma, ewma_alpha, normalized_z, running_zscore


@dataclass(frozen=True)
class Rate:
    tick_s: int = 1
    fast_s: float = 10.0
    slow_s: float = 300.0
    warmup: int = 30
    z: float = 3.0
    min_delta: float = 1.0


@dataclass(frozen=True)
class Cusum:
    tick_s: int = 1
    target_s: float = 300.0
    threshold: float = 5.0
    allowance: float = 0.5
    cooldown: int = 30
    warmup: int = 30


def rate_series(events: DataFrame, tick_s: int = 1) -> DataFrame:
    """(tick, sample): events in each tick that has any. Aggregated in the map side first."""
    tick = (F.floor(F.unix_seconds("ts") / tick_s) * tick_s).cast("bigint")
    return events.groupBy(tick.alias("tick")).agg(F.count("*").cast("double").alias("sample"))


FIRED = ("tick", "kind", "score", "observed", "expected", "deviation")


def rate_anomalies(series: DataFrame, cfg: Rate = Rate()) -> DataFrame:
    """Firings of spikes and drops: z against the past, and a fast average away from the slow one."""
    order = W.orderBy("tick")
    z = running_zscore(series, "tick", "sample").withColumn("seen", F.row_number().over(order))
    fast = ewma(series, "tick", "sample", ewma_alpha(cfg.fast_s, cfg.tick_s), cfg.tick_s).select("tick", F.col("ewma").alias("fast"))
    slow = ewma(series, "tick", "sample", ewma_alpha(cfg.slow_s, cfg.tick_s), cfg.tick_s).select("tick", F.col("ewma").alias("slow"))
    both = z.join(fast, "tick").join(slow, "tick")
    live = (F.col("seen") >= cfg.warmup) & F.col("z").isNotNull() & (F.abs(F.col("fast") - F.col("slow")) >= cfg.min_delta)
    kind = F.when(F.col("z") >= cfg.z, "rate_spike").when((F.col("z") <= -cfg.z) & (F.col("slow") > cfg.min_delta), "rate_drop")
    return both.where(live).withColumn("kind", kind).where("kind IS NOT NULL").select(
        "tick", "kind", normalized_z(F.col("z")).alias("score"), F.col("sample").alias("observed"), F.col("slow").alias("expected"), F.col("z").alias("deviation")
    )


def cusum_anomalies(series: DataFrame, cfg: Cusum = Cusum()) -> DataFrame:
    """Firings of sustained shifts: cumulative sums of the deviation from a slow average, reset on firing."""
    target = ewma(series, "tick", "sample", ewma_alpha(cfg.target_s, cfg.tick_s), cfg.tick_s)
    whole = W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    rows = target.withColumns({"sd": F.stddev_samp("sample").over(whole), "seen": F.count("*").over(whole)})
    samples = F.array_sort(F.collect_list(F.struct("tick", "sample", F.col("ewma").alias("mean"), "sd", "seen")))
    out = "array<struct<tick:bigint,kind:string,score:double,observed:double,expected:double,deviation:double>>"
    start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"), F.lit(0).alias("rest"), F.array().cast(out).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        warm = s["seen"] >= cfg.warmup
        resting = warm & (acc["rest"] > 0)
        live = warm & ~resting & (s["sd"] > 0)
        n = (s["sample"] - s["mean"]) / s["sd"]
        hi = F.when(live, F.greatest(F.lit(0.0), acc["hi"] + n - cfg.allowance)).otherwise(acc["hi"])
        lo = F.when(live, F.greatest(F.lit(0.0), acc["lo"] - n - cfg.allowance)).otherwise(acc["lo"])
        up = live & (hi > cfg.threshold)
        down = live & ~up & (lo > cfg.threshold)

        def fired(kind: str, level: Column, deviation: Column) -> Column:
            return F.array(
                F.struct(
                    s["tick"].alias("tick"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), level / (2 * cfg.threshold)).alias("score"),
                    s["sample"].alias("observed"), s["mean"].alias("expected"), deviation.alias("deviation"),
                )
            )

        made = F.when(up, fired("change_point_up", hi, n)).when(down, fired("change_point_down", lo, -n)).otherwise(F.array().cast(out))
        return F.struct(
            F.when(up, F.lit(0.0)).otherwise(hi).alias("hi"),
            F.when(down, F.lit(0.0)).otherwise(lo).alias("lo"),
            F.when(up | down, F.lit(cfg.cooldown)).when(resting, acc["rest"] - 1).otherwise(acc["rest"]).alias("rest"),
            F.concat(acc["out"], made).alias("out"),
        )

    folded = rows.agg(samples.alias("samples")).select(F.explode(F.aggregate("samples", start, step, lambda a: a["out"])).alias("f"))
    return folded.select("f.*")


def alerts(firings: DataFrame, now: Column | None = None, idle_s: int = 30) -> DataFrame:
    """Firings of a kind that follow within ``idle_s`` are one alert: islands by the gap before them."""
    order = W.partitionBy("kind").orderBy("tick")
    gap = F.col("tick") - F.lag("tick").over(order)
    marked = firings.withColumn("new", F.coalesce((gap > idle_s).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(order))
    found = marked.groupBy("kind", "island").agg(
        F.min("tick").alias("first_fired"),
        F.max("tick").alias("last_fired"),
        F.count("*").alias("fire_count"),
        F.max("score").alias("score"),
        F.max_by("observed", "tick").alias("observed"),
        F.min_by("expected", "tick").alias("expected"),
        F.min_by("deviation", "tick").alias("deviation"),
    )
    number = F.row_number().over(W.orderBy("first_fired", "kind")).cast("bigint")  # one row an alert
    out = found.withColumn("alert_id", number).drop("island")
    if now is not None:
        idle = now - F.col("last_fired")
        out = out.withColumn("state", F.when(idle > idle_s, "resolved").otherwise("active"))
    return out
