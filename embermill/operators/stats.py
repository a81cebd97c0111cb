"""Statistics: running moments, exponential averages, sketches and time windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def ewma_alpha(halflife_s: float, interval_s: float) -> float:
    return 1 - math.exp(-interval_s / halflife_s)


def ewma(series: DataFrame, t: str, x: str, alpha: float, interval_s: float, keys: list[str] = ()) -> DataFrame:
    """``series`` with its exponential average after each sample; a gap weighs as its length in intervals.

    A recurrence has no window form: each key's ticks are folded in one array,
    which is as long as the number of ticks, never of events.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"), F.col(t).alias("at"))))
    start = F.struct(
        F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("v"), F.array().cast("array<struct<at:bigint,x:double,v:double>>").alias("out")
    )

    def step(acc: Column, s: Column) -> Column:
        gap = s["t"] - acc["t"]
        weight = F.when(gap > 0, 1 - F.pow(F.lit(1 - alpha), gap / interval_s)).otherwise(F.lit(alpha))
        v = F.when(acc["v"].isNull(), s["x"]).otherwise(weight * s["x"] + (1 - weight) * acc["v"])
        row = F.struct(s["at"].cast("bigint").alias("at"), s["x"].alias("x"), v.alias("v"))
        return F.struct(s["t"].alias("t"), v.alias("v"), F.concat(acc["out"], F.array(row)).alias("out"))

    grouped = series.groupBy(*keys).agg(order.alias("samples"))
    folded = grouped.select(*keys, F.explode(F.aggregate("samples", start, step, lambda a: a["out"])).alias("r"))
    return folded.select(*keys, F.col("r.at").alias(t), F.col("r.x").alias(x), F.col("r.v").alias("ewma"))


def streaming_stats(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("variance"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def zscore(value: Column, mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 2) & (sd > 0), (value - mean) / sd)


def running_zscore(series: DataFrame, t: str, x: str, keys: list[str] = ()) -> DataFrame:
    """z-score of each sample against those before it.

    Sums over the ticks before a sample, so the window holds ticks, not events.
    """
    before = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, -1)
    return series.withColumn(
        "z", zscore(F.col(x), F.avg(x).over(before), F.stddev_samp(x).over(before), F.count(x).over(before))
    )


def normalized_z(z: Column) -> Column:
    return 1 - 1 / (1 + F.lit(0.1) * z * z)


# ------------------------------------------------------------------ sketches


def hll_registers(rows: DataFrame, value: str, keys: list[str], p: int = 14) -> DataFrame:
    """HyperLogLog registers as rows (keys, register, rank): a maximum by group, so sketches merge by a maximum."""
    h = F.conv(F.substr(F.md5(F.col(value).cast("string")), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
    rest = F.shiftright(h, p)
    width = 60 - p
    rank = F.when(rest == 0, F.lit(width + 1)).otherwise(width - F.floor(F.log2(rest)).cast("int"))
    return rows.where(F.col(value).isNotNull()).groupBy(
        *keys, F.pmod(h, F.lit(1 << p)).cast("int").alias("register")
    ).agg(F.max(rank).cast("int").alias("rank"))


def hll_merge(registers: DataFrame, keys: list[str]) -> DataFrame:
    return registers.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, keys: list[str], p: int = 14) -> DataFrame:
    m = float(1 << p)
    alpha = 0.7213 / (1 + 1.079 / m)
    found = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    zeros = F.lit(m) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("s") + zeros)
    linear = F.lit(m) * F.log(F.lit(m) / zeros)
    return found.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias("estimate"))


def cms_cells(rows: DataFrame, value: str, depth: int = 4, width: int = 8192) -> DataFrame:
    """Count-min cells (row, cell, count)."""
    counted = rows.groupBy(F.col(value).alias("item")).agg(F.count("*").alias("n"))
    return _placed(counted, depth, width).groupBy("row", "cell").agg(F.sum("n").alias("count"))


def _placed(items: DataFrame, depth: int, width: int) -> DataFrame:
    at = items.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    digest = F.md5(F.concat_ws(":", F.col("row").cast("string"), F.col("item").cast("string")))
    return at.withColumn("cell", F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(width)))


def cms_estimate(cells: DataFrame, items: DataFrame, depth: int = 4, width: int = 8192) -> DataFrame:
    """(item, estimate): the smallest of an item's cells; 0 where a cell is empty."""
    found = _placed(items.select("item").distinct(), depth, width).join(cells, ["row", "cell"], "left")
    return found.groupBy("item").agg(F.min(F.coalesce("count", F.lit(0))).cast("bigint").alias("estimate"))


def cms_decay(cells: DataFrame, factor: float) -> DataFrame:
    return cells.withColumn("count", F.floor(F.col("count") * F.lit(factor)).cast("bigint"))


def quantiles_exact(rows: DataFrame, value: str, keys: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in at])


def quantiles_approx(
    rows: DataFrame, value: str, keys: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000
) -> DataFrame:
    """Mergeable quantile summaries: constant space for each group."""
    return rows.groupBy(*keys).agg(
        *[F.percentile_approx(value, F.lit(q), F.lit(accuracy)).alias(f"p{round(q * 100)}") for q in at]
    )


# ------------------------------------------------------------------ time windows


def tumbling(rows: DataFrame, ts: str, value: str, seconds: int) -> DataFrame:
    """Count, sum, min, max and mean by window, aligned to the epoch."""
    start = (F.floor(F.unix_seconds(F.col(ts)) / seconds) * seconds).cast("bigint").alias("start_s")
    return rows.groupBy(start).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")
    )


def window_rate(rows: DataFrame, ts: str, bucket_s: int, buckets: int) -> DataFrame:
    """Per bucket that holds rows: rows of the last ``buckets`` buckets, and their rate over that whole time."""
    start = (F.floor(F.unix_seconds(F.col(ts)) / bucket_s) * bucket_s).cast("bigint")
    counted = rows.groupBy(start.alias("start_s")).agg(F.count("*").alias("n"))
    # The window runs over buckets, whose number is that of time, not of rows.
    reach = W.orderBy("start_s").rangeBetween(-(buckets - 1) * bucket_s, 0)
    total = F.sum("n").over(reach)
    return counted.select("start_s", total.alias("in_window"), (total / (bucket_s * buckets)).alias("rate"))


# ------------------------------------------------------------------ MinHash


def minhash_signature(tokens: Column, slots: int = 64) -> Column:
    """The least hash of the tokens under each of ``slots`` seeds; empty for no tokens."""
    own = F.array_distinct(tokens)
    least = lambda i: F.array_min(F.transform(own, lambda t: F.xxhash64(i, t)))
    made = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), least)
    return F.when(F.size(own) > 0, made).otherwise(F.array().cast("array<bigint>"))


def minhash_similarity(a: Column, b: Column, slots: int = 64) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.lit(float(slots))


def minhash_signed(rows: DataFrame, key: str, tokens: str, slots: int = 64) -> DataFrame:
    """(k, sig) of each row with tokens: ``minhash_signature`` as grouped minima, which are compiled; rows may repeat a key."""
    each = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(tokens).alias("t"))
    words = each.select("row", "k", F.explode("t").alias("t"))
    least = words.groupBy("row").agg(F.first("k").alias("k"), *[F.min(F.xxhash64(F.lit(i), "t")).alias(f"s{i}") for i in range(slots)])
    return least.select("k", F.array(*[f"s{i}" for i in range(slots)]).alias("sig"))


def minhash_pairs(rows: DataFrame, key: str, tokens: str, threshold: float = 0.9, slots: int = 64, bands: int = 16) -> DataFrame:
    """(left, right, similarity, copy): links of equal signatures, and of those that share a band and reach the threshold.

    Equal signatures are one class, named by its least key. A copy's row has the
    class as left and the member as right, so a class gives as many rows as it
    has further members; the other rows link two classes, and all members of
    both with them.

    Signatures of the threshold differ in so many slots at most; one more band
    than that, where ``bands`` allows, leaves one equal, so wider bands lose no
    pair. Bands meet by key alone; signatures join their candidates once.
    """
    signed = minhash_signed(rows, key, tokens, slots).persist()
    classes = signed.groupBy("sig").agg(F.min("k").alias("k"))
    named = signed.join(classes.withColumnRenamed("k", "left"), "sig").where("NOT k <=> left")
    copies = named.select("left", F.col("k").alias("right"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    apart = slots - math.ceil(threshold * slots - 1e-9)
    n = min(bands, max(1, apart + 1))
    cuts = [i * slots // n for i in range(n + 1)]
    parts = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    banded = classes.select("k", F.explode(parts).alias("band"))
    left, right = banded.select(F.col("k").alias("left"), "band"), banded.select(F.col("k").alias("right"), "band")
    met = left.join(right, "band").where("left < right").select("left", "right").distinct()
    pairs = (
        met.join(classes.select(F.col("k").alias("left"), F.col("sig").alias("lsig")), "left")
        .join(classes.select(F.col("k").alias("right"), F.col("sig").alias("rsig")), "right")
        .select("left", "right", minhash_similarity(F.col("lsig"), F.col("rsig"), slots).alias("similarity"))
    )
    return copies.distinct().unionByName(pairs.where(F.col("similarity") >= threshold).distinct().withColumn("copy", F.lit(False)))
