"""Text sources: batch and streaming scans, line splitting, merging, the ring view and source names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from embermill.sources.work import work_dir


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_name, raw) of text files, each line without its end."""
    rows = spark.read.text(paths)
    return rows.select(F.col("_metadata.file_path").alias("source_name"), _chomp(F.col("value")).alias("raw"))


def stream_lines(spark: SparkSession, path: str, latest_first: bool = False) -> DataFrame:
    """The same of a growing directory, as a stream."""
    rows = spark.readStream.option("latestFirst", latest_first).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source_name"), _chomp(F.col("value")).alias("raw"))


def read_pipe(spark: SparkSession, pipe: Iterable[bytes], name: str = "stdin", batch_bytes: int = 32 << 20) -> DataFrame:
    """(source_name, line, raw) of a byte stream that can be read once, on the driver alone.

    Lines go to the shared work folder in batches of ``batch_bytes``, so the driver
    holds one batch however much comes. Lines have any length, and a last one
    without an end counts.
    """
    path, schema = f"{work_dir(spark)}/embermill/pipe-{uuid.uuid4().hex}", "line bigint, raw string"
    n = size = 0
    held: list[tuple[int, str]] = []

    def put() -> None:
        spark.createDataFrame(held, schema).write.mode("append").parquet(path)

    for line in pipe:
        held.append((n, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
        n, size = n + 1, size + len(line)
        if size >= batch_bytes:
            put()
            held, size = [], 0
    if held or not n:
        put()
    return spark.read.schema(schema).parquet(path).withColumn("source_name", F.lit(name))


def _chomp(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "")


def split_lines(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line_no, raw): the lines of a text column; an unterminated last line counts, an empty rest does not."""
    body = F.regexp_replace(F.col(text), "\n$", "")
    lines = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    return rows.select(*keys, F.posexplode(lines).alias("line_no", "raw")).withColumn("raw", _chomp(F.col("raw")))


def spread(rows: DataFrame, task_bytes: int = 16 << 20) -> DataFrame:
    """A small input dealt to all tasks; a larger one as it is.

    A file of one row group is one task however many cores there are. Where the
    plan's size is below ``task_bytes`` for each of the session's tasks, dealing its
    rows costs a shuffle of at most that much; beyond it, splits fill the cores.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(tasks) if tasks > 1 and size < task_bytes * tasks else rows


def glob_regex(pattern: str) -> str:
    """A glob over a base name (* and ? alone are special) as an anchored regex."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def merge_sources(*sources: DataFrame, order: tuple[str, ...] = ("ts", "source_id")) -> DataFrame:
    """The union of sources with ``seq``, a number that rises in the given order."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return with_seq(both, *order)


def with_seq(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with seq, 1 to their number without gaps, in the given order.

    The rows are put into ranges and written once, to the shared work folder:
    numbers and counts come from the same table, so they fit whatever else is
    asked of the rows. Only one count for each range is summed in one place.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    part = part.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
    path = f"{work_dir(spark)}/embermill/numbered-{uuid.uuid4().hex}"
    part.write.parquet(path)
    kept = spark.read.schema(part.schema).parquet(path)
    counts = kept.groupBy("_p").agg(F.count("*").alias("n"))
    # One row for each range, at most as many as there are shuffle partitions.
    base = counts.select(
        F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    return kept.join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn("seq", F.col("_i") + F.col("base") + 1).drop("_p", "_q", "_i", "base")


def ring(events: DataFrame, capacity: int = 65_536, seq: str = "seq") -> DataFrame:
    """The newest ``capacity`` events, as a bounded history holds them."""
    return events.orderBy(F.desc(seq)).limit(capacity)


def name_sources(events: DataFrame, registry: DataFrame, broadcast_rows: int = 4096) -> DataFrame:
    """``events`` with source_name from (source_id, name); unknown ids are named so.

    A registry of up to ``broadcast_rows`` sources is broadcast, a larger one joined.
    """
    known = registry.select(F.col("source_id").alias("_id"), F.col("name").alias("_name"))
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    return events.join(known, F.col("source_id") == F.col("_id"), "left").withColumn(
        "source_name", F.coalesce("_name", F.lit("<unknown>"))
    ).drop("_id", "_name")
