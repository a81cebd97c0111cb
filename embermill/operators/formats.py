"""Format detection by line, the running vote that locks a source's format, and schema inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Formats in their order, and how structured each is (ties in a vote).
FORMATS = ("json", "json_lines", "syslog_bsd", "syslog_ietf", "clf", "kv_pairs", "logfmt", "unstructured")
STRUCTURE = {"json": 6, "json_lines": 6, "logfmt": 5, "kv_pairs": 4, "syslog_bsd": 3, "syslog_ietf": 3, "clf": 3, "unstructured": 0}


def classify(line: Column) -> Column:
    text = F.trim(line)
    head = F.substr(text, F.lit(1), F.lit(80))
    clf = (
        (F.length(text) >= 20)
        & F.contains(head, F.lit(" - "))
        & F.contains(head, F.lit("["))
        & F.contains(head, F.lit('"'))
    )
    pairs = F.regexp_count(text, F.lit(r"(?<![ =])=(?!=)"))
    level = F.contains(text, F.lit("level=")) | F.contains(text, F.lit("lvl="))
    message = F.contains(text, F.lit("msg=")) | F.contains(text, F.lit("message="))
    return (
        F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), "json")
        .when(text.rlike(r"^<[0-9]{1,4}>[1-9]"), "syslog_ietf")
        .when(text.rlike(r"^<[0-9]{1,4}>"), "syslog_bsd")
        .when(clf, "clf")
        .when((pairs >= 3) & level & message, "logfmt")
        .when(pairs >= 3, "kv_pairs")
        .when(level & message, "logfmt")
        .otherwise("unstructured")
    )


def lock_formats(lines: DataFrame, source: str = "source_id", seq: str = "seq", line: str = "raw", samples: int = 8) -> DataFrame:
    """``lines`` with the format in force at each: the running vote of its source's first ``samples`` lines.

    Only a source's first samples are counted: they are few rows, found by a
    top-k per source, and joined back, so no source's lines meet in one task.
    """
    marked = lines.withColumn("seen", classify(F.col(line)))
    full = marked.where(F.trim(line) != "")
    order = W.partitionBy(source).orderBy(seq)
    first = full.select(source, seq, "seen").withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)
    running = order.rowsBetween(W.unboundedPreceding, 0)
    votes = F.array(
        *[
            F.struct(
                F.sum((F.col("seen") == f).cast("int")).over(running).alias("votes"),
                F.lit(STRUCTURE[f]).alias("structure"),
                F.lit(-i).alias("place"),
                F.lit(f).alias("name"),
            )
            for i, f in enumerate(FORMATS)
        ]
    )
    states = first.withColumn("format", F.array_max(votes)["name"])
    after = W.partitionBy(source).orderBy("k")
    states = states.select(source, F.col(seq).alias("from_seq"), F.lead(seq).over(after).alias("to_seq"), "format")
    # At most ``samples`` rows a source.
    found = marked.join(
        F.broadcast(states.withColumnRenamed(source, "at_source")),
        (F.col(source) == F.col("at_source")) & (F.col(seq) >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col(seq) < F.col("to_seq"))),
        "left",
    )
    return found.withColumn("format", F.coalesce("format", F.lit("unstructured"))).drop("seen", "at_source", "from_seq", "to_seq")


def infer_schema(events: DataFrame, source: str = "source_id", seq: str = "seq", samples: int = 64) -> DataFrame:
    """Per source and key, over its first ``samples`` events with fields: occurrences, counts by type, main type, frequency."""
    order = W.partitionBy(source).orderBy(seq)
    first = (
        events.where(F.size("fields") > 0)
        .select(source, seq, "fields")
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= samples)
    )
    total = first.groupBy(source).agg(F.count("*").alias("events"))
    kinds = ("string", "int", "float", "bool")
    each = first.select(source, F.explode("fields").alias("f")).groupBy(source, F.col("f.key").alias("key"))
    counts = each.agg(
        F.count("*").alias("occurrences"), *[F.sum((F.col("f.value.kind") == k).cast("int")).alias(f"n_{k}") for k in kinds]
    )
    main = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]))
    return (
        counts.join(total, source)
        .withColumn("main_type", main["kind"])
        .withColumn("frequency", F.col("occurrences") / F.col("events"))
        .withColumn("is_numeric", F.col("main_type").isin("int", "float"))
    )


def stable_fields(schema: DataFrame, above: float = 0.8) -> DataFrame:
    return schema.where(F.col("frequency") > above)
