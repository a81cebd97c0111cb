"""Connected components of an edge table, by alternating large-star and small-star steps.

No task and not the driver ever holds a component: a step is a grouped minimum
(combined before its shuffle) and an equi-join, whose hot keys adaptive
execution can split.  Each round's edges are a table in the shared folder, so
lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, ship, written_at


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of these edges that are not their own root."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    u, v = at[: len(a)], at[len(a) :]
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:  # pointer jumping
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        if (before == label).all() and not len(u):
            break
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: each run of edges becomes its spanning stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.components import forest

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size > 1_000_000:
                held = [forest(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
        if held:
            u, v = forest(*map(np.concatenate, zip(*held)))
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_pydict({"a": u[i : i + 100_000], "b": v[i : i + 100_000]})

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) with two ends touches; component is the smallest node."""
    spark = edges.sparkSession
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = written_at(contract(clean).distinct(), "components")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == seen:
            break
        seen = (state["n"], state["x"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("at"), F.least("a", "low").alias("low")
        )
        large = both.join(low, both["a"] == low["at"]).where("b > a").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        ).where("a <> b").distinct()
        large, middle = written_at(large, "components")
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), "low")
        small = (
            large.join(low, large["a"] == low["at"])
            .where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select(F.col("at").alias("a"), F.col("low").alias("b")))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        after, new = written_at(small, "components")
        drop_path(spark, path)
        drop_path(spark, middle)
        now, path = after, new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
