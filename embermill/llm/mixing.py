"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about ``block_words``
words.  A source's target in words is whole passes over its blocks and a part of
one more pass in permuted order, whose last block is cut at the exact word.  The
resulting block quotas are split recursively among output shards: a node draws
how many blocks of each source its left half gets from the multivariate
hypergeometric distribution, seeded by the node's place, so quotas stay exact at
every level and reruns agree.  Each shard then draws its quota of every source from
that source's permuted blocks, disjoint from the other shards'; what a document
gives is what the shards drew of its block.  Mixed rows go to their shard and are
put in random order there.

Only the block table reaches the driver: at most ``max_blocks`` rows in all
(plus one for each source, which has a target of its own).  A hot source is many
blocks, so no task holds it.  A shard is about ``shard_words`` words; beyond
``max_blocks`` blocks grow, and shards with them, as a shard draws whole blocks.
The plan is broadcast while it is of at most ``broadcast_rows`` rows.

Nulls: a null text has size 0 and a null source is a source of its own, last in
order; null doc_ids are mixed like others.  Repeated rows count each.  Sources
without words have target 0.  An empty table gives no rows.  Extra columns are
kept, but for those with names of this operator's outputs, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .native import PLAIN_WORD
from .shared import executors_parallelism, written

PLAN_SCHEMA = (
    "m_source string, m_block int, source_size long, target double, copies int, part_words long, "
    "shards array<int>"
)
#: Columns that the mix makes; an input's own ones of these names give way.
OWN = (
    "size", "m_hash", "m_block", "m_source", "b_source", "n_blocks", "source_size", "target", "copies", "part",
    "part_words", "shards", "copy", "words", "shard", "place",
)


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 1 << 17
    max_blocks: int = 1 << 16
    shard_words: int = 1 << 22
    broadcast_rows: int = 1 << 18
    seed: int = 20


def fill_targets(sizes: list[int], weights: list[float], pool: float, cap: float) -> list[float]:
    """Share ``pool`` by weight; none gets over ``cap`` times its size, what is over goes to the rest."""
    target = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = pool
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block quotas whose columns add up to ``quotas`` exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = round(int(have.sum()) * (mid - lo) / (hi - lo))
        rng = np.random.default_rng([seed, lo, hi])
        left = (
            rng.multivariate_hypergeometric(have, take, method="marginals")
            if take
            else np.zeros_like(have)
        )
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, quotas.astype(np.int64))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size (words of the whole text) and the row's hash."""
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count("text", F.lit(PLAIN_WORD)), F.lit(0)).cast("long"),
            "m_hash": F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))),
        }
    )


def _blocked(rows: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    m = rows.join(counts, rows["source"].eqNullSafe(counts["b_source"])).drop("b_source")
    return m.withColumn("m_block", F.pmod(F.xxhash64(F.lit(seed), "m_hash"), F.col("n_blocks")).cast("int"))


def draw_blocks(
    runs: list[list[tuple[int, int | None]]], quotas: np.ndarray
) -> dict[tuple[int, int], list[tuple[int, int | None]]]:
    """What the shards draw: (source, block) to its draws, each a shard and the words of a cut block.

    A shard takes the next blocks of every source's permuted run, as many as its quota of that source.
    """
    drawn: dict[tuple[int, int], list[tuple[int, int | None]]] = {}
    taken = [0] * len(runs)
    for shard, quota in enumerate(quotas.tolist()):
        for i, n in enumerate(quota):
            for block, part in runs[i][taken[i] : taken[i] + n]:
                drawn.setdefault((i, block), []).append((shard, part))
            taken[i] += n
    return drawn


def plan_mix(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, int]:
    """The block plan, each source's number of blocks and the number of shards. ``rows``: source, size, m_hash."""
    spark = rows.sparkSession
    # One row for each source: their number is that of the mix's targets.
    found = rows.groupBy("source").agg(F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in found]
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(found))]
    targets = fill_targets(sizes, weights, mix.share * sum(sizes), mix.cap)
    most = max(1, mix.max_blocks // max(1, len(found)))
    n_blocks = [min(most, max(1, -(-s // mix.block_words))) for s in sizes]
    counts = spark.createDataFrame(
        [(r["source"], n) for r, n in zip(found, n_blocks)], "b_source string, n_blocks int"
    )
    index = {r["source"]: i for i, r in enumerate(found)}
    words = [np.zeros(n, np.int64) for n in n_blocks]
    at = F.broadcast(counts) if len(found) <= mix.broadcast_rows else counts
    for r in _blocked(rows, at, mix.seed).groupBy("source", "m_block").agg(F.sum("size").alias("w")).collect():
        words[index[r["source"]]][r["m_block"]] = r["w"]

    # Each source's blocks in permuted order, as often as its target takes them.
    runs: list[list[tuple[int, int | None]]] = []
    for i, (size, target) in enumerate(zip(sizes, targets)):
        rng = np.random.default_rng([mix.seed, i])
        aim = min(round(target), math.floor(mix.cap * size))
        run: list[tuple[int, int | None]] = []
        while aim > 0 and size:
            for b in rng.permutation(n_blocks[i]).tolist():
                if aim <= 0:
                    break
                w = int(words[i][b])
                run.append((b, None if w <= aim else aim))
                aim -= min(w, aim)
        runs.append(run)
    draws = np.array([len(r) for r in runs], np.int64)
    shards = max(1, min(int(draws.sum()), -(-round(sum(targets)) // mix.shard_words)))
    drawn = draw_blocks(runs, split_tree(draws, shards, mix.seed))
    rows_ = []
    for i, r in enumerate(found):
        for b in range(n_blocks[i]):
            own = sorted(drawn.get((i, b), []), key=lambda d: d[1] is not None)  # whole copies first, the cut one last
            part = next((p for _, p in own if p is not None), None)
            copies = sum(p is None for _, p in own)
            rows_.append((r["source"], b, sizes[i], float(targets[i]), copies, part, [shard for shard, _ in own]))
    plan = spark.createDataFrame(rows_, PLAN_SCHEMA)
    if len(rows_) <= mix.broadcast_rows:
        plan, counts = F.broadcast(plan), F.broadcast(counts)
    return plan, counts, shards


def decide_mix(docs: DataFrame, mix: Mix = Mix(), rows: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``docs`` with size, source_size, target, copies, part (words of a further, cut copy) and shards; and how many shards there are.

    ``rows``: the same documents' (source, size, m_hash), if they are at hand.
    """
    if rows is None:
        rows = written(sized(docs).select("doc_id", "source", "size", "m_hash"), "mix-sizes")
        own = sized(docs.drop(*OWN))
    else:
        own = docs
    plan, counts, shards = plan_mix(rows, mix)
    joined = _blocked(own, counts, mix.seed)
    joined = joined.join(
        plan, joined["source"].eqNullSafe(plan["m_source"]) & (joined["m_block"] == plan["m_block"])
    ).drop(plan["m_block"]).drop("m_source", "n_blocks")
    whole = joined.where("part_words IS NULL").withColumn("part", F.lit(0).cast("long"))
    # One block of each source is cut: its rows alone are ordered.
    order = W.partitionBy("source", "m_block").orderBy(
        F.xxhash64(F.lit(mix.seed + 1), "m_hash"), "m_hash"
    ).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = joined.where("part_words IS NOT NULL").withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part_words") - before)).cast("long")
    )
    return whole.unionByName(cut).drop("part_words", "m_block"), shards


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed documents: a row for each copy, with shard, place and words, each shard in one partition in order of place.

    A cut copy's text ends at its last word and is not changed before it.
    """
    chosen, shards = decide_mix(docs, mix)
    n = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = chosen.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    is_cut = F.col("copy") > F.col("copies")
    word = PLAIN_WORD.replace("[^", "[").replace("]+", "]*") + PLAIN_WORD
    kept = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(word), F.lit(0)), 1, F.col("part").cast("int")), "")
    mixed = (
        each.withColumn("text", F.when(is_cut & (F.col("part") < F.col("size")), kept).otherwise(F.col("text")))
        .withColumn("words", F.when(is_cut, F.col("part")).otherwise(F.col("size")))
        .withColumn("shard", F.get("shards", F.col("copy") - 1))
        .withColumn("place", F.xxhash64(F.lit(mix.seed + 2), "m_hash", "copy"))
        .drop("copies", "part", "shards", "m_hash")
    )
    tasks = max(executors_parallelism(docs.sparkSession), -(-shards // 4))
    return mixed.repartition(tasks, "shard").sortWithinPartitions("shard", "place", "doc_id")


def mixing_digest(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the shards that a document's copies, the cut one last, went to."""
    rows = written(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    n = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    return decide_mix(rows, mix, rows)[0].select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.slice("shards", 1, n).alias("shards"),
    )
