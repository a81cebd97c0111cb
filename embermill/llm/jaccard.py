"""N-gram Jaccard join with filters under several global token orders.

A document's set is its distinct ``n``-word shingles.  Two sets with a Jaccard
similarity of at least t leave at most e = floor((1 - t) * size) shingles of
either out of the other, so under *any* global order of shingles, of a set's
first q shingles all but e stand early in its partner too.  Each order is such a
filter, and a document stays a candidate only if it passes all of them:

1.  order by one random hash, and then
2.  by another, over whole corpora: of a set's first 1.5 e + 1 shingles at least
    half an e (and one) must stand among the early ones of another document;
3.  rarest first, by exact counts among the documents left, the classic prefix:
    documents that share one of their first e + 1 shingles are candidates.

Equal sets are one class throughout.  Candidates form groups by components of
their shared prefix shingles; a group is cut to blocks of ``block`` classes of
similar size.  Within a pair of blocks the filters meet for each pair of sets: a
pair stays only if it shares one of its first e + 1 shingles under order 1 and
one under order 2, and only sets with such a partner are verified, by counting
common shingles as a matrix product.  Links come back as spanning stars.  So no
pair is lost, none is listed within a group, and a group of any size is many
bounded tasks.

Words part at ASCII white space, with A-Z lowered; a text of fewer than ``n``
words is one shingle; a null or empty one has an empty set and links with
nothing.  A null doc_id links like others but does not name a component while
there is another name.  Repeated rows are equal sets.  An empty table gives no
rows; extra columns are ignored by the join and kept by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_path, settle, ship, written_at
from .shingles import bloom_bits, bloom_of, mix


@dataclass(frozen=True)
class Join:
    n: int = 4
    percent: int = 85
    orders: tuple[int, ...] = (1, 2)
    block: int = 256
    most_bits: int = 28


def sets_of(texts: pa.Array, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct shingles, set sizes), ascending within a text in the order of ``seed``."""
    from .shingles import mix, rolling, word_hashes

    h, counts = word_hashes(texts, True)
    ends = np.cumsum(counts)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    to = np.cumsum(sizes)
    text = np.repeat(np.arange(len(counts)), sizes)
    start = np.arange(len(text)) - (to - sizes)[text] + (ends - counts)[text]
    runs = rolling(h, n)
    grams = runs[np.minimum(start, max(0, len(runs) - 1))] if len(runs) else np.zeros(len(start), np.uint64)
    for t in np.flatnonzero((counts > 0) & (counts < n)):  # fewer than n words each
        words = h[ends[t] - counts[t] : ends[t]]
        grams[to[t] - 1] = mix(rolling(words, len(words)) + np.uint64(len(words)), 9)[0]
    if seed:
        grams = mix(grams, seed)
    for lo, hi in zip((to - sizes).tolist(), to.tolist()):
        grams[lo:hi].sort()
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])])
        grams, text = grams[new], text[new]
    return grams, np.bincount(text, minlength=len(counts)).astype(np.int64)


def spare(size: np.ndarray | int, percent: int):
    """How many shingles of a set of that size a partner may lack."""
    return size * (100 - percent) // 100


def early(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingles tested, first shingles shown to others) of sets of these sizes, under any order.

    A shared shingle's rank in the partner is at most its own rank and what the
    partner has besides; the partner may be larger by 1 / t.
    """
    tested = np.minimum(size, spare(size, percent) * 3 // 2 + 1)
    most = size * 100 // percent + 1
    reach = spare(most, percent) * 3 // 2 + 1 + spare(size, percent)
    return tested, np.minimum(size, reach)


def ranks(sizes: np.ndarray) -> np.ndarray:
    """Each shingle's place in its set."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _filtered(docs: DataFrame, seed: int, cfg: Join) -> DataFrame:
    """The documents (key, text) that pass the filter of one order."""
    spark = docs.sparkSession

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.jaccard import early, ranks, sets_of
        from embermill.llm.shingles import runs_of

        forget_encoders()
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key").to_numpy()
            for lo, hi in runs_of(texts):
                m, sizes = sets_of(texts.slice(lo, hi - lo), cfg.n, seed)
                rank = ranks(sizes)
                _, shown = early(sizes, cfg.percent)
                use = rank < np.repeat(shown, sizes)
                yield pa.RecordBatch.from_pydict(
                    {"h": m[use].view(np.int64), "key": np.repeat(keys[lo:hi], sizes)[use]}
                )
            _give_back()

    twice = F.min("key") != F.max("key")
    seen = docs.mapInArrow(show, "h long, key long").groupBy("h").agg(twice.alias("twice"))
    shared, path = written_at(seen.where("twice").select("h"), "shingles")
    bits = bloom_bits(shared.count(), cfg.most_bits)
    known = spark.sparkContext.broadcast(bloom_of(shared, bits))
    drop_path(spark, path)
    del seen, shared
    settle(spark)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.jaccard import early, ranks, sets_of, spare
        from embermill.llm.shingles import in_bloom, runs_of

        forget_encoders()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in runs_of(texts):
                m, sizes = sets_of(texts.slice(lo, hi - lo), cfg.n, seed)
                rank = ranks(sizes)
                tested, _ = early(sizes, cfg.percent)
                use = rank < np.repeat(tested, sizes)
                hit = in_bloom(known.value, bits, m[use])
                text = np.repeat(np.arange(len(sizes)), sizes)[use]
                found = np.bincount(text[hit], minlength=len(sizes))
                passes = (sizes > 0) & (found >= tested - spare(sizes, cfg.percent))
                yield batch.slice(lo, hi - lo).filter(pa.array(passes))
            _give_back()

    return docs.mapInArrow(test, docs.schema)


def _common(gx: np.ndarray, rx: np.ndarray, nx: int, gy: np.ndarray, ry: np.ndarray, ny: int) -> np.ndarray:
    """How many values each set of one side has in common with each of the other, as a product of 0-1 matrices.

    ``gx`` are the values of all sets of a side and ``rx`` the set of each, of ``nx`` sets.
    """
    both = np.zeros((nx, ny), np.float32)
    names = np.intersect1d(gx, gy)  # a value of one side alone is common to none
    if not len(names):
        return both
    sides = []
    for g, r in ((gx, rx), (gy, ry)):
        at = np.minimum(np.searchsorted(names, g), len(names) - 1)
        real = names[at] == g
        sides.append((at[real], r[real]))
    (ax, rx), (ay, ry) = sides
    width = 8192
    for lo in range(0, len(names), width):
        a, b = np.zeros((nx, width), np.float32), np.zeros((ny, width), np.float32)
        for matrix, at, r in ((a, ax, rx), (b, ay, ry)):
            part = (at >= lo) & (at < lo + width)
            matrix[r[part], at[part] - lo] = 1
        both += a @ b.T
    return both


def candidates(grams: list[np.ndarray], sizes: list[np.ndarray], cfg: Join) -> np.ndarray:
    """Pairs (of the first side's sets and the second's) that share an early shingle under every order, as a matrix.

    A linked pair has a shingle in common among the first spare + 1 of each, whatever the order.
    """
    pair = np.ones((len(sizes[0]), len(sizes[1])), bool)
    for seed in cfg.orders:
        parts = []
        for g, size in zip(grams, sizes):
            rows = np.repeat(np.arange(len(size)), size)
            m = mix(g.view(np.uint64), seed)
            order = np.lexsort((m, rows))
            early_ = ranks(size) < np.repeat(spare(size, cfg.percent) + 1, size)
            parts.append((m[order][early_], rows[early_]))
        (mx, rx), (my, ry) = parts
        pair &= _common(mx, rx, len(sizes[0]), my, ry, len(sizes[1])) > 0
        if not pair.any():
            break
    return pair


def _links(x: pa.Table, y: pa.Table | None, cfg: Join) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs between two blocks of sets, or within one.

    The candidates of all orders are intersected for each pair; sets without one are
    left out, the others' common shingles are counted.
    """

    def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = t.column("grams").combine_chunks()
        return sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())

    gx, sx = parts(x)
    gy, sy = (gx, sx) if y is None else parts(y)
    pair = candidates([gx, gy], [sx, sy], cfg)
    # sizes alone rule out more
    pair &= (100 * np.minimum(sx[:, None], sy) >= cfg.percent * np.maximum(sx[:, None], sy))
    if y is None:
        np.fill_diagonal(pair, False)
    i, j = np.flatnonzero(pair.any(1)), np.flatnonzero(pair.any(0))
    if not len(i):
        return i, j
    sides = []
    for g, size, keep in ((gx, sx, i), (gy, sy, j)):
        to = np.full(len(size), -1)
        to[keep] = np.arange(len(keep))
        row = np.repeat(to, size)
        sides.append((g[row >= 0], row[row >= 0], len(keep)))
    same = _common(*sides[0], *sides[1]).astype(np.int64)
    union = sx[i][:, None] + sy[j][None, :] - same
    r, c = np.nonzero((100 * same >= cfg.percent * union) & pair[np.ix_(i, j)])
    return i[r], j[c]


def jaccard_components(docs: DataFrame, cfg: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, the row's key and its group's own label (null without shingles)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("doc_id", "text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.jaccard import sets_of
        from embermill.llm.shingles import mix, runs_of

        forget_encoders()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in runs_of(texts):
                grams, sizes = sets_of(texts.slice(lo, hi - lo), cfg.n)
                ends = np.cumsum(sizes)
                total = [
                    np.concatenate([[np.uint64(0)], np.cumsum(mix(grams, s), dtype=np.uint64)]) for s in (11, 12)
                ]
                one, two = (t[ends] - t[ends - sizes] for t in total)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["doc_id", "key", "n_shingles", "f1", "f2"],
                )
            _give_back()

    marks, _ = written_at(rows.mapInArrow(prints, "doc_id long, key long, n_shingles long, f1 long, f2 long"), "prints")
    # A class is named by its fingerprint; its least key stands for it.
    classes = marks.where("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("least")
    )
    left = rows.select("key", "text")
    paths = []
    for seed in cfg.orders:
        left, path = written_at(_filtered(left, seed, cfg), "candidates")
        paths.append(path)
    # One text of each class goes on.
    left = left.join(classes.select("key"), "key").dropDuplicates(["key"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back
        from embermill.llm.jaccard import sets_of
        from embermill.llm.shingles import runs_of

        for batch in batches:
            texts = batch.column("text")
            for lo, hi in runs_of(texts):
                _give_back()
                grams, sizes = sets_of(texts.slice(lo, hi - lo), cfg.n)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").slice(lo, hi - lo),
                        "size": pa.array(sizes),
                        "grams": pa.ListArray.from_arrays(ends, pa.array(grams.view(np.int64))),
                    }
                )

    sets, sets_path = written_at(left.mapInArrow(explode, "key long, size long, grams array<long>"), "sets")
    for path in paths:
        drop_path(spark, path)
    tokens = sets.select("key", "size", F.explode("grams").alias("h"))
    count = tokens.groupBy("h").agg(F.count("*").alias("df"))
    # Shingles of one set only come first in its order and meet no other.
    common = tokens.join(count.where("df > 1"), "h")
    ordered = common.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("known"))
    prefix = F.floor(F.col("size") * (100 - cfg.percent) / 100) + 1 - (F.col("size") - F.size("known"))
    buckets = ordered.where(prefix > 0).select("key", F.explode(F.slice("known", 1, prefix.cast("int"))).alias("t"))
    buckets, bucket_path = written_at(buckets.select("key", F.col("t.h").alias("h")), "prefixes")
    hub = buckets.groupBy("h").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = buckets.join(hub, "h").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    groups, group_path = written_at(
        components(stars).select(F.col("node").alias("key"), F.col("component").alias("cluster")), "groups"
    )
    drop_path(spark, bucket_path)
    del tokens, count, common, ordered, buckets, hub, stars
    settle(spark)
    clustered, clustered_path = written_at(sets.join(groups, "key"), "clustered")
    drop_path(spark, sets_path)
    drop_path(spark, group_path)
    links = _verified(clustered, cfg)
    linked = components(links)
    named = classes.join(linked.withColumnRenamed("node", "key"), "key", "left").select(
        "f1", "f2", "least", F.coalesce("component", "key").alias("component")
    )
    named, _ = written_at(named, "named")
    drop_path(spark, clustered_path)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("f1", "f2", "component", "component_id")
    out = marks.join(named, ["f1", "f2"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "key",
        F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
    )


def _verified(clustered: DataFrame, cfg: Join) -> DataFrame:
    """Links (a, b) of the clusters as spanning stars, from pairs of blocks of sets of similar size."""
    # A block is a range of sizes in steps that a link cannot pass two of, dealt at random to parts
    # of about ``block`` sets; so blocks are named from counts, without ordering a cluster in one task.
    step = math.log(100 / cfg.percent) + 1e-9
    band = F.floor(F.log(F.col("size")) / F.lit(step)).cast("int")
    banded = clustered.withColumn("band", band)
    sizes = banded.groupBy("cluster", "band").agg(F.count("*").alias("sets")).withColumn(
        "parts", F.ceil(F.col("sets") / F.lit(cfg.block)).cast("int")
    )
    near = sizes.alias("l").join(
        sizes.alias("r"),
        (F.col("l.cluster") == F.col("r.cluster")) & F.col("r.band").between(F.col("l.band"), F.col("l.band") + 1),
    )
    # (band, part) of the left block with those of the right: both sides are named from here.
    pairs = near.select(
        F.col("l.cluster").alias("cluster"),
        F.col("l.band").alias("lb"),
        F.explode(F.sequence(F.lit(0), F.col("l.parts") - 1)).alias("lp"),
        F.col("r.band").alias("rb"),
        F.col("r.parts").alias("rparts"),
    ).select("cluster", "lb", "lp", "rb", F.explode(F.sequence(F.lit(0), F.col("rparts") - 1)).alias("rp"))
    pairs = pairs.where("rb > lb OR rp >= lp")
    task = F.xxhash64("cluster", "lb", "lp", "rb", "rp")
    sides = pairs.select(
        task.alias("task"),
        "cluster",
        F.explode(
            F.when(
                (F.col("lb") == F.col("rb")) & (F.col("lp") == F.col("rp")),
                F.array(F.struct(F.lit(0).alias("side"), F.col("lb").alias("band"), F.col("lp").alias("part"))),
            ).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("lb").alias("band"), F.col("lp").alias("part")),
                    F.struct(F.lit(1).alias("side"), F.col("rb").alias("band"), F.col("rp").alias("part")),
                )
            )
        ).alias("s"),
    ).select("task", "cluster", "s.side", "s.band", "s.part")
    parted = banded.join(sizes.select("cluster", "band", "parts"), ["cluster", "band"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(7), "key"), F.col("parts")).cast("int")
    )
    dealt = parted.join(sides, ["cluster", "band", "part"]).select("task", "side", "key", "grams")

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        from embermill.llm.components import forest
        from embermill.llm.jaccard import _links

        from embermill.llm.encoding import _give_back

        _give_back()
        side = t.column("side").to_numpy()
        x = t.filter(pa.array(side == 0))
        y = t.filter(pa.array(side == 1)) if (side == 1).any() else None
        names = x.column("key").to_numpy()
        others = names if y is None else y.column("key").to_numpy()
        i, j = _links(x, y, cfg) if len(x) else (np.empty(0, int),) * 2
        a, b = names[i], others[j]
        a, b = a[a != b], b[a != b]
        u, v = forest(a, b) if len(a) else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return dealt.groupBy("task").applyInArrow(verify, "a long, b long")


def jaccard_digest(docs: DataFrame, cfg: Join = Join()) -> DataFrame:
    return jaccard_components(docs, cfg).drop("key", "component")


def keep_first(docs: DataFrame, cfg: Join = Join()) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id (and the least row of it)."""
    rows = jaccard_components(docs, cfg)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min_by("key", order).alias("key"))
    named = first.select("key").unionByName(rows.where("component IS NULL").select("key")).distinct()
    own = docs.withColumn("jaccard_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    kept = own.join(named, own["jaccard_key"] == named["key"], "left_semi")
    return kept.dropDuplicates(["jaccard_key"]).drop("jaccard_key")
