"""Repeated passages by a compacted de Bruijn graph of word runs.

Edges are the runs of ``window`` words.  A node is a window's minimizer, the
smallest of its ``seed_words``-word runs, and all consecutive windows that share
one occurrence of it are the path through that node there.  Equal windows have
the same minimizer, so a window can only repeat where its node does.

1.  Nodes are grouped: one that stands in a single document goes; one whose
    paths are all the same does not branch; one with different paths does.  Both
    sorts go into filters of bounded size.
2.  The path through a node that does not branch compacts to one edge with its
    number of windows; around a branching node every window is an edge of its
    own.  Edges have source coordinates (document, start, windows).
3.  A grouped minimum finds the edges of more than one document and their first
    document, a join gives each occurrence that document, and occurrences that
    follow each other in a document compact into spans, which are removed.

Compaction is exact: all occurrences of a window around an unbranched node lie
in equal paths, so the path's first document is the window's.  Filters answer by
the node's hash, alike for all its occurrences; a false answer makes more edges
or single ones and never loses one.  An edge's key has 95 bits of two hashes.
Hot edges are combined before the shuffle, and the join back is one that adaptive
execution can split.

Words part at ASCII white space and are compared unchanged.  A null text has no
words; a document with a null doc_id has nothing removed and makes nothing else
be removed; rows that repeat a doc_id count as one document's.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, settle, ship, written_at
from .shingles import bloom_bits, bloom_of


@dataclass(frozen=True)
class Passages:
    window: int = 13
    seed_words: int = 7
    most_bits: int = 28


def minimizers(h: np.ndarray, counts: np.ndarray, cfg: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each whole window, its minimizer's place, text), over all texts' words."""
    from .shingles import rolling

    ends = np.cumsum(counts)
    n_windows = np.maximum(0, counts - cfg.window + 1)
    text = np.repeat(np.arange(len(counts)), n_windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + (ends - counts)[text]
    if not len(start):
        return start, start, text
    seeds = rolling(h, cfg.seed_words)
    width = cfg.window - cfg.seed_words + 1
    least, place = seeds[start], np.zeros(len(start), np.int64)
    for k in range(1, width):
        s = seeds[start + k]
        less = s < least
        least[less], place[less] = s[less], k
    return start, start + place, text


def paths_of(
    h: np.ndarray, counts: np.ndarray, cfg: Passages
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The paths through all minimizers: (node's hash, first window's start, windows, text, key, second key).

    Two paths with the same keys have the same words: their first and last windows cover them all.
    """
    from .shingles import mix, rolling

    start, place, text = minimizers(h, counts, cfg)
    if not len(start):
        none = np.empty(0, np.uint64)
        return none, start, start, text, none, none
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(new, len(start)))
    first, last = start[new], start[new] + size - 1
    keys = []
    for which in (0, 1):
        w = rolling(h, cfg.window, which)
        keys.append(mix(w[first] + mix(w[last] + size.astype(np.uint64), 3), 4))
    return rolling(h, cfg.seed_words)[place[new]], first, size, text[new], *keys


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("variant", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int"))


def repeated_places(docs: DataFrame, cfg: Passages = Passages()) -> DataFrame:
    """(doc_id, variant, starts, lengths): windows that an earlier document holds, as runs of starts."""
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs).where("doc_id IS NOT NULL")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.shingles import runs_of, word_hashes
        from embermill.llm.substrings import paths_of

        forget_encoders()
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").to_numpy()
            for lo, hi in runs_of(texts):
                node, _, _, text, key, _ = paths_of(*word_hashes(texts.slice(lo, hi - lo), False), cfg)
                if len(node):
                    yield pa.RecordBatch.from_pydict(
                        {"h": node.view(np.int64), "doc_id": names[lo:hi][text], "path": key.view(np.int64)}
                    )
            _give_back()

    found = keyed.select("doc_id", "text").mapInArrow(nodes, "h long, doc_id long, path long")
    shared = found.groupBy("h").agg(
        (F.min("doc_id") != F.max("doc_id")).alias("twice"), (F.min("path") != F.max("path")).alias("branches")
    )
    shared, node_path = written_at(shared.where("twice").select("h", "branches"), "nodes")
    n, branching = shared.agg(F.count("*"), F.count(F.when(F.col("branches"), 1))).first()
    bits = bloom_bits(n, cfg.most_bits), bloom_bits(branching, cfg.most_bits)
    known = spark.sparkContext.broadcast(
        (bloom_of(shared.select("h"), bits[0]), bloom_of(shared.where("branches").select("h"), bits[1]))
    )
    drop_path(spark, node_path)
    del found, shared
    settle(spark)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.shingles import in_bloom, rolling, runs_of, word_hashes
        from embermill.llm.substrings import paths_of

        forget_encoders()
        repeated, branching = known.value
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").to_numpy()
            variants = batch.column("variant").to_numpy().astype(np.int64)
            for lo, hi in runs_of(texts):
                h, counts = word_hashes(texts.slice(lo, hi - lo), False)
                node, first, size, text, key, other = paths_of(h, counts, cfg)
                if not len(node):
                    continue
                hit = in_bloom(repeated, bits[0], node)
                node, first, size, text, key, other = (c[hit] for c in (node, first, size, text, key, other))
                apart = in_bloom(branching, bits[1], node)
                one = ~apart
                # every window of a branching node's paths is an edge
                many, n_each = first[apart], size[apart]
                to = np.cumsum(n_each)
                single = np.repeat(many - (to - n_each), n_each) + np.arange(int(to[-1]) if len(to) else 0)
                start = np.concatenate([first[one], single])
                owner = np.concatenate([text[one], np.repeat(text[apart], n_each)])
                h1 = np.concatenate([key[one], rolling(h, cfg.window)[single]])
                h2 = np.concatenate([other[one], rolling(h, cfg.window, 1)[single]])
                begin = (np.cumsum(counts) - counts)[owner]
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": h1.view(np.int64),
                        "g": (h2 >> np.uint64(33)).astype(np.int32),
                        "doc_id": names[lo:hi][owner],
                        "at": (variants[lo:hi][owner] << 32) | (start - begin),
                        "n": np.concatenate([size[one], np.ones(len(single), np.int64)]).astype(np.int8),
                    }
                )
            _give_back()

    places, path = written_at(keyed.mapInArrow(edges, "h long, g int, doc_id long, at long, n byte"), "edges")
    first = places.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first, first_path = written_at(first.where("first <> last").select("h", "g", "first"), "repeated")
    settle(spark)
    later, later_path = written_at(places.join(first, ["h", "g"]).where("doc_id > first").select("doc_id", "at", "n"), "later")
    drop_path(spark, first_path)
    drop_path(spark, path)
    settle(spark)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by document and place: edges that follow each other compact into (start, windows)."""
        held: list[tuple[np.ndarray, ...]] = []  # of the last document, which may go on

        def out(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # rows that repeat a document give its places twice
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
            doc, at, n = doc[new], at[new], n[new].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != (at + n)[:-1])]))
            length = np.add.reduceat(n, begin)
            doc, at = doc[begin], at[begin]
            own = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)]))
            ends = np.append(own, len(doc)).astype(np.int32)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": doc[own],
                    "variant": (at[own] >> 32).astype(np.int32),
                    "starts": pa.ListArray.from_arrays(ends, pa.array((at & 0xFFFFFFFF).astype(np.int32))),
                    "lengths": pa.ListArray.from_arrays(ends, pa.array(length.astype(np.int32))),
                }
            )

        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("doc_id", "at", "n"))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if held and (cut or now[0][0] != held[0][0][0]):
                held.append(tuple(c[:cut] for c in now))
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            elif cut:
                yield out(*(c[:cut] for c in now))
            held.append(tuple(c[cut:] for c in now))
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    ordered = later.repartition("doc_id").sortWithinPartitions("doc_id", "at")
    runs, _ = written_at(
        ordered.mapInArrow(spans, "doc_id long, variant int, starts array<int>, lengths array<int>"), "spans"
    )
    drop_path(spark, later_path)
    settle(spark)
    return runs


def remove_repeats(docs: DataFrame, cfg: Passages = Passages()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space."""
    runs = repeated_places(docs, cfg)
    # Only documents that lose words meet their spans in a join; a filter lets the others' texts stay where they are read.
    named = F.xxhash64("doc_id", "variant")
    bits = bloom_bits(runs.count(), cfg.most_bits)
    losing = docs.sparkSession.sparkContext.broadcast(bloom_of(runs.select(named.alias("h")), bits))

    @F.arrow_udf("boolean")
    def loses(h: pa.Array) -> pa.Array:
        from embermill.llm.shingles import in_bloom

        return pa.array(in_bloom(losing.value, bits, h.to_numpy(zero_copy_only=False).view(np.uint64)).astype(bool))

    keyed = _keyed(docs).withColumn("loses", loses(named))
    joined = keyed.where("loses").join(runs, ["doc_id", "variant"], "left").select("doc_id", "text", "starts", "lengths")
    none = F.lit(None).cast("array<int>")
    joined = joined.union(keyed.where("NOT loses").select("doc_id", "text", none.alias("starts"), none.alias("lengths")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            starts, lengths = batch.column("starts").to_pylist(), batch.column("lengths").to_pylist()
            n, gone, kept = [], [], []
            for text, s, ln in zip(texts, starts, lengths):
                words = text.split()
                n.append(len(words))
                if s:
                    stay, at, total = [], 0, 0
                    for a, b in sorted(zip(s, ln)):
                        stay += words[at:a]
                        end = a + b + cfg.window - 1
                        total += end - max(a, at)
                        at = max(at, end)
                    stay += words[at:]
                    gone.append(total)
                    words = stay
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(n, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def passages_digest(docs: DataFrame, cfg: Passages = Passages()) -> DataFrame:
    return remove_repeats(docs, cfg).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
