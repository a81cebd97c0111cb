"""Pack documents into fixed-length training sequences with little padding.

Documents are dealt at random (a hash of id and text) into groups of about
``group_bytes`` of text, however long each is; each group is packed on its own
by first-fit decreasing over a tournament tree of bin capacities.  Full-length pieces of a document are
sequences of their own; its remainder is an item.  A cut is free here, so when
a group's first-fit bins leave more than ``slack`` of padding, the emptiest bins
are dissolved and their items poured into the gaps of the others.

Nulls: a null text is an empty document, which holds the end id alone; null
doc_ids are packed like others.  Repeated rows are packed each on their own.
An empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import executors_parallelism, ship

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree over bins: the winner of a node is its largest free capacity."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin that has it and name that bin."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        bin_ = node - self.leaves
        best[node] -= size
        node //= 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            top = left if left >= right else right
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return bin_


def pack_lengths(
    lengths: list[int], capacity: int, slack: float = 0.002
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, bin, offset) for the items' lengths, and the number of bins.

    Zero-length items get no piece.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    bins = 0
    rest: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((item, k * capacity, capacity, bins, 0))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, item, full * capacity))
    if not rest:
        return pieces, bins
    rest.sort(key=lambda r: (-r[0], r[1]))
    tree = CapacityTree(len(rest), capacity)
    held: dict[int, list[tuple[int, int, int]]] = {}
    for n, item, start in rest:
        held.setdefault(tree.first_fit(n), []).append((item, start, n))
    fill = {b: sum(x[2] for x in v) for b, v in held.items()}
    free = capacity * len(fill) - sum(fill.values())
    if free > slack * capacity * (len(fill) + bins):
        order = sorted(fill, key=lambda b: (fill[b], b))
        drop: list[int] = []
        for b in order[:-1]:
            # pouring b out must fit into what the bins that stay have free
            if free - (capacity - fill[b]) < fill[b]:
                break
            free -= capacity
            drop.append(b)
        loose = [x for b in drop for x in held.pop(b)]
        gaps = [b for b in order[len(drop) :] if fill[b] < capacity]
        while loose:
            item, start, n = loose.pop()
            while n:
                while fill[gaps[-1]] == capacity:
                    gaps.pop()
                b = gaps[-1]
                take = min(n, capacity - fill[b])
                held[b].append((item, start, take))
                fill[b] += take
                start, n = start + take, n - take
    for b in sorted(held):
        at = 0
        for item, start, n in held[b]:
            pieces.append((item, start, n, bins, at))
            at += n
        bins += 1
    return pieces, bins


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    end_id: int = 1,
    capacity: int = 2048,
    group_bytes: int = 4 << 20,
    row_bytes: int = 64,
    seed: int = 17,
    slack: float = 0.002,
    cache_bytes: int | None = None,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their ids, sequence and offset.

    Texts are encoded where they are read; one shuffle carries the ids (two
    bytes each while the vocabulary allows) to the groups.  A document weighs its
    text and ``row_bytes``, so empty ones fill a group too; a task takes a few groups
    at any input.  With ``cache_bytes``, a worker keeps no more of its encoder's pieces
    and gives the encoder up with each task: idle workers take turns, and each would
    hold one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    weight = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + row_bytes
    groups = max(1, -(-(docs.agg(F.sum(weight)).first()[0] or 0) // group_bytes))
    tasks = min(groups, max(executors_parallelism(spark), -(-groups // 8)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import encoder, forget_encoders, with_end

        enc = encoder(shared.value, cache_bytes=cache_bytes)
        small = enc.tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536
        kind = "<u2" if small else "<u4"
        for batch in batches:
            done = 0
            for ids, ends in enc.flat(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                part = batch.slice(done, len(ends))
                width = 2 if small else 4
                raw = pa.Array.from_buffers(
                    pa.binary(),
                    len(ends),
                    [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32)), pa.py_buffer(ids.astype(kind))],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("bucket"), pa.array([width] * len(ends), pa.int32()), raw],
                    names=["doc_id", "bucket", "width", "ids"],
                )
                done += len(ends)
        if cache_bytes is not None:
            del enc
            forget_encoders()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        from embermill.llm.encoding import _give_back

        bucket = key[0].as_py()
        names, raw = table.column("doc_id").to_pylist(), table.column("ids").combine_chunks()
        width = table.column("width").to_numpy()
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        body = memoryview(raw.buffers()[2] or b"")
        bytes_of = [body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or 0, bytes(bytes_of[i])))
        lengths = ((ends[1:] - ends[:-1]) // width)[order]
        ids = np.concatenate([np.frombuffer(bytes_of[i], f"<u{width[i]}").astype("<u4") for i in order])
        pieces, _ = pack_lengths(lengths.tolist(), capacity, slack)
        item, start, length, bin_, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        # every piece's ids, taken from the documents' in the order of the pieces
        first = (np.cumsum(lengths) - lengths)[item] + start
        to = np.cumsum(length)
        at = np.repeat(first - (to - length), length) + np.arange(int(to[-1]) if len(to) else 0)
        own = pa.Array.from_buffers(
            pa.binary(),
            len(item),
            [None, pa.py_buffer((4 * np.concatenate([[0], to])).astype(np.int32)), pa.py_buffer(ids[at])],
        )
        out = pa.table(
            {
                "doc_id": pa.array(names, pa.int64()).take(pa.array(np.array(order, np.int64)[item])),
                "start": start,
                "length": length,
                "ids": own,
                "doc_tokens": lengths[item].astype(np.int64),
                "sequence_id": (bucket << 32) + bin_,
                "offset": offset,
            }
        )
        del ids, at, bytes_of, body
        _give_back()
        return out

    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", text), F.lit(groups)).alias("bucket"),
        text.alias("text"),
    )
    coded = dealt.mapInArrow(encode, "doc_id long, bucket long, width int, ids binary")
    return coded.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(pack, PIECE_SCHEMA)


def packing_digest(docs: DataFrame, tokenizer_json: str, **options) -> DataFrame:
    return pack_documents(docs, tokenizer_json, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
