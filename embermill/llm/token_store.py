"""Token-ID store: encoded documents as bit- or byte-plane shuffled, zstd-compressed id blocks.

File format (version 1).  A store is a Parquet dataset; each row is one
*segment*: whole documents in ascending order, closed at the first document
boundary past ``segment_ids`` ids.  Its ids are cut into fixed-size blocks, each
block is transposed into planes (4 byte planes, or 32 bit planes with bit 0
first), and every plane is one zstandard frame in ``payload``.  The chunk index
is ``frame_ends``: the end offset of each frame, block by block and plane by
plane, so one block can be read without the others.  Index columns are separate
Parquet columns, so reading the index does not read payloads.

Nulls: a null text counts as empty (its document holds the end id alone); null
doc_ids come first.  Ties on doc_id are ordered by the text's hash, then the
text.  An empty table gives an empty store.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .shared import new_path, ship

STORE_SCHEMA = (
    "shard int, segment int, first_id long, n_ids long, block_ids int, planes string, "
    "doc_ids array<long>, doc_tokens array<long>, frame_ends array<long>, payload binary"
)
DOC_SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, ids binary"


def shuffle_block(ids: np.ndarray, planes: str) -> list[bytes]:
    """A block of uint32 ids as its planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(len(ids), 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def unshuffle_block(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        raw = np.empty((n, 4), np.uint8)
        for k, p in enumerate(parts):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    packed = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    bits = np.unpackbits(packed, axis=1, count=n)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_segment(ids: np.ndarray, block_ids: int, planes: str, level: int) -> tuple[bytes, list[int]]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level)
    frames, ends, at = [], [], 0
    for i in range(0, len(ids), block_ids):
        for plane in shuffle_block(ids[i : i + block_ids], planes):
            frames.append(squeeze.compress(plane))
            at += len(frames[-1])
            ends.append(at)
    return b"".join(frames), ends


def unpack_segment(payload: bytes, ends: list[int], n_ids: int, block_ids: int, planes: str) -> np.ndarray:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    count = 4 if planes == "byte" else 32
    out, at, view = np.empty(n_ids, "<u4"), 0, memoryview(payload)
    for b in range((n_ids + block_ids - 1) // block_ids):
        n = min(block_ids, n_ids - b * block_ids)
        parts = []
        for end in ends[b * count : (b + 1) * count]:
            parts.append(open_.decompress(view[at:end]))
            at = end
        out[b * block_ids : b * block_ids + n] = unshuffle_block(parts, n, planes)
    return out


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    *,
    end_id: int = 2,
    block_ids: int = 16_384,
    segment_ids: int = 1 << 18,
    planes: str = "byte",
    level: int = 3,
) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``.

    One range shuffle puts the documents in order; each task encodes its range
    and streams segments out, holding one segment at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from embermill.llm.encoding import encoder, with_end

        enc = encoder(shared.value)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_of: list[int | None] = []
        sizes: list[int] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, first, total
            payload, ends = pack_segment(np.concatenate(held), block_ids, planes, level)
            columns = {
                "shard": pa.array([shard], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "first_id": pa.array([first], pa.int64()),
                "n_ids": pa.array([total], pa.int64()),
                "block_ids": pa.array([block_ids], pa.int32()),
                "planes": pa.array([planes]),
                "doc_ids": pa.array([list(ids_of)], pa.list_(pa.int64())),
                "doc_tokens": pa.array([list(sizes)], pa.list_(pa.int64())),
                "frame_ends": pa.array([ends], pa.list_(pa.int64())),
                "payload": pa.array([payload], pa.binary()),
            }
            segment, first, total = segment + 1, first + total, 0
            held.clear(), ids_of.clear(), sizes.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            names, done = batch.column("doc_id").to_pylist(), 0
            for ids, ends in enc.flat(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                starts = np.concatenate([[0], ends[:-1]])
                lo = 0
                while lo < len(ends):
                    # up to the first document that fills the segment
                    hi = int(np.searchsorted(ends, starts[lo] + segment_ids - total)) + 1
                    hi = min(hi, len(ends))
                    held.append(ids[starts[lo] : ends[hi - 1]])
                    ids_of += names[done + lo : done + hi]
                    sizes += (ends[lo:hi] - starts[lo:hi]).tolist()
                    total += int(ends[hi - 1] - starts[lo])
                    lo = hi
                    if total >= segment_ids:
                        yield close()
                done += len(ends)
        if sizes:
            yield close()

    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
        )
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(encode, STORE_SCHEMA).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian)."""
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back

        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                ids = unpack_segment(
                    row["payload"], row["frame_ends"], row["n_ids"], row["block_ids"], row["planes"]
                )
                sizes = np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(np.full(len(sizes), row["shard"], np.int32)),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start_in_shard": pa.array(row["first_id"] + ends - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids": pa.Array.from_buffers(
                            pa.binary(),
                            len(sizes),
                            [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids)],
                        ),
                    }
                )
                del row, ids
                _give_back()

    rows = spark.read.schema(STORE_SCHEMA).parquet(path)
    # One row per shard: at most one for each task that wrote the store.
    base = rows.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select(
        F.col("shard").alias("at_shard"),
        (F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).alias("base"),
    )
    docs = rows.mapInArrow(decode, DOC_SCHEMA)
    return docs.join(F.broadcast(base), docs.shard == base.at_shard).select(
        "doc_id",
        (F.coalesce("base", F.lit(0)) + F.col("start_in_shard")).cast("long").alias("start"),
        "n_tokens",
        "ids",
    )


def token_store_digest(docs: DataFrame, tokenizer_json: str, **options) -> DataFrame:
    """Write a store in the shared folder, read it back and digest each document's ids."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer_json, **options)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
