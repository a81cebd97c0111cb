"""Hashes of word runs over whole texts, in numpy, and a bounded filter of repeated hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that orders them at random; each seed is another order."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, words of each text); words part at ASCII white space."""
    import xxhash

    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = cut.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    at = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    # Empty pieces at a text's edges are no words.
    if b"" in names:
        real = np.array([n != b"" for n in names], bool)[at]
        text = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(text[real], minlength=len(counts)).astype(np.int64)
        at = at[real]
    return hashes[at], counts


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k values, whatever text it crosses."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASES[which] + h[j : j + n]
    return mix(out, which)


def runs_of(texts: pa.Array, size: int = 2_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + size)))
        yield start, end
        start = end


# ------------------------------------------------------------ filter of repeated hashes


def bloom_bits(n: int, most: int = 28) -> int:
    """log2 of the filter's bits: 16 a hash, at most 2**most, so its size is bounded at any input."""
    return max(16, min(most, math.ceil(math.log2(16 * max(1, n)))))


def bloom_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter's words. ``hashes``: one long column h.

    Only 2**bits / 64 words can reach the driver, however many hashes there are;
    a full filter lets more candidates through and never drops one.
    """
    mask = (1 << bits) - 1
    spots = hashes.select(
        F.explode(
            F.array(
                F.col("h").bitwiseAND(F.lit(mask)),
                F.shiftrightunsigned("h", 64 - bits).bitwiseAND(F.lit(mask)),
            )
        ).alias("spot")
    )
    words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(spot & 63 AS int)))").alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(bloom: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    six, low = np.uint64(6), np.uint64(63)
    a, b = h & mask, h >> np.uint64(64 - bits)
    one = np.uint64(1)
    return ((bloom[(a >> six).astype(np.int64)] >> (a & low)) & (bloom[(b >> six).astype(np.int64)] >> (b & low)) & one) == one
