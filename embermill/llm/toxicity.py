"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word edges), so
misspellings and inflections of a word share most of its vector.  Words average
into windows of ``window`` words at every ``stride``, a softmax layer reads the
window (a shorter one is filled up with null words, so a few odd words alone
prove little, and a word repeated within it counts once), and a document scores as its worst window, over the whole text: a long
clean text does not dilute one toxic passage.  Fitting alternates: windows of
toxic documents are told apart by the model itself, so that after the first
pass only those that look toxic count as such.

Because the softmax is linear in the average, a fitted model is one number per
n-gram bucket.  That table is what reaches the executors (``buckets`` floats).

The fit uses at most ``fit_docs`` labelled documents of each class, none over
``fit_chars`` characters, the smallest by hash; a third of them is kept apart to
calibrate scores.  Every document is scored, whole.

Nulls: null and empty texts score as the calibrated bias alone; a null doc_id is
not held out.  Repeated rows score alike.  Labels for a missing or null doc_id
are ignored; without labels of both classes every score is 0.  An empty table
gives no rows; extra columns are ignored by the digest and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship


@dataclass(frozen=True)
class Toxic:
    fit_docs: int = 1200
    fit_chars: int = 30_000
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    window: int = 24
    stride: int = 6
    epochs: int = 5
    rate: float = 0.4
    seed: int = 3
    threshold: float = 0.7


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word index at each place, words of each text)."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def gram_buckets(words: pa.Array, cfg: Toxic) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram of all words, n-grams of each word), from the words' bytes between edge marks."""
    marked = pc.binary_join_element_wise("<", words.cast(pa.string()), ">", "")
    sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(marked.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes to the end of the word
    found, owner = [], []
    word = np.repeat(np.arange(len(sizes)), sizes)
    for n in cfg.grams:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        ok = left[: len(h)] >= n
        found.append((h[ok] % np.uint64(cfg.buckets)).astype(np.int64))
        owner.append(word[: len(h)][ok])
    if not found:
        return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
    bucket, at = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.bincount(at, minlength=len(sizes))


def word_scores(words: pa.Array, table: np.ndarray, cfg: Toxic) -> np.ndarray:
    """Each word's mean over its n-grams; words too short for one score 0."""
    bucket, n = gram_buckets(words, cfg)
    total = np.concatenate([[0.0], np.cumsum(table[bucket])])
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]) / np.maximum(n, 1)


def window_bounds(counts: np.ndarray, cfg: Toxic) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of all windows: each text's last one ends at its end; a short text is one window."""
    ends = np.cumsum(counts)
    starts = ends - counts
    many = np.maximum(0, -(-(counts - cfg.window) // cfg.stride)) + 1
    text = np.repeat(np.arange(len(counts)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    hi = np.minimum(starts[text] + k * cfg.stride + cfg.window, ends[text])
    lo = np.maximum(starts[text], hi - cfg.window)
    return lo, hi, text


def fresh(at: np.ndarray, counts: np.ndarray, cfg: Toxic) -> np.ndarray:
    """1 for each place whose word does not stand in the text's ``window`` places before it, else 0."""
    order = np.argsort(at, kind="stable")
    text = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(at), bool)
    a, b = order[:-1], order[1:]
    again[b] = (at[a] == at[b]) & (text[a] == text[b]) & (b - a < cfg.window)
    return (~again).astype(np.float32)


def worst_window(scores: np.ndarray, at: np.ndarray, counts: np.ndarray, bias: float, cfg: Toxic) -> np.ndarray:
    """Each text's largest window logit."""
    total = np.concatenate([[0.0], np.cumsum(scores[at] * fresh(at, counts, cfg))])
    lo, hi, text = window_bounds(counts, cfg)
    logits = (total[hi] - total[lo]) / cfg.window
    first = np.flatnonzero(np.diff(text, prepend=-1))
    return np.maximum.reduceat(logits, first) + bias if len(text) else np.empty(0)


def fit(texts: list[str], labels: np.ndarray, cfg: Toxic) -> tuple[np.ndarray, float]:
    """(per-bucket logit table, bias): embeddings and softmax trained together by mini-batch AdaGrad."""
    rng = np.random.default_rng(cfg.seed)
    words, at, counts = words_of(pa.array(texts, pa.string()))
    bucket, n_grams = gram_buckets(words, cfg)
    gram_end = np.cumsum(n_grams)
    lo, hi, text = window_bounds(counts, cfg)
    once = fresh(at, counts, cfg)
    full = hi > lo
    lo, hi, text = lo[full], hi[full], text[full]
    emb = rng.normal(0, 1 / cfg.dim, (cfg.buckets, cfg.dim)).astype(np.float32)
    out = np.zeros((cfg.dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(emb.shape, 1e-6, np.float32), np.full(out.shape, 1e-6), np.full(2, 1e-6)
    y = labels[text].astype(int)
    use = np.arange(len(text))
    for epoch in range(cfg.epochs):
        if epoch:  # toxic documents: their windows that look toxic, and the worst one in any case
            table = emb @ (out[:, 1] - out[:, 0])
            total = np.concatenate([[0.0], np.cumsum(word_scores(words, table, cfg)[at] * once)])
            logit = (total[hi] - total[lo]) / cfg.window + float(bias[1] - bias[0])
            top = np.full(len(counts), -np.inf)
            np.maximum.at(top, text, logit)
            use = np.flatnonzero((y == 0) | (logit >= top[text]) | (logit > 0.5))
        # Clean windows are many: each epoch takes as many as four for each toxic one.
        pos, neg = use[y[use] == 1], use[y[use] == 0]
        if len(neg) > 4 * len(pos):
            neg = rng.choice(neg, 4 * max(1, len(pos)), replace=False)
        order = rng.permutation(np.concatenate([pos, neg]))
        for b in range(0, len(order), 256):
            w = order[b : b + 256]
            size = hi[w] - lo[w]
            row = np.repeat(np.arange(len(w)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[w][row]
            word = at[place]
            own, inverse = np.unique(word, return_inverse=True)
            k = n_grams[own]
            gram_of = np.repeat(np.arange(len(own)), k)
            grams = bucket[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + (gram_end[own] - k)[gram_of]]
            if not len(grams):
                continue
            vec = np.zeros((len(own), cfg.dim), np.float32)
            has = k > 0
            vec[has] = np.add.reduceat(emb[grams], (np.cumsum(k) - k)[has], axis=0) / k[has, None]
            first = np.cumsum(size) - size
            hidden = np.add.reduceat(vec[inverse] * once[place][:, None], first, axis=0) / cfg.window
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(w)), y[w]] -= 1
            p /= len(w)
            d_out, d_bias = hidden.T @ p, p.sum(0)
            d_window = (p @ out.T) / cfg.window
            by_word = np.argsort(inverse, kind="stable")
            d_word = np.add.reduceat(d_window[row[by_word]] * once[place][by_word][:, None], np.searchsorted(inverse[by_word], np.arange(len(own))), axis=0)
            d_word /= np.maximum(k, 1)[:, None]
            g_out += d_out**2
            g_bias += d_bias**2
            d_gram = d_word[gram_of].astype(np.float32)
            by_slot = np.argsort(grams, kind="stable")
            slot, begin = np.unique(grams[by_slot], return_index=True)
            d_emb = np.add.reduceat(d_gram[by_slot], begin, axis=0)
            g_emb[slot] += d_emb**2
            emb[slot] -= cfg.rate * d_emb / np.sqrt(g_emb[slot])
            out -= (cfg.rate * d_out / np.sqrt(g_out)).astype(np.float32)
            bias -= (cfg.rate * d_bias / np.sqrt(g_bias)).astype(np.float32)
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through held-apart logits, by Newton steps on scaled values."""
    mean, sd = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - mean) / sd, np.ones(len(z))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return float(max(w[0], 1e-6) / sd), float(w[1] - max(w[0], 1e-6) * mean / sd)


def train(docs: DataFrame, labels: DataFrame, cfg: Toxic = Toxic()) -> tuple[np.ndarray, float, float, float] | None:
    """(table, bias, slope, intercept) from the labelled documents that are not held out."""
    key = F.col("doc_id").cast("string")
    rows = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(key) % 3 != 1)).select("doc_id", "toxic").distinct()
    order = F.xxhash64(F.lit(cfg.seed), "doc_id")
    chosen = rows.where("toxic = 1").orderBy(order, "doc_id").limit(cfg.fit_docs).unionByName(
        rows.where("toxic = 0").orderBy(order, "doc_id").limit(cfg.fit_docs)
    )
    # At most 2 * fit_docs ids.
    found = (
        docs.where(F.length("text") <= cfg.fit_chars)
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(order, "doc_id", "text")
        .limit(2 * cfg.fit_docs)
        .select("text", "toxic")
        .collect()
    )
    y = np.array([r["toxic"] for r in found], int)
    if not len(y) or y.min() == y.max():
        return None
    apart = np.arange(len(y)) % 3 == 0
    texts = [r["text"] for r in found]
    table, bias = fit([t for t, a in zip(texts, apart) if not a], y[~apart], cfg)
    words, at, counts = words_of(pa.array([t for t, a in zip(texts, apart) if a], pa.string()))
    z = worst_window(word_scores(words, table, cfg), at, counts, bias, cfg)
    return table, bias, *platt(z, y[apart])


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float, float] | None, cfg: Toxic = Toxic()) -> DataFrame:
    """``docs`` with a score column, from the whole text."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = [f for f in docs.schema.fields if f.name.lower() != "score"]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from embermill.llm.encoding import _give_back, forget_encoders
        from embermill.llm.toxicity import word_scores, words_of, worst_window

        forget_encoders()
        table, bias, slope, intercept = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = int(sizes[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, done + 2_500_000)))
                words, at, counts = words_of(texts.slice(start, end - start))
                z = worst_window(word_scores(words, table, cfg), at, counts, bias, cfg)
                p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -30, 30)))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(p)], names=[*names, "score"])
                start = end
            _give_back()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.select(*names).mapInArrow(run, StructType([*schema, StructField("score", DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame, cfg: Toxic = Toxic()) -> DataFrame:
    own = docs.select("doc_id", "text")
    out = scored(own, train(own, labels, cfg), cfg)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, cfg: Toxic = Toxic()) -> DataFrame:
    """``docs`` without those that score as toxic; columns are kept."""
    names = docs.columns
    own = docs.withColumnRenamed("score", "own_score")
    kept = scored(own, train(docs, labels, cfg), cfg).where(F.col("score") < cfg.threshold).drop("score")
    return kept.withColumnRenamed("own_score", "score").select(names)
