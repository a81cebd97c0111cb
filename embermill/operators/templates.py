"""Message templates: masking by expression (L1) and the order-dependent cluster fold (L2)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<*>"
MAX_TOKENS, MAX_TOKEN_BYTES, THRESHOLD = 64, 48, 0.5


def tokenize(message: Column) -> Column:
    words = F.filter(F.split(message, "[ \t]+"), lambda t: t != "")
    return F.slice(words, 1, MAX_TOKENS)


def mask(tokens: Column) -> Column:
    """Tokens with a digit, and quoted ones, become wildcards; others are cut to 48 bytes."""

    def one(t: Column) -> Column:
        quoted = (F.length(t) >= 2) & F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))
        return F.when(t.rlike("[0-9]") | quoted, F.lit(WILDCARD)).otherwise(F.left(t, F.lit(MAX_TOKEN_BYTES)))

    return F.transform(tokens, one)


def template(message: Column) -> Column:
    return F.array_join(mask(tokenize(message)), " ")


def similarity(a: Column, b: Column) -> Column:
    """Share of places that are equal or where either side is a wildcard, for templates of one length."""
    same = F.zip_with(a, b, lambda x, y: (x == y) | (x == WILDCARD) | (y == WILDCARD))
    return F.when(
        (F.size(a) == F.size(b)) & (F.size(a) > 0), F.size(F.filter(same, lambda s: s)) / F.size(a)
    ).otherwise(F.lit(0.0))


# The 64-bit FNV-1a offset, and its prime as 2**40 + 435.
_OFFSET_HIGH, _OFFSET_LOW, _PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_HALF = 0xFFFFFFFF


def template_hash(text: Column) -> Column:
    """FNV-1a of every token with a space behind it, as DECIMAL(20,0); 0 for no tokens.

    The state is two 32-bit halves in BIGINTs, so no step can overflow.
    """
    data = F.transform(
        F.regexp_extract_all(F.hex(F.encode(F.concat(text, F.lit(" ")), "utf-8")), F.lit("(..)"), F.lit(1)),
        lambda h: F.conv(h, 16, 10).cast("bigint"),
    )
    start = F.struct(F.lit(_OFFSET_HIGH).cast("bigint").alias("hi"), F.lit(_OFFSET_LOW).cast("bigint").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        low = acc["lo"].bitwiseXOR(byte)
        product = low * _PRIME_LOW
        high = acc["hi"] * _PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("hi"), product.bitwiseAND(F.lit(_HALF)).alias("lo"))

    whole = F.aggregate(
        data,
        start,
        step,
        lambda acc: (acc["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + acc["lo"].cast("decimal(20,0)")).cast("decimal(20,0)"),
    )
    return F.when(F.trim(text) == "", F.lit(0).cast("decimal(20,0)")).otherwise(whole)


def _fold_batches(batches: Iterator, threshold: float, final: bool):
    """Fold one token count's messages, in order, into clusters: the scalar definition."""
    clusters: list[list] = []  # [tokens, first seq]
    emitted = []
    exact: dict[tuple, int] = {}
    for seq, tokens in batches:
        key = tuple(tokens)
        best, best_same = -1, -1
        # A cluster equal to the tokens matches in full; an earlier full match still goes first.
        limit = exact.get(key, len(clusters) - 1)
        for i in range(limit + 1):
            own = clusters[i]
            same = sum(x == y or x == WILDCARD or y == WILDCARD for x, y in zip(own, tokens))
            if same > best_same and same >= threshold * len(tokens):
                best, best_same = i, same
                if same == len(tokens):
                    break
        if best < 0:
            clusters.append(list(tokens))
            exact[key] = len(clusters) - 1
            best = len(clusters) - 1
        else:
            old = tuple(clusters[best])
            merged = [x if x == y else WILDCARD for x, y in zip(old, tokens)]
            if tuple(merged) != old:
                if exact.get(old) == best:
                    del exact[old]
                clusters[best] = merged
                exact.setdefault(tuple(merged), best)
        emitted.append((seq, best, " ".join(clusters[best])))
    return [(seq, " ".join(clusters[i]) if final else text) for seq, i, text in emitted]


def drain_templates(
    events: DataFrame, message: str = "message", seq: str = "seq", threshold: float = THRESHOLD, hash_mode: str = "final"
) -> DataFrame:
    """(seq, template, template_hash): clusters by similarity, folded in order of ``seq``.

    Clusters only compete within a token count, so that is an exact partition
    key. ``hash_mode``: ``final`` gives all members the last template of their
    cluster, ``as_emitted`` the one at the time of the message.
    """
    if hash_mode not in ("final", "as_emitted"):
        raise ValueError(hash_mode)
    final = hash_mode == "final"
    rows = events.select(F.col(seq).cast("bigint").alias("seq"), mask(tokenize(F.col(message))).alias("tokens"))
    rows = rows.withColumn("n", F.size("tokens"))

    def fold(pdf):
        import pandas as pd

        if not len(pdf):
            return pd.DataFrame({"seq": [], "template": []})
        pdf = pdf.sort_values("seq", kind="stable")
        if pdf["n"].iloc[0] == 0:
            return pd.DataFrame({"seq": pdf["seq"], "template": ""})
        out = _fold_batches(zip(pdf["seq"].tolist(), [list(t) for t in pdf["tokens"]]), threshold, final)
        return pd.DataFrame(out, columns=["seq", "template"])

    folded = rows.groupBy("n").applyInPandas(fold, "seq bigint, template string")
    # Hashes are of distinct templates, then joined back.
    names = folded.select("template").distinct().withColumn("template_hash", template_hash(F.col("template")))
    return folded.join(names, "template").select("seq", "template", "template_hash")
