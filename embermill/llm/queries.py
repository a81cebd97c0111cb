"""The queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import load


def vocabulary(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store_digest

    return token_store_digest(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_digest

    return mixing_digest(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest

    return toxicity_digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import personal_digest

    return personal_digest(load(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import topk_digest

    return topk_digest(load(spark, sf_dir, "embeddings"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import passages_digest

    return passages_digest(load(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(load(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_digest

    return license_digest(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packing_digest

    return packing_digest(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_digest

    return jaccard_digest(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
