"""The corpus pipeline: documents without toxic ones and near copies, cleaned of personal data, mixed and packed.

Each stage is a function of (spark, docs, sf_dir) that calls one operator on all
rows that its predecessor kept; all but the last give the columns of documents.

In every stage: nulls in any column are allowed; a null or empty text is a
document without words; rows that repeat are documents each (but for the join,
where they are copies of one another); an empty table gives an empty table; an
input's further columns are dropped, whatever their names.  Ties are settled by
hashes of doc_id and text, never by the order rows come in, so reruns agree.

Stages share their executors, whose heaps are full after the first ones, so Python
workers and Arrow are held to what is left beside them: batches of ``BATCH_BYTES``
for the session, and encoders of ``CACHE_BYTES`` that go with their task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embermill.llm import jaccard, mixing, packing, personal, shared, toxicity
from embermill.llm.queries import vocabulary

BATCH_BYTES = 2 << 20
CACHE_BYTES = 60_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; those without text, without an id or without a label stay if they score below it.

    Without labels to learn from, nothing is rejected.
    """
    shared.bound_batches(spark, BATCH_BYTES)
    return toxicity.keep_clean(docs.select(COLUMNS), shared.load(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more.

    It is that of the smallest doc_id, a null one last. Documents without words are in no group and stay, once
    for each doc_id and text.
    """
    shared.bound_batches(spark, BATCH_BYTES)
    return jaccard.keep_first(docs.select(COLUMNS), jaccard.Join(n=5, percent=80)).select(COLUMNS)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, n_chars follows; a null text stays null, no row goes."""
    return _counted(personal.redact(docs.select(COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the order of its shards; a cut copy ends at its last word.

    Sources are as they come, null one of them; documents without words are taken as often as their block is.
    """
    return _counted(mixing.mix_documents(docs.select(COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; a document without text is its end id, copies are packed each on their own."""
    shared.bound_batches(spark, BATCH_BYTES)
    return packing.packing_digest(docs.select(COLUMNS), vocabulary("byte_bpe_50k.json"), end_id=1, cache_bytes=CACHE_BYTES)


def _counted(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained scores, vocabularies and seeded draws have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
