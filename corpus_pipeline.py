"""The training-data pipeline over ``documents``: classify, deduplicate twice, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotewright.llm import mixing, near_dedup, packing, quality_knn, substring_dedup
from quotewright.llm.common import discard, materialise, table
from quotewright.llm.labelled import remainder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    return quality_knn.accepted(docs, quality_knn.fit(docs, labels))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each near-duplicate group (similarity 0.8 or more)."""
    return near_dedup.without_near_duplicates(docs, (80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier; emptied ones go."""
    return substring_dedup.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's quota of the same number of tokens asks."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 1024 tokens."""
    import public_tokenizers

    # the stages share their workers, so the encoder keeps less than where it runs alone
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=60_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learned vectors, sketches and a genetic search have no SQL form; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, the former ones then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return docs
