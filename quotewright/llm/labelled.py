"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(folds: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``folds`` (null id: null)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled documents, the least in a hash order of ids.

    An id with several labels has the greatest; an id with several texts is represented by the least
    (null counts as empty).  So the sample does not depend on how tables are partitioned.  The ids
    are broadcast to the documents: ``bound`` rows of two numbers.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of"))
    chosen = chosen.agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("of"), "of").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "of").groupBy("of", "label").agg(F.min("text").alias("text")).select("text", "label")
