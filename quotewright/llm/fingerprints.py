"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines, long ones cut at sentence ends; blank ones
do not count).  Each paragraph hashes to a wide vector and the fingerprint is the sum of the
vectors, every lane modulo a power of two.  Sums commute, so paragraph order does not matter,
and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has a count, 8 dense lanes modulo 2**64 that settle equality, and 21 strata of 64 sparse
lanes modulo 2**16: a paragraph adds an odd value to one lane of one stratum (stratum s takes one
in 2**(s+1), the last the rest).  In the difference of two fingerprints the lanes that are not
zero count the paragraphs that differ, which gives the likeness.  The thinnest strata stay readable
up to 10**8 differing paragraphs.  Strata after the last one in use are not written.

Null text is an empty one; empty texts have the all-zero fingerprint and likeness 1 to each other.
Rows are neighbours in ascending ``doc_id`` (null first, ties by text) and keep one row each, repeated
rows too; a single row follows itself.  Extra columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches, shuffle_partitions, tidy
from .wordhash import finish

DENSE, STRATA, LANES = 8, 21, 64
_SEEDS = np.arange(1, DENSE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip() for x in text.replace(". ", ".\n").split("\n")) if p]


class Fingerprint:
    """A sum of paragraph vectors; ``+`` and ``-`` are those of multisets."""

    __slots__ = ("count", "dense", "sparse")

    def __init__(self, count: int = 0, dense: np.ndarray | None = None, sparse: np.ndarray | None = None):
        self.count = count
        self.dense = np.zeros(DENSE, np.uint64) if dense is None else dense
        self.sparse = np.zeros(STRATA * LANES, np.uint16) if sparse is None else sparse

    @classmethod
    def of(cls, parts: Iterable[str]) -> Fingerprint:
        h = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)
        if not len(h):
            return cls()
        dense = finish(h[:, None] ^ _SEEDS[None, :]).sum(0, dtype=np.uint64)
        stop = h | np.uint64(1 << STRATA - 1)
        stratum = np.log2((stop & ~(stop - np.uint64(1))).astype(np.float64)).astype(np.int64)  # trailing zero bits
        lane = stratum * LANES + ((h >> np.uint64(24)) % np.uint64(LANES)).astype(np.int64)
        sparse = np.bincount(lane, weights=((h >> np.uint64(32)) & np.uint64(0xFFFF) | np.uint64(1)).astype(np.float64), minlength=STRATA * LANES)
        return cls(len(h), dense, (sparse.astype(np.int64) & 0xFFFF).astype(np.uint16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.count + other.count, self.dense + other.dense, self.sparse + other.sparse)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.count - other.count, self.dense - other.dense, self.sparse - other.sparse)

    def hex(self) -> str:
        used = np.flatnonzero(self.sparse.reshape(STRATA, LANES).any(1))
        sparse = self.sparse[: (used[-1] + 1) * LANES] if len(used) else self.sparse[:0]
        return f"{self.count & (1 << 64) - 1:016x}{self.dense.astype('>u8').tobytes().hex()}{sparse.astype('>u2').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        count = int.from_bytes(raw[:8], "big", signed=True)
        sparse = np.frombuffer(raw[8 + 8 * DENSE :], ">u2").astype(np.uint16)
        return cls(count, np.frombuffer(raw[8 : 8 + 8 * DENSE], ">u8").astype(np.uint64), np.pad(sparse, (0, STRATA * LANES - len(sparse))))

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: one minus the estimated share of paragraphs that the two do not share."""
        if self.count == other.count and np.array_equal(self.dense, other.dense):
            return 1.0
        differ = np.count_nonzero((self.sparse - other.sparse).reshape(STRATA, LANES), axis=1).tolist()
        share, total = [2.0 ** -(s + 1) for s in range(STRATA - 1)] + [2.0 ** -(STRATA - 1)], self.count + other.count
        found = weight = 0.0
        for z, p in zip(differ, share, strict=True):
            if z <= 0.9 * LANES:
                found, weight = found - LANES * math.log(1 - z / LANES), weight + p
        apart = found / weight if weight else float(total)
        return min(1.0, max(0.0, 1 - max(apart, 1.0) / total))


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint.of(paragraphs(text or ""))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (part, is_following, doc_id, text), to be read in that order inside a partition.

    ``doc_id`` ranges are dealt out whole; the first document of each range follows the range
    before it once more with ``is_following`` 1, so no range has to look into another.  One
    shuffle of the texts.  The bounds and firsts on the driver are one value a partition.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] or []))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = sorted((r.part, r.first) for r in rows.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).collect())
    if not firsts:
        return rows.select("part", F.lit(0).alias("is_following"), "doc_id", "text")
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "head long, before int"))  # a row a partition
    follow = rows.join(heads, F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head")).groupBy("before").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    both = rows.select("part", F.lit(0).alias("is_following"), "doc_id", "text").unionByName(
        follow.select(F.col("before").alias("part"), F.lit(1).alias("is_following"), "d.doc_id", "d.text")
    )
    return both.repartitionById(n, "part").sortWithinPartitions("part", "is_following", "doc_id", "text")


COLUMNS = (
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document (the last: the first)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for batch in batches:
            for part, following, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                print_ = fingerprint(text)
                if last and last[0] == part:
                    _, doc0, text0, print0 = last
                    changed = edited(text0, text)
                    changed_print = fingerprint(changed)
                    yield doc0, len(text0), hashlib.sha256(changed.encode()).hexdigest(), print0.hex(), changed_print.hex(), print0.likeness(changed_print), print0.likeness(print_)
                last = None if following else (part, doc, text, print_)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInArrow(tidy(lambda batches: record_batches(COLUMNS, rows(batches), 1024)), schema)
