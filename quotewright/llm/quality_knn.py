"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of word shapes, pairs of shapes, hashed words and repetitions (whole text,
nothing else); log counts times inverse document frequency project on the leading singular
vectors of a labelled sample of at most ``SAMPLE`` documents.  The labelled vectors (``SAMPLE`` x
``RANK`` floats, about 2 MB) are broadcast.  Every document takes its exact cosine with each of
them, in blocks of rows, and its ``NEIGHBOURS`` nearest vote with a power of their similarity.

Null, empty or blank text has no direction and gets the share of label 1 in the sample.  Without
labelled rows every score is 0.5.  An id with several labels counts with the greatest, one with
several texts with the least.  Among neighbours of equal similarity any may vote (they lie at one
distance).  Repeated rows score alike; a null id scores like any other; extra columns, whatever their
names, are ignored by ``score`` and kept by ``accepted``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .labelled import sample

SAMPLE, RANK, NEIGHBOURS, POWER, BLOCK = 8192, 48, 25, 8, 128
#: Feature ranges: word shapes, pairs of shapes, hashed words, repetition counts.
SHAPES, PAIRS, WORDS, REPEATS = 512, 512, 512, 4
WIDTH = SHAPES + PAIRS + WORDS + REPEATS
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Kinds of characters of the whole word in order, runs as one: ``Ab-12!!`` is ``Aa-9!``."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", kinds)


class ShapedWords(dict):
    """word -> 52 bits of its hash and the number of its shape; bounded."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        value = self[word] = (h & ~0xFFF) | (xxhash.xxh3_64_intdigest(shape(word)) % SHAPES)
        return value


def counts(text: str | None, words: ShapedWords) -> np.ndarray:
    """Feature counts of one text."""
    out = np.zeros(WIDTH, np.float32)
    parts = (text or "").split()
    if not parts:
        return out
    v = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    s, h = (v & np.uint64(0xFFF)).astype(np.int64), v >> np.uint64(12)
    out[:SHAPES] = np.bincount(s, minlength=SHAPES)
    if len(s) > 1:
        out[SHAPES : SHAPES + PAIRS] = np.bincount((s[:-1] * 1_000_003 + s[1:] * 8191) % PAIRS, minlength=PAIRS)
    out[SHAPES + PAIRS : SHAPES + PAIRS + WORDS] = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    grams = np.sort(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]) if len(h) > 2 else h[:0]
    lines = [x for x in text.split("\n") if x]
    out[-REPEATS:] = ((h[1:] == h[:-1]).sum(), (grams[1:] == grams[:-1]).sum(), len(lines) - len(set(lines)), len(lines))
    return out


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors; shapes and repetitions weigh three times as much as words."""
    x = np.log1p(rows) * idf
    x[:, : SHAPES + PAIRS] *= 3
    x[:, -REPEATS:] *= 3
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Neighbours:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Vote of each row's nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        prior = float(self.labels.mean())
        out = np.full(len(rows), prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(rows), BLOCK):
            cosine = _unit(weigh(rows[at : at + BLOCK], self.idf) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            some = (total > 0) & (rows[at : at + BLOCK].sum(1) > 0)
            votes = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK][some] = votes[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Neighbours:
    """Singular vectors and labelled vectors of a sample of at most ``bound`` documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ShapedWords()
        for b in batches:
            packed = [counts(t.as_py(), words).astype(np.uint32).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1)], names=["counts", "label"])

    got = sample(docs, labels, "quality", bound).mapInArrow(tidy(rows), "counts binary, label int").toArrow()  # bound rows of WIDTH counts
    y = np.array(got.column("label").to_pylist(), np.float64)
    if not len(y):
        return Neighbours(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    order = np.argsort([xxhash.xxh3_64_intdigest(c.as_py()) for c in got.column("counts")], kind="stable")
    x = np.frombuffer(b"".join(c.as_py() for c in got.column("counts")), np.uint32).reshape(len(y), WIDTH)[order].astype(np.float32)
    y = y[order]
    idf = np.log1p(len(x) / (1 + (x > 0).sum(0))).astype(np.float32)
    x = weigh(x, idf)
    rank = min(RANK, *x.shape)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(1).standard_normal((WIDTH, rank + 16)).astype(np.float32)))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ v.T[:, :rank]).astype(np.float32)
    return Neighbours(idf, axes, _unit(x @ axes), y)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ShapedWords()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = np.stack([counts(t.as_py(), words) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(rows), "doc_id long, score double")


def accepted(docs: DataFrame, model: Neighbours, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ShapedWords()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = np.stack([counts(t.as_py(), words) for t in b.column(place)])
                yield b.filter(pa.array(held.value.score(x) >= least))

    return docs.mapInArrow(tidy(rows), docs.schema)
