"""Toxicity by a logistic model that is regularised with counterfactual identity terms.

Features are the distinct words of a text (lower case, without edge punctuation) and their first
four to nine letters.  The features that tell the labels apart best on a labelled sample of at
most ``SAMPLE`` documents enter a logistic regression, and all features of the identity terms do.

Counterfactuals: in each sampled document that names a group, every group term is replaced by another
term of its language and number (or by the neutral one), ``SWAPS`` times; all features of the changed
text are taken again, prefixes of the swapped words included, and the squared change of the text's
log-odds is part of the loss.  So neither a group's name nor its spelling can raise a score.

Null, empty or blank text scores as a text without features.  Without labelled rows every score
is 0.  An id with several labels counts with the greatest, one with several texts with the least.
Repeated rows score alike; a null id scores like any other; extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy
from .labelled import sample

SAMPLE, FEATURES, LEAST_DOCS, SWAPS = 32_768, 3000, 3, 4
RIDGE, COUNTERFACTUAL, STEPS, RATE, LEAST_Z = 1e-5, 20.0, 600, 0.5, 4.0

# Group terms that may stand for one another in a sentence, plural and singular by
# language; the first of each list is the neutral one.
IDENTITY = {
    "en plural": "people women men girls boys christians muslims jews hindus buddhists atheists gays lesbians immigrants foreigners natives blacks whites asians latinos arabs africans europeans".split(),
    "en singular": "person woman man girl boy christian muslim jew hindu buddhist atheist gay lesbian immigrant foreigner native black white asian latino arab african european".split(),
    "de plural": "menschen frauen männer mädchen jungen christen muslime juden hindus buddhisten atheisten schwule lesben einwanderer ausländer schwarze weiße asiaten araber afrikaner europäer".split(),
    "de singular": "mensch frau mann junge christ muslim jude hindu buddhist atheist schwuler lesbe schwarzer weißer asiat".split(),
    "fr plural": "gens femmes hommes filles garçons chrétiens musulmans juifs hindous bouddhistes athées gays lesbiennes immigrés étrangers noirs blancs asiatiques arabes africains européens".split(),
    "fr singular": "personne femme homme fille garçon chrétien musulman juif hindou bouddhiste athée lesbienne immigré étranger noir blanc asiatique arabe africain européen".split(),
    "es plural": "personas mujeres hombres niñas niños cristianos musulmanes judíos hindúes budistas ateos lesbianas inmigrantes extranjeros negros blancos asiáticos árabes africanos europeos".split(),
    "es singular": "persona mujer hombre niña niño cristiano musulmán judío budista ateo lesbiana inmigrante extranjero negro blanco asiático árabe africano europeo".split(),
}
#: term -> the lists it stands in (``gays`` is English and French)
LISTS: dict[str, list[list[str]]] = {}
for _terms in IDENTITY.values():
    for _term in _terms:
        LISTS.setdefault(_term, []).append(_terms)
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„¡¿…–—"


def features(word: str) -> tuple[str, ...]:
    w = word.strip(EDGE).lower()
    if not w:
        return ()
    return (w, *(f"{w[:n]}*" for n in range(4, 10) if len(w) >= n))


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


def features_of(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in features(w)}


def swapped(words: set[str], turn: int) -> set[str] | None:
    """``words`` (lower case, bare) with every group term replaced by another, other ones each ``turn``; None without terms."""
    terms = sorted(w for w in words if w in LISTS and any(w != terms[0] for terms in LISTS[w]))
    if not terms:
        return None
    out = words.difference(terms)
    for t in terms:
        pick = xxhash.xxh3_64_intdigest(f"{t} {len(words)}", seed=turn)
        others = [x for x in LISTS[t][pick % len(LISTS[t])] if x != t]
        out.add(others[0] if turn == 0 else others[pick // 7 % len(others)])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, texts: Iterable[str | None], known: dict[str, tuple[str, ...]] | None = None) -> list[float]:
        """Scores; ``known`` is a cache of words' features, emptied when it grows over 100,000."""
        known = {} if known is None else known
        out = []
        for text in texts:
            words = set((text or "").split())
            for w in words.difference(known):
                known[w] = tuple(f for f in features(w) if f in self.weights)
            z = self.bias + sum(self.weights[f] for f in sorted({f for w in words for f in known[w]}))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            if len(known) > 100_000:
                known.clear()
        return out


def _chosen(sampled: DataFrame, most: int) -> list[str]:
    """The features that tell the labels apart best, at most ``most``, by their z-score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                found, label = [], []
                for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    own = features_of(set((text.as_py() or "").split()))
                    found += own
                    label += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], names=["feature", "label"])

    n = sampled.agg(F.sum("label"), F.count("*")).first()
    pos, total = (n[0] or 0) + 1.0, n[1] + 2.0
    rate = pos / total
    seen = sampled.mapInArrow(tidy(rows), "feature string, label int").groupBy("feature").agg(F.sum("label").alias("p"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    z = (F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1.0)
    return [r.feature for r in seen.where(F.abs(z) >= LEAST_Z).orderBy(F.abs(z).desc(), "feature").limit(most).collect()]


def _sparse(rows: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a list of column lists."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((i for r in rows for i in r), np.int64)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Model:
    sampled = materialise(sample(docs, labels, "toxic", bound), "toxic-sample")
    names = sorted({*_chosen(sampled, FEATURES), *features_of(LISTS)})
    number = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, plus, minus = [], [], []
            for t in b.column(0):
                words = {bare(w) for w in set((t.as_py() or "").split())}
                was = features_of(words)
                own.append(sorted(number[f] for f in was if f in number))
                now = [features_of(x) for x in (swapped(words, turn) for turn in range(SWAPS)) if x is not None]
                plus.append([sorted(number[f] for f in x - was if f in number) for x in now])
                minus.append([sorted(number[f] for f in was - x if f in number) for x in now])
            ids, lists = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(own, ids), b.column(1), pa.array(plus, lists), pa.array(minus, lists)], names=["own", "label", "plus", "minus"])

    schema = "own array<int>, label int, plus array<array<int>>, minus array<array<int>>"
    # at most bound rows of numbers; sorted, so that the sums do not depend on partitions
    got = sorted((tuple(r.own), r.label, tuple(map(tuple, r.plus)), tuple(map(tuple, r.minus))) for r in sampled.mapInArrow(tidy(rows), schema).collect())
    if not got:
        return Model({}, -30.0)
    y = np.array([g[1] for g in got], np.float32)
    row, flat = _sparse([g[0] for g in got])
    in_row, in_ = _sparse([x for g in got for x in g[2]])
    out_row, out_ = _sparse([x for g in got for x in g[3]])
    swaps = sum(len(g[2]) for g in got)
    w, b = np.zeros(len(names), np.float64), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    balance = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))
    step_w, step_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row, weights=w[flat], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.bincount(flat, weights=g[row], minlength=len(names)) + RIDGE * w
        if swaps:
            d = np.bincount(in_row, weights=w[in_], minlength=swaps) - np.bincount(out_row, weights=w[out_], minlength=swaps)
            d *= counterfactual / swaps
            grad += np.bincount(in_, weights=d[in_row], minlength=len(names)) - np.bincount(out_, weights=d[out_row], minlength=len(names))
        step_w += grad**2
        step_b += g.sum() ** 2
        w -= RATE * grad / np.sqrt(step_w)
        b -= RATE * g.sum() / np.sqrt(step_b)
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score((t.as_py() for t in b.column(1)), known), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(rows), "doc_id long, score double")
