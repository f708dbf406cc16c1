"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document's ids (with an end id) are one piece, or if longer than a sequence are cut into pieces of
full length, the first taking the rest.  Packing sees lengths only: pieces of equal
length stand for one another.  The counts by length (at most ``CAPACITY`` numbers, whatever the
input) are solved in levels: at a level of multiplicity ``m`` the unit problem holds ``count // m`` of
each length, and its packing stands ``m`` times.  The worst-filled bins, up to a quarter of ``UNIT``
pieces, go back to the next level, of half the multiplicity, down to 1; the others stay as they are,
full or not.  The next unit problem so has at most twice what went back and one piece more a length:
never over ``UNIT`` pieces, whatever the lengths.  The work grows with the logarithm of the input.

A unit problem is evolved on ``ISLANDS`` tasks.  An individual is a set of bins.  Crossover injects
the best-filled half of one parent's bins into another, removes the bins of the receiver that
hold a piece twice, and best-fits the displaced pieces; mutation empties a few bins, the worst
filled among them, and best-fits their pieces.  After each epoch an island's elites migrate to the
next island.  The fitness is Falkenauer's mean squared fill, which a packing in fewer bins raises.

Bins then become slots per length.  A piece finds its slot by its rank among the pieces of its
length, from counts by partition; no length is collected, sorted or shuffled as a group.

Null text is an empty document (its end id alone); a null id stays null.  Rows that repeat are packed
each; extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, tidy
from .tokens import CACHED, PieceEncoder, encoder

CAPACITY, UNIT, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 1024, 4096, 6, 6, 3, 8
PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, nth long"

Bin = list[int]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, cached: int = CACHED) -> DataFrame:
    """The pieces of every document, numbered per partition and length (``part``, ``nth``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer_path, cached) as enc:
            yield from encoded(batches, enc)

    def encoded(batches: Iterator[pa.RecordBatch], enc: PieceEncoder) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out: list[tuple] = []
                for doc, packed in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(packed + end, enc.dtype).astype("<u4")
                    lo, k = 0, 0
                    while lo < len(ids):
                        hi = lo + ((len(ids) - 1) % capacity + 1 if k == 0 else capacity)
                        out.append((part, doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), seen[hi - lo].item()))
                        seen[hi - lo] += 1
                        lo, k = hi, k + 1
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(rows), PIECES)


class BestFit:
    """Open bins by free room; the tightest that fits comes first."""

    def __init__(self, bins: list[Bin], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for i, b in enumerate(bins):
            self._open(i, capacity - sum(sizes[j] for j in b))

    def _open(self, i: int, free: int) -> None:
        self.room[free].append(i)
        self.mask |= 1 << free

    def add(self, items: list[int]) -> list[Bin]:
        """Put ``items`` in, largest first, into the tightest bins; new bins where none fits."""
        sizes = self.sizes
        for j in sorted(items, key=lambda j: (-sizes[j], j)):
            fits = self.mask >> sizes[j]
            if fits:
                free = (fits & -fits).bit_length() - 1 + sizes[j]
                i = self.room[free].pop()
                if not self.room[free]:
                    self.mask &= ~(1 << free)
                self.bins[i].append(j)
                self._open(i, free - sizes[j])
            else:
                self.bins.append([j])
                self._open(len(self.bins) - 1, self.capacity - sizes[j])
        return self.bins


def fitness(bins: list[Bin], sizes: list[int], capacity: int) -> float:
    return sum((sum(sizes[j] for j in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(giver: list[Bin], taker: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """``taker`` with the best-filled half of ``giver``'s bins injected."""
    fill = [sum(sizes[j] for j in b) for b in giver]
    order = sorted(range(len(giver)), key=lambda i: (-fill[i], i))
    half = max(1, len(order) // 2)
    chosen = rng.permutation(order[:half])[: max(1, int(half * rng.uniform(0.3, 1.0)))]
    injected = [list(giver[i]) for i in sorted(chosen.tolist())]
    inside = {j for b in injected for j in b}
    kept, displaced = [], []
    for b in taker:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [j for j in b if j not in inside]
    return BestFit(injected + kept, sizes, capacity).add(displaced)


def mutate(bins: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Empty the worst-filled bins and a few others, and best-fit their pieces in random order of size classes."""
    fill = np.array([sum(sizes[j] for j in b) for b in bins])
    out = set(np.argsort(fill, kind="stable")[: max(1, len(bins) // 50)].tolist()) | set(rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist())
    loose = [j for i in out for j in bins[i]]
    return BestFit([list(b) for i, b in enumerate(bins) if i not in out], sizes, capacity).add(loose)


def evolve(sizes: list[int], elites: list[list[Bin]], capacity: int, seed: int, generations: int) -> list[list[Bin]]:
    """One epoch of one island: its two best individuals, best first."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity)
    crowd = [[list(b) for b in e] for e in elites]
    crowd.append(BestFit([], sizes, capacity).add(list(range(len(sizes)))))
    while len(crowd) < POPULATION:
        crowd.append(mutate(mutate(crowd[-1], sizes, capacity, rng), sizes, capacity, rng))

    def rank(x: list[Bin]) -> tuple[int, float]:
        return len(x), -fitness(x, sizes, capacity)

    crowd.sort(key=rank)
    for _ in range(generations):
        if len(crowd[0]) <= bound:
            break
        i, j = rng.integers(0, len(crowd), 2).tolist()
        child = crossover(crowd[min(i, j)], crowd[int(rng.integers(0, len(crowd)))], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        crowd = sorted([*crowd, child], key=rank)[:POPULATION]
    return crowd[:2]


def solve_unit(spark: SparkSession, sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (as lists of lengths) of at most about ``UNIT`` pieces, evolved on islands."""
    if not sizes:
        return []
    elites: list[list[list[Bin]]] = [[] for _ in range(ISLANDS)]
    bound = -(-sum(sizes) // capacity)
    for epoch in range(EPOCHS):

        def island(batches: Iterator[pa.RecordBatch], epoch: int = epoch, elites: list = elites) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    for x in evolve(sizes, elites[i], capacity, 1000 * epoch + i, GENERATIONS):
                        owner = np.empty(len(sizes), np.int32)
                        for k, bin_ in enumerate(x):
                            owner[bin_] = k
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([owner.tobytes()], pa.binary())], names=["island", "owner"])

        got = spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(island, "island int, owner binary").collect()  # two vectors of UNIT numbers an island
        own: list[list[list[Bin]]] = [[] for _ in range(ISLANDS)]
        for r in got:
            owner = np.frombuffer(r.owner, np.int32)
            bins: list[Bin] = [[] for _ in range(int(owner.max()) + 1)]
            for j, k in enumerate(owner.tolist()):
                bins[k].append(j)
            own[r.island].append(bins)
        best = min((x for xs in own for x in xs), key=lambda x: (len(x), -fitness(x, sizes, capacity)))
        if len(best) <= bound:
            break
        elites = [own[i] + own[(i - 1) % ISLANDS][:1] for i in range(ISLANDS)]  # elites migrate around the ring
    return [[sizes[j] for j in b] for b in best]


def solve(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for all pieces."""
    left, out = Counter(counts), Counter()
    if full := left.pop(capacity, 0):
        out[(capacity,)] += full
    unit = max(UNIT, 2 * capacity)
    m = 1
    while sum(n // m for n in left.values()) > unit:
        m *= 2
    while m:
        sizes = [length for length, n in sorted(left.items()) for _ in range(n // m)]
        if len(sizes) > unit:
            raise AssertionError(f"{len(sizes)} pieces in a unit problem of {unit}")
        back = 0
        for b in sorted(solve_unit(spark, sizes, capacity), key=lambda b: (sum(b), b)):
            if m > 1 and sum(b) < capacity and back + len(b) <= unit // 4:
                back += len(b)
                continue
            out[tuple(sorted(b, reverse=True))] += m
            for length in b:
                left[length] -= m
        m //= 2
    return sorted(out.items())


def place(cut: DataFrame, solution: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece, from its rank among pieces of its length."""
    spark = cut.sparkSession
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> first rank, pattern's first sequence, copies, offset
    taken: Counter = Counter()
    first = 0
    for pattern, copies in solution:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], first, copies, offset))
            taken[length] += copies
            offset += length
        first += copies
    held = spark.sparkContext.broadcast({length: np.array(x, np.int64) for length, x in slots.items()})
    before = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(i).to_numpy()) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                table = held.value[size]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in PLACED.split(", ")])

    ranked = cut.join(before, ["length", "part"]).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(rows, PLACED)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, cached: int = CACHED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    ``cached`` words stay encoded in a worker: more take memory, fewer time; the result is the same.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, cached), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    return place(cut, solve(docs.sparkSession, counts, capacity), capacity)
