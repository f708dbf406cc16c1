"""Near-duplicate documents by a MinHash LSH forest, with links confirmed on full shingle sets.

A document's set is its distinct five-word shingles over ASCII-lower-cased words (fewer words:
the whole sequence; none: the empty set, linked with nothing).  Documents of equal sets collapse to one
node first.  Each of the forest's sorted orders takes ``DEPTH`` MinHash values of a node; the
nodes that share the first ``BASE`` values of an order are a region.  Depth adapts to the region: one of
at most ``LEAF`` members is a leaf and gives all its pairs; a larger one gives links to its least
member and to neighbours by longest common prefix, and is split one value deeper, down to ``DEPTH``.

What a split may separate is made good exactly: regions over ``LEAF`` that still hold several
components compare, in blocks and on whole sets, every member outside the largest component with
all members of other components.  So every pair that shares a base region in some order is compared.
The number of orders follows from the threshold: a pair just there shares none with probability
below 1e-5.

Candidates are screened on 4-bit MinHash sketches (a pair at the threshold fails six standard
deviations out, about 1e-9) and confirmed on whole sets.  Pairs inside one component are not confirmed
again, since they cannot change the result.  Joins deal keys with many rows over salts.

Null text is an empty one.  Each row is judged by its own text, so different texts of one id may
differ in their component; rows that repeat an id and text share one fate.  A component is named by its
least id; a null id names it only where there is no other.  Extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, hot_keys, likely, salted_join, unlikely
from .common import discard, materialise, text_tag, tidy
from .components import components
from .wordhash import MIX, Chunk, chunks, finish, sequence_hashes

SHINGLE = 5
DEPTH, BASE, LEAF, DEALT, BLOCK = 8, 4, 32, 512, 512
#: Most probability that a pair at the threshold shares no region; deviations by which it passes the screen.
MISS, DEVIATIONS = 1e-5, 6.0


@dataclass(frozen=True)
class Forest:
    """Sizes that follow from a threshold: link where whole * intersection >= part * union."""

    part: int
    whole: int

    @property
    def trees(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.part / self.whole) ** BASE))

    @property
    def screen(self) -> int:
        """Least number of equal 4-bit sketch values, of trees * DEPTH."""
        n, p = self.trees * DEPTH, 1 / 16 + 15 / 16 * self.part / self.whole
        return math.floor(n * p - DEVIATIONS * math.sqrt(n * p * (1 - p)))


def shingle_sets_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first of each text and the end): the sorted distinct shingles of a chunk's texts."""
    places = c.valid(SHINGLE)
    h, of = sequence_hashes(c.hashes, SHINGLE)[places] if len(places) else c.hashes[:0], c.text[places]
    words = np.diff(c.first)
    few = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(few):
        whole = words[few].astype(np.uint64)
        for k in range(SHINGLE - 1):
            more = words[few] > k
            whole[more] = whole[more] * MIX + c.hashes[c.first[few[more]] + k]
        h, of = np.concatenate((h, finish(whole))), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    edges = np.searchsorted(of, np.arange(len(words) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate(([0], np.cumsum(new)))[edges]


def _permutations(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    k = trees * DEPTH
    return rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32), rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32) | np.uint32(1)


def minhash(shingles: np.ndarray, first: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minima, one a permutation, of each set (rows); sets are not empty and lie side by side."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(flips), len(first)), np.uint32)
    for k in range(len(flips)):
        np.minimum.reduceat((h ^ flips[k]) * factors[k], first, out=out[k])
    return np.ascontiguousarray(out.T)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The 4-bit sketches of signatures (rows), two values a byte."""
    low = (signatures >> np.uint32(7)).astype(np.uint8) & 15
    return low[:, ::2] << 4 | low[:, 1::2]


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    f = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(f[:8], "little", signed=True), int.from_bytes(f[8:], "little", signed=True)


SIGNED = "doc_id long, tag long, n_shingles long, f1 long, f2 long, signature binary, sketch binary"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("tag"), "text")


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """Per document: set size, 128-bit set fingerprint, MinHash signature and its sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = _permutations(trees)
        for b in batches:
            for c in chunks(b.column(2), "lower"):
                s, first = shingle_sets_of(c)
                n = np.diff(first)
                some = np.flatnonzero(n)
                prints = [_fingerprint(s[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                sig: list = [None] * len(n)
                sk: list = [None] * len(n)
                if len(some):
                    m = minhash(s, first[some], flips, factors)
                    for i, x, y in zip(some.tolist(), m.astype(">u4"), sketches(m), strict=True):
                        sig[i], sk[i] = x.tobytes(), y.tobytes()
                own = b.slice(c.rows.start, len(c.rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(n, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(sig, pa.binary()), pa.array(sk, pa.binary())],
                    names=[x.split()[0] for x in SIGNED.split(", ")],
                )

    return _keyed(docs).mapInArrow(tidy(rows), SIGNED)


def region_pairs(ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one region, whose rows are sorted by ``values`` (from depth BASE on)."""
    todo = [(0, len(ids), BASE, -1)]
    while todo:
        lo, hi, depth, above = todo.pop()
        own = ids[lo:hi]
        if hi - lo <= LEAF:
            i, j = np.triu_indices(hi - lo, 1)
            yield own[i], own[j]
            continue
        lead = own.min()
        if lead != above:
            yield own, np.full(hi - lo, lead)
        if depth == DEPTH:
            yield own[:-1], own[1:]
            continue
        cuts = np.flatnonzero(np.diff(values[lo:hi, depth])) + lo + 1
        edges = [lo, *cuts.tolist(), hi]
        # neighbours across a cut have the longest common prefix there
        yield ids[cuts - 1], ids[cuts]
        todo += [(a, b, depth + 1, lead) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, of sorted batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(run)


def _pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        x = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    for a, b in found:
        x = np.stack([np.minimum(a, b), np.maximum(a, b)], 1).astype(np.int64)
        x = x[x[:, 0] != x[:, 1]]
        if len(x):
            held.append(x)
            size += len(x)
        if size > 100_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that the forest proposes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, run in _groups(batches, 2):
                ids = np.array([r[4] for r in run], np.int64)
                if run[0][5] > DEALT:
                    yield ids, np.full(len(ids), run[0][3])
                if len(run) > 1:
                    yield from region_pairs(ids, np.frombuffer(b"".join(r[2] for r in run), ">u4").reshape(len(run), DEPTH))

        yield from _pair_batches(found())

    salted = members.select("key", F.when(F.col("n") > DEALT, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / DEALT))).otherwise(0).alias("salt"), "order", "lead", "id", "n")
    return salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "order", "id").mapInArrow(tidy(rows), "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal 4-bit values of two arrays of sketches (rows of bytes)."""
    z = x ^ y
    return ((z & 15) == 0).sum(-1) + ((z & 240) == 0).sum(-1)


def _both(pairs: DataFrame, table: DataFrame, columns: list[str], hot: list, how: str = "inner") -> DataFrame:
    """``pairs`` (a, b, ...) with ``columns`` of ``table`` (id, ...) for each end; ends that lead many pairs are salted."""
    one, two = (table.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)) for c in "ab")
    return salted_join(pairs, one, "a", hot, ["b"], how).join(two, "b", how)


def screened(pairs: DataFrame, nodes: DataFrame, hot: list, forest: Forest) -> DataFrame:
    """Pairs whose set sizes and sketches allow a link, with the number of equal values."""
    least = forest.screen

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                same = _alike(x, y)
                ok = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(same.astype(np.int32)).filter(ok)], names=["a", "b", "same"])

    sized = _both(pairs, nodes, ["sketch", "n_shingles"], hot).where(forest.whole * F.least("n_shingles_a", "n_shingles_b") >= forest.part * F.greatest("n_shingles_a", "n_shingles_b"))
    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(tidy(rows), "a long, b long, same int")


def shingle_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``chosen`` (doc_id, tag, id); the set as packed 64-bit hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), "lower"):
                s, first = shingle_sets_of(c)
                sets = [s[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.rows.start, len(c.rows)), pa.array(sets, pa.binary())], names=["id", "shingles"])

    thin = likely(_keyed(docs), "tag", bitmap(chosen.select("tag")))
    # a merge join puts the Python steps before and behind it into stages of their own, so a task has one worker
    found = thin.join(chosen.select(F.col("doc_id").alias("of"), F.col("tag").alias("with"), "id").hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("with")))
    return found.select("id", "text").mapInArrow(tidy(rows), "id long, shingles binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, hot: list, forest: Forest) -> DataFrame:
    """The pairs (a, b) that are links on their whole sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(forest.whole * both >= forest.part * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return _both(pairs.select("a", "b"), sets, ["shingles"], hot).select("a", "b", "shingles_a", "shingles_b").mapInArrow(tidy(rows), "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame, hot: list) -> DataFrame:
    """Pairs whose ends are not known to be in one component."""
    named = _both(pairs, labels.select(F.col("node").alias("id"), F.col("component").alias("of")), ["of"], hot, "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def block_links(large: DataFrame, labels: DataFrame, sets: DataFrame, hot: list, forest: Forest) -> DataFrame:
    """Links (a, b) between components inside the regions over LEAF, found exactly in blocks.

    Documents outside a region's largest component meet all of its documents, whole sets at
    hand; a pair that shares a region in an earlier order has been compared there.  Of a document's
    links to one component a block gives one.
    """
    named = large.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "tree", "id", "n", "keys", F.coalesce("component", "id").alias("of"))
    sizes = named.groupBy("key", "of").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("of", F.struct("size", "of")).alias("main"), F.count("*").alias("components"), F.max("size").alias("most"))
    mixed = salted_join(named, main.where("components > 1"), "key", hot, ["id"]).join(sets, "id")
    outside = F.col("of") != F.col("main")
    row_blocks, out_blocks = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")
    spot, rest = F.xxhash64("id", F.lit(7)), ["id", "of", "tree", "keys", "shingles"]
    left = mixed.where(outside).select("key", F.pmod(spot, out_blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), row_blocks - 1)).alias("j"), F.lit(0).alias("side"), *rest)
    right = mixed.select("key", F.explode(F.sequence(F.lit(0), out_blocks - 1)).alias("i"), F.pmod(spot, row_blocks).cast("int").alias("j"), F.lit(1).alias("side"), *rest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, run in _groups(batches, 3):
                x_rows, y_rows = ([r for r in run if r[3] == s] for s in (0, 1))
                if not x_rows or not y_rows:
                    continue
                tree = x_rows[0][6]
                ids, of, keys = np.array([r[4] for r in y_rows]), np.array([r[5] for r in y_rows]), np.array([r[7] for r in y_rows])
                sets_y = [np.frombuffer(r[8], np.uint64) for r in y_rows]
                sizes_y = np.array([len(s) for s in sets_y])
                everything, owner = np.concatenate(sets_y), np.repeat(np.arange(len(y_rows)), sizes_y)
                order = np.argsort(everything, kind="stable")
                everything, owner = everything[order], owner[order]
                for r in x_rows:
                    x = np.frombuffer(r[8], np.uint64)
                    lo, hi = np.searchsorted(everything, x, "left"), np.searchsorted(everything, x, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(ids))
                    hit = (forest.whole * both >= forest.part * (len(x) + sizes_y - both)) & (of != r[5])
                    hit &= ~(keys[:, :tree] == np.array(r[7][:tree])).any(1)
                    if hit.any():
                        hit = np.flatnonzero(hit)
                        hit = hit[np.unique(of[hit], return_index=True)[1]]
                        yield np.full(len(hit), r[4]), ids[hit]

        yield from _pair_batches(found())

    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(tidy(rows), "a long, b long").distinct()


def linked(docs: DataFrame, link: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, tag, n_shingles, component_id and kept of every row; links from a similarity of link[0] / link[1] on."""
    forest = Forest(*link)
    trees = forest.trees
    full = materialise(signatures(docs, trees), "signatures")
    equal = full.where("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tag")).alias("row"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "sketch"))
    )
    # a node is named by 64 bits of its set's fingerprint
    first = materialise(equal.select(F.col("f1").alias("id"), "f2", "least", "row.doc_id", "row.tag", "n", "n_shingles", "signature", "sketch"), "nodes")
    signed = materialise(full.select("doc_id", "tag", "n_shingles", "f1", "f2"), "fingerprints")
    discard(full)
    width = 4 * DEPTH
    orders = [F.substring("signature", t * width + 1, width) for t in range(trees)]
    keys = [F.xxhash64(F.lit(t), F.substring("signature", t * width + 1, 4 * BASE)) for t in range(trees)]
    spread = first.select("id", F.posexplode(F.array(*(F.struct(o.alias("order"), k.alias("key")) for o, k in zip(orders, keys, strict=True)))).alias("tree", "at"))
    spread = spread.select("id", "tree", "at.order", "at.key")
    regions = materialise(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1"), "regions")
    hot_regions = hot_keys(regions.select("key", "n"))
    members = materialise(salted_join(spread, regions, "key", hot_regions, ["id"]), "members")
    nodes = first.select("id", "n_shingles", "sketch", F.array(*keys).alias("keys"), "doc_id", "tag")
    nodes = materialise(nodes.join(members.select("id").distinct(), "id", "left_semi"), "nodes")
    names = materialise(first.select("id", "f2", "least", "n"), "node-names")
    discard(first, regions)

    proposed = materialise(candidates(members), "candidates")
    hot = hot_keys(proposed.groupBy("a").agg(F.count("*").alias("n")))
    pairs = materialise(screened(proposed, nodes, hot, forest), "pairs")
    discard(proposed)
    large = members.where(F.col("n") > LEAF).select("key", "tree", "id", "n").join(nodes.select("id", "keys"), "id")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    sets = materialise(shingle_sets(docs, materialise(nodes.select("doc_id", "tag", "id").join(ids, "id", "left_semi"), "chosen")), "shingle-sets")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a"))
    links = materialise(confirmed(best, sets, hot, forest), "links")
    labels = materialise(components(links), "components")
    links = links.unionByName(materialise(confirmed(_apart(pairs, labels, hot), sets, hot, forest), "links"))
    labels = materialise(components(links), "components")
    more = materialise(block_links(large, labels, sets, hot_regions, forest), "links")
    if more.head(1):
        labels = materialise(components(links.unionByName(more)), "components")

    # a component is named by its least id, then its sets tell their documents; single sets tell their own
    discard(members, nodes, sets, pairs)
    of = names.select(F.col("id").alias("f1"), "f2", "least", "n").join(labels.withColumnRenamed("node", "f1"), "f1", "left")
    joined = of.where("component is not null")
    least = joined.groupBy("component").agg(F.min("least").alias("name"))
    hot_names = hot_keys(joined.groupBy("component").agg(F.count("*").alias("m")))
    named = salted_join(joined, least, "component", hot_names, ["f1"]).select("f1", "f2", "n", "name").unionByName(of.where("component is null and n > 1").select("f1", "f2", "n", F.col("least").alias("name")))
    named = materialise(named, "named")
    discard(names)
    hot_sets = hot_keys(named.groupBy("f1").agg(F.sum("n").alias("n")))
    out = salted_join(signed.select("doc_id", "tag", "n_shingles", "f1", "f2"), named.select("f1", "f2", "name", F.lit(True).alias("shared")), "f1", hot_sets, ["doc_id", "tag"], "left", ["f2"])
    component = F.when((F.col("n_shingles") > 0) & F.col("shared"), F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tag", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, link: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return linked(docs, link).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, link: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs``, with all their columns, without those that are not kept."""
    gone = materialise(linked(docs, link).where("not kept").select(F.col("doc_id").alias("of"), F.col("tag").alias("with")).distinct(), "near-duplicates")
    row = docs.select(F.col("doc_id").cast("long").alias("id"), text_tag().alias("tag"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = bitmap(gone.select("with"))
    left = likely(row, "tag", held).join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("with")), "left_anti")
    return unlikely(row, "tag", held).select("row").unionByName(left.select("row")).select("row.*")
