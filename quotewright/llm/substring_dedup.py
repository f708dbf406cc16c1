"""Repeated passages removed by seed and extend.

Words are whole runs of non-blank characters.  A window is ``WINDOW`` consecutive words; it is
removed where the same words start earlier (smaller id, or same document and earlier start), so
what goes is the union of all maximal repeats of at least ``WINDOW`` words but their first
occurrence.

Seeds are winnowed: the least hash among the ``GRAM``-word grams of a window is its anchor, which
depends on the window's words alone, so equal windows have equal anchors.  Anchors are counted over
all documents.  One that stands in a single place rules out all its windows.  The others are extended
both ways, to all windows around them that chose them; windows meet on their anchor and match if
their own hashes agree too (anchor and window, 128 bits together), and the least (id, text hash, start)
of equal windows is the first occurrence.  Runs of matching windows are the maximal repeats.

A worker settles among the documents it reads what it can, so a passage in very many documents is
shuffled about once a worker's buffer.  Anchors with many occurrences are dealt twice: by a salt of the
document, where all but each salt's first occurrences are settled, then what is left by slices of the
window hash.  Neither a passage in every document nor one gram in ever different surroundings lands in
one task.  Repeated and frequent anchors are passed on as bitmaps whose size follows the count of
anchors up to ``MOST_BITS``; a bit set by chance costs a needless comparison and changes nothing.

Null or blank text has no words.  A null id counts as smaller than all others.  Documents are told
apart by id and text: rows that repeat both share one fate; different texts of one id are ordered by
their hash.  Extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import FAN, bitmap, hot_keys, likely, may_hold, unlikely
from .common import discard, materialise, text_tag, tidy
from .wordhash import Chunk, chunks, sequence_hashes, sliding

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1
#: Windows that a worker holds at once.
HELD = 400_000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("sid"), text_tag().alias("tag"), "text")


def window_anchors(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, places where a window starts, the anchor of each of those windows)."""
    starts = c.valid(WINDOW)
    grams = sequence_hashes(c.hashes, GRAM)
    return grams, starts, sliding(grams, SPAN, np.minimum)[starts] if len(starts) else grams[:0]


def anchor_places(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text number, anchor) of each gram that some window of its text chose."""
    grams, starts, anchors = window_anchors(c)
    if not len(starts):
        return np.empty(0, np.int64), grams[:0]
    # a gram is chosen if it equals the greatest anchor among the windows around it; 0 stands for none
    of = np.zeros(len(grams) + SPAN - 1, np.uint64)
    of[starts + SPAN - 1] = anchors
    chosen = np.flatnonzero(sliding(of, SPAN, np.maximum) == grams)
    chosen = chosen[c.text[chosen] == c.text[np.minimum(chosen + GRAM - 1, len(c.text) - 1)]]
    return c.text[chosen], grams[chosen]


def anchor_counts(docs: DataFrame) -> DataFrame:
    """anchor, whether it stands in two places (``twice``) and in how many (``times``)."""

    def settle(held: list) -> pa.RecordBatch:
        tag, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((tag, anchor))
        tag, anchor = tag[order], anchor[order]
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        times = np.diff(head, append=len(anchor))
        lo, hi = tag[head], tag[head + times - 1]
        doubled = np.zeros(len(anchor), np.int64)
        doubled[1:] = (anchor[1:] == anchor[:-1]) & (tag[1:] == tag[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[head].view(np.int64)), pa.array(lo), pa.array(hi), pa.array(np.add.reduceat(doubled, head) > 0), pa.array(times)],
            names=["anchor", "lo", "hi", "twice", "times"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            tags = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                text, anchor = anchor_places(c)
                if len(text):
                    held.append((tags[c.rows.start : c.rows.stop][text], anchor))
                    size += len(text)
                if size >= HELD:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    one = _keyed(docs).select(F.xxhash64("sid", "tag").alias("of"), "text")
    seen = one.mapInArrow(tidy(rows), "anchor long, lo long, hi long, twice boolean, times long")
    per = seen.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("twice").alias("twice"), F.sum("times").alias("times"))
    return per.select("anchor", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("twice"), "times")


def _earlier(window: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows have an equal (window, key) at a lesser ``place``."""
    later = np.zeros(len(window), bool)
    order = np.argsort(window)
    w = window[order]
    same = w[1:] == w[:-1]
    some = np.zeros(len(w), bool)
    some[1:] |= same
    some[:-1] |= same
    order = order[some]
    if len(order):
        order = order[np.lexsort((place[order], key[order], window[order]))]
        w, k, p = window[order], key[order], place[order]
        head = np.ones(len(order), bool)
        head[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        later[order] = p != p[first]
    return later


def _ranks(sid: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Numbers that order documents by (sid, tag); equal ones share a number."""
    order = np.lexsort((tag, sid))
    s, t = sid[order], tag[order]
    new = np.zeros(len(order), np.uint64)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``data`` as binary values, without a loop."""
    offsets = np.concatenate(([0], np.cumsum(sizes * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


#: kind 0: a document (``n_words`` in ``start``, SHA-256 in ``data``); 1: removed windows; 2: windows to be compared.
FOUND = "kind int, sid long, tag long, start long, n long, anchor long, level int, data binary"
_FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _found(kind: int, *columns) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, _FOUND_TYPES[1:], strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=_FOUND_NAMES)


def _runs(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, lengths) of consecutive places of one document that agree in ``same``."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    heads = np.flatnonzero(new)
    return heads, np.diff(heads, append=len(doc))


def _settled(sid, tag, doc, start, anchor, window, level) -> Iterator[pa.RecordBatch]:
    """Rows of windows (sorted by ``doc`` and ``start``): later ones as runs, the others as blocks."""
    place = _ranks(sid, tag)[doc] << np.uint64(32) | start.astype(np.uint64)
    later = _earlier(window, anchor, place)
    gone = np.flatnonzero(later)
    heads, n = _runs(doc[gone], start[gone])
    if len(heads):
        at = gone[heads]
        yield _found(1, sid[doc[at]], tag[doc[at]], start[at], n, None, None, None)
    heads, n = _runs(doc, start, anchor)
    open_ = np.add.reduceat(~later, heads) > 0 if len(heads) else np.empty(0, bool)
    if open_.any():
        inside = np.repeat(open_, n)
        at = heads[open_]
        data = np.where(later, np.uint64(0), window)[inside]
        yield _found(2, sid[doc[at]], tag[doc[at]], start[at], n[open_], anchor[at].view(np.int64), level[at], _binaries(data, n[open_]))


def _extended(docs: DataFrame, repeated, hot: list, with_documents: bool) -> DataFrame:
    """``FOUND`` rows of every document: its windows with repeated anchors, settled as far as one worker can."""

    def settle(docs_held: list, held: list) -> Iterator[pa.RecordBatch]:
        sid, tag = (np.concatenate(x) for x in zip(*docs_held, strict=True))
        doc, start, anchor, window, level = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from _settled(sid, tag, doc, start, anchor, window, level)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_held: list = []
        held: list = []
        size = before = 0
        for b in batches:
            sids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(b.column(2)):
                own = slice(c.rows.start, c.rows.stop)
                if with_documents:
                    joined = [b" ".join((t.as_py() or "").encode().split()) for t in b.column(2)[own]]
                    yield _found(0, sids[own], tags[own], np.diff(c.first), None, None, None, pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()))
                _, starts, anchors = window_anchors(c)
                keep = may_hold(repeated.value, anchors.view(np.int64))
                starts, anchors = starts[keep], anchors[keep]
                if not len(starts):
                    continue
                window = sequence_hashes(c.hashes, WINDOW)[starts]
                window[window == 0] = 1
                level = np.zeros(len(starts), np.int32)
                for h in hot:
                    level += may_hold(h.value, anchors.view(np.int64))
                docs_held.append((sids[own], tags[own]))
                held.append((c.text[starts] + before, starts - c.first[c.text[starts]], anchors, window, level))
                before, size = before + len(c.rows), size + len(starts)
                if size >= HELD:
                    yield from settle(docs_held, held)
                    docs_held, held, size, before = [], [], 0, 0
        if held:
            yield from settle(docs_held, held)

    return _keyed(docs).mapInArrow(tidy(rows), FOUND)


def _compared(blocks: DataFrame, group: Column, last: bool) -> DataFrame:
    """``FOUND`` rows of blocks that meet on ``group``: later windows, and unless ``last`` the firsts of frequent anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, firsts = None, {}

        def settle(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal current, firsts
            key, sid, tag, start, n, anchor = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(6))
            level = b.column(6).to_numpy(zero_copy_only=False)
            window = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64)
            block = np.repeat(np.arange(len(n)), n)
            at = start[block] + np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
            rank = _ranks(sid, tag)
            some = window != 0
            block, at, w = block[some], at[some], window[some]
            place, own = rank[block] << np.uint64(32) | at.astype(np.uint64), key[block]
            later = _earlier(w, own.view(np.uint64), place)
            if current is not None:  # rows are sorted, so all that a group had before is earlier, or the same place
                for i in np.flatnonzero(own == current).tolist():
                    first = firsts.get(w[i].item())
                    later[i] |= first is not None and first != (sid[block[i]].item(), tag[block[i]].item(), at[i].item())
            if key[-1] != current:
                current, firsts = key[-1].item(), {}
            for i in np.flatnonzero((own == current) & ~later).tolist():
                firsts.setdefault(w[i].item(), (sid[block[i]].item(), tag[block[i]].item(), at[i].item()))
            gone = np.flatnonzero(later)
            gone = gone[np.lexsort((at[gone], rank[block[gone]]))]
            heads, sizes = _runs(rank[block[gone]], at[gone])
            if len(heads):
                x = block[gone[heads]]
                yield _found(1, sid[x], tag[x], at[gone[heads]], sizes, None, None, None)
            if not last:
                left = window.copy()
                left[np.flatnonzero(some)[later]] = 0
                whole = np.repeat(np.arange(len(n)), n)
                keep = (np.bincount(whole, weights=left != 0, minlength=len(n)) > 0) & (level > 0)
                if keep.any():
                    yield _found(2, sid[keep], tag[keep], start[keep], n[keep], anchor[keep], level[keep], _binaries(left[keep[whole]], n[keep]))

        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                yield from settle(whole.slice(at, 8192))

    keyed = blocks.select(group.alias("key"), "sid", "tag", "start", "n", "anchor", "level", "data")
    return keyed.repartition("key").sortWithinPartitions("key", "sid", "tag", "start").mapInArrow(tidy(rows), FOUND)


def _sliced(blocks: DataFrame) -> DataFrame:
    """Blocks of frequent anchors, split by the window hash; windows of other slices become 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, level = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 6))
            window = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64)
            block = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
            piece = (window % (np.uint64(FAN) ** level.astype(np.uint64))[block]).astype(np.int64)
            some = window != 0
            pairs = np.unique(np.stack([block[some], piece[some]], 1), axis=0)
            size = n[pairs[:, 0]]
            row = np.repeat(np.arange(len(pairs)), size)
            first = np.cumsum(n) - n
            at = np.repeat(first[pairs[:, 0]], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            data = np.where(piece[at] == pairs[row, 1], window[at], np.uint64(0))
            taken = b.take(pa.array(pairs[:, 0]))
            yield pa.RecordBatch.from_arrays([*taken.columns[:6], pa.array(pairs[:, 1].astype(np.int32)), _binaries(data, size)], names=_FOUND_NAMES)

    return blocks.mapInArrow(tidy(rows), FOUND)


def repeats(docs: DataFrame, with_documents: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents: sid, tag, n_words, sha; runs: removed windows ``runs`` by sid and tag)."""
    anchors = materialise(anchor_counts(docs).where("twice").select("anchor", "times"), "anchors")
    per = anchors.agg(F.count("*").alias("n")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * per.n).bit_length()))
    repeated = bitmap(anchors.select("anchor"), bits)
    hot = hot_keys(anchors.select("anchor", "times"))
    discard(anchors)
    found = materialise(_extended(docs, repeated, hot, with_documents), "windows")
    salt = F.pmod(F.xxhash64("sid", "tag"), F.pow(F.lit(FAN), "level").cast("long"))
    once = materialise(_compared(found.where("kind = 2"), F.xxhash64("anchor", salt), False), "windows")
    runs = found.where("kind = 1").unionByName(once.where("kind = 1"))
    if hot:
        twice = _sliced(once.where("kind = 2"))
        runs = runs.unionByName(_compared(twice, F.xxhash64("anchor", "level", F.lit(1)), True).where("kind = 1"))
    runs = runs.groupBy("sid", "tag").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    runs = materialise(runs, "runs")
    documents = materialise(found.where("kind = 0").select("sid", "tag", F.col("start").alias("n_words"), F.col("data").alias("sha")), "documents")
    discard(found, once)
    return documents, runs


def keep_mask(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay, given runs of removed windows."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(n, starts + sizes - 1 + WINDOW), -1)
    return np.cumsum(steps[:n]) == 0


def _kept(texts: pa.Array, runs: pa.ListArray) -> Iterator[tuple[int, bytes]]:
    """(words removed, kept words joined by one space) of each text."""
    for text, own in zip(texts, runs, strict=True):
        words = (text.as_py() or "").encode().split()
        own = own.values
        mask = keep_mask(len(words), own.field(0).to_numpy(), own.field(1).to_numpy())
        yield int(len(words) - mask.sum()), b" ".join([w for w, ok in zip(words, mask.tolist(), strict=True) if ok])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    documents, runs = repeats(docs, with_documents=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, hashlib.sha256(kept).digest()) for n, kept in _kept(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["sid", "tag", "n_removed", "kept_sha"])

    thin = likely(_keyed(docs), "sid", bitmap(runs.select("sid")))
    changed = thin.join(runs.hint("merge"), ["sid", "tag"]).select("sid", "tag", "text", "runs").mapInArrow(tidy(rows), "sid long, tag long, n_removed long, kept_sha binary")
    out = documents.join(changed.dropDuplicates(["sid", "tag"]), ["sid", "tag"], "left")
    return out.select(
        F.nullif("sid", F.lit(NULL_ID)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with removed words taken from ``text``; documents of nothing else go.

    Documents that lose no word keep their text as it is, those without words too.
    """
    _, runs = repeats(docs)
    rows_of = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("sid"), text_tag().alias("tag"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, own = b.column(0), b.column(1)
            changed = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            if len(changed):
                at = pa.array(changed)
                texts = row.field(place)
                kept = [k for _, k in _kept(texts.take(at), own.take(at))]
                emptied = np.zeros(b.num_rows, bool)
                emptied[changed] = [not k for k in kept]
                mask = np.zeros(b.num_rows, bool)
                mask[changed] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([k.decode() for k in kept], texts.type))
                fields = [row.field(i) if i != place else texts for i in range(row.type.num_fields)]
                row = pa.StructArray.from_arrays(fields, fields=list(row.type)).filter(pa.array(~emptied))
            if len(row):
                yield pa.RecordBatch.from_arrays([row], names=["row"])

    held = bitmap(runs.select("sid"))
    touched = likely(rows_of, "sid", held).join(runs.hint("merge"), ["sid", "tag"], "left").select("row", "runs")
    schema = touched.select("row").schema
    whole = touched.mapInArrow(tidy(rows), schema).unionByName(unlikely(rows_of, "sid", held).select("row"))
    return whole.select("row.*")
