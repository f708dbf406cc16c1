"""Word hashes of whole Arrow batches, without a Python object a word.

A word is a run of bytes other than blank and 0x09-0x0D.  Its hash is the sum of a 64-bit value per
byte times a power of an odd constant that grows with the byte's place in the word, then avalanched;
words over ``LONG`` bytes are hashed one by one.  Texts are taken in chunks of about ``CHUNK`` bytes, so
memory does not depend on the batch; nothing is cached between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Multiplier of the rolling word-sequence hash (odd, so every step is a bijection).
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK, LONG = 1 << 17, 1024


def finish(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
_BYTES = np.where(_SOLID, finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.uint64(0))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_PLAIN = _LOWER.copy()
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = np.uint64(0)
#: Byte values by way of reading: as they are, A-Z folded, and A-Z folded with ASCII punctuation blank.
WAYS = {"exact": _BYTES, "lower": _LOWER, "plain": _PLAIN}
_POWERS = np.cumprod(np.where(np.arange(LONG + 1) > 0, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)), dtype=np.uint64)


class Chunk(NamedTuple):
    """Words of the texts ``rows``: ``hashes[first[i] : first[i + 1]]`` are those of the i-th."""

    rows: range
    hashes: np.ndarray
    first: np.ndarray
    text: np.ndarray  # of each word, the number of its text in the chunk

    def valid(self, k: int) -> np.ndarray:
        """Places from which ``k`` words lie in one text."""
        if len(self.hashes) < k:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.text[: len(self.text) - k + 1] == self.text[k - 1 :])


def _hashes(data: np.ndarray, offsets: np.ndarray, way: str) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end) of texts that lie side by side."""
    values = WAYS[way]
    solid = (values != 0)[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), first
    stops = np.flatnonzero(ends) + 1
    lo = starts[0]
    place = np.arange(len(data) - lo) - np.repeat(starts - lo, np.diff(starts, append=len(data)))
    np.minimum(place, LONG, out=place)
    parts = values[data[lo:]]
    parts *= _POWERS[place]
    h = np.add.reduceat(parts, starts - lo)
    for i in np.flatnonzero(stops - starts > LONG).tolist():
        word = data[starts[i] : stops[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(word if way == "exact" else word.lower())
    return finish(h), first


def chunks(texts: pa.Array, way: str = "exact") -> Iterator[Chunk]:
    """The words of a string column (null: none), read in one of ``WAYS``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        own = offsets[lo : hi + 1]
        h, first = _hashes(data[own[0] : own[-1]], own - own[0], way)
        yield Chunk(range(lo, hi), h, first, np.repeat(np.arange(hi - lo), np.diff(first)))
        lo = hi


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (fewer words: none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= MIX
        out += words[i : n + i]
    return finish(out)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out
