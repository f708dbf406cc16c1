"""Byte-level BPE through the ``tokenizers`` library, with a bounded cache of short pieces.

The pre-tokeniser of the supported files never joins text across a single space or line feed
that stands between two non-blank characters, so a text is the concatenation of pieces cut there
and its ids are the concatenation of theirs.  Pieces repeat, so the library encodes each
distinct piece once per worker while the cache holds it.  Texts with other white space are cut
only where that is safe; texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

_SAFE = re.compile(r"(?<!\s)(?=[ \n]\S)")


#: Words that a worker keeps encoded at least, over its tasks.
CACHED = 600_000


class Pieces:
    """Packed ids by piece in two generations: a piece in use survives, others go in time."""

    def __init__(self, encode: Callable[[list[str]], list[bytes | None]]):
        self.encode, self.new, self.old, self.limit = encode, {}, {}, CACHED

    def fetch(self, pieces: set[str]) -> dict[str, bytes | None]:
        """The cache, holding at least ``pieces``."""
        if len(self.new) + len(pieces) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = []
        for p in pieces.difference(new):
            if p in old:
                new[p] = old[p]
            else:
                missing.append(p)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            new.update(zip(part, self.encode(part), strict=True))
        return new


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable ones as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = ("<u2", "H") if small else ("<u4", "I")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        #: Whether a blank and letters are one piece that goes to the model as its bytes' letters.
        self.direct = parts["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        self.letters = _byte_letters()
        self.marks = dict(zip(",.", self._pieces([",", "."]), strict=True))
        self.words, self.pieces = Pieces(self._words), Pieces(self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes | None]:
        """Ids of a space or line feed and a word; None where the cut is not a safe one.

        Letters and a stop behind them are always two pieces, so a known word serves with both.
        """
        out: list[bytes | None] = [None] * len(words)
        left, tokenize = [], self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            mark = self.marks.get(w[-1:])
            core = mark and w[:-1].lstrip("\n").isalpha() and (self.words.new.get(w[:-1]) or self.words.old.get(w[:-1]))
            if core:
                out[i] = core + mark
            elif self.direct and w.isalpha():
                spelt = (" " + w).encode().decode("latin-1").translate(self.letters)
                out[i] = array(self.code, [x.id for x in tokenize(spelt)]).tobytes()
            else:
                left.append(i)
        found = self._pieces([words[i] if words[i][:1] == "\n" else " " + words[i] for i in left])
        for i, ids in zip(left, found, strict=True):
            bare = words[i].removeprefix("\n")
            out[i] = ids if bare and bare == bare.strip() else None
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text (null: empty)."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, str, list[str]]] = []
        seen: set[str] = set()
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif any(s in text for s in self.special):
                out[i] = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                first, *words = text.replace("\n", " \n").split(" ")
                if first == first.strip():
                    cut.append((i, first, words))
                    seen.update(words)
                else:
                    odd.append(i)
        known, firsts = self.words.fetch(seen), self.pieces.fetch({first for _, first, _ in cut})
        for i, first, words in cut:
            try:
                out[i] = firsts[first] + b"".join(map(known.__getitem__, words))
            except TypeError:  # a None among them
                odd.append(i)
        if odd:
            parts = {i: _SAFE.split(texts[i]) for i in odd}
            known = self.pieces.fetch({p for x in parts.values() for p in x})
            for i, x in parts.items():
                out[i] = b"".join(map(known.__getitem__, x))
        return out


    def bound(self, cached: int) -> None:
        """Keep ``cached`` words and pieces each; under the usual number the caches are emptied, to free memory."""
        for held in (self.words, self.pieces):
            held.limit = cached
            if cached < CACHED:
                held.new, held.old = {}, {}


_encoders: dict[str, PieceEncoder] = {}


@contextmanager
def encoder(path: str, cached: int = CACHED) -> Iterator[PieceEncoder]:
    """The worker's encoder for a tokenizer file; a smaller cache than usual lasts as long as the task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].bound(cached)
    try:
        yield _encoders[path]
    finally:
        _encoders[path].bound(cached)
