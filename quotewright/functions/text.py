"""Scalar text functions as Column expressions, all inside the JVM but for NFC."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from . import tables as t
from .lazy import arrow_udf


def once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


@arrow_udf("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def prefold(c: Column, nfc: bool = False) -> Column:
    """Canonical letters without invisible controls; ``nfc`` composes marks first (in Python)."""
    c = F.replace(_nfc(c) if nfc else c, F.lit("ﷲ"), F.lit("الله"))
    return F.translate(F.regexp_replace(c, f"[{t.ZERO_WIDTH}]", ""), *t.LETTER_FOLDS)


def strict(c: Column, nfc: bool = False) -> Column:
    c = F.regexp_replace(prefold(F.coalesce(c, F.lit("")), nfc), f"[{t.STRICT_MARKS}]", "")
    return squeeze(F.regexp_replace(F.translate(c, t.ALEF_FORMS, "ا" * 4), f"[{t.PUNCTUATION}]", " "))


def lenient(c: Column, nfc: bool = False) -> Column:
    return F.translate(strict(c, nfc), "ةى", "هي")


def matching(c: Column, nfc: bool = False) -> Column:
    """Skeleton of Arabic letters alone; other text becomes blank."""
    c = F.translate(F.regexp_replace(prefold(F.coalesce(c, F.lit("")), nfc), f"[{t.MATCH_MARKS}]", ""), *t.MATCH_FOLDS)
    return squeeze(F.regexp_replace(c, f"(?U)[^{t.ARABIC_LETTERS}\\s]", " "))


def light(c: Column, nfc: bool = False) -> Column:
    """Punctuation and tatweel to spaces; marks stay."""
    c = F.coalesce(c, F.lit(""))
    return squeeze(F.regexp_replace(_nfc(c) if nfc else c, f"[{t.PUNCTUATION}ـ]", " "))


def latin(c: Column) -> Column:
    """Lower-case letters and digits, runs of anything else as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def content_words(words: Column, stopwords: list[str]) -> Column:
    """Words longer than one letter that are not in the list as it is written."""
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(sorted(set(stopwords))))  # a hashed set


def char_ngrams(c: Column, n: int = 4) -> Column:
    """Distinct runs of ``n`` characters, in one walk over the text: a substring counts from its begin."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def collapse(c: Column) -> Column:
    """Runs of one character as one."""
    return F.regexp_replace(c, r"(.)\1+", "$1")


def phonetic(word: Column) -> Column:
    return collapse(F.translate(word, *t.PHONETIC_FOLDS))


def word_ngrams(words: Column, n: int) -> Column:
    def grams(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    return once(words, grams)


def anchor_keys(words: Column) -> Column:
    """Trigram and the two skip-grams at every position: (position, key)."""

    def keys(w: Column) -> Column:
        def at(i: Column) -> Column:
            def key(*steps: int) -> Column:
                return F.when(i + max(steps) < F.size(w), F.concat_ws(" ", *(F.get(w, i + s) for s in steps)))

            return F.filter(F.array(key(0, 1, 2), key(0, 2, 3), key(0, 1, 3)), lambda k: k.isNotNull())

        positions = F.sequence(F.lit(0), F.size(w) - 3)
        found = F.flatten(F.transform(positions, lambda i: F.transform(at(i), lambda k: F.struct(i.alias("pos"), k.alias("key")))))
        return F.when(F.size(w) >= 3, found).otherwise(F.array().cast("array<struct<pos:int,key:string>>"))

    return once(words, keys)


def _one_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """(start, end) without quotes and brackets at both ends and stops at the end."""
    piece = F.substring(text, start + 1, end - start)
    left = F.length(F.regexp_extract(piece, f"^{_one_of(t.QUOTES)}*", 0))
    rest = F.substring(piece, left + 1, F.length(piece))
    right = F.length(F.regexp_extract(rest, f"{_one_of(t.QUOTES + t.CLOSERS)}*$", 0))
    return F.struct((start + left).cast("int").alias("start"), (end - right).cast("int").alias("end"))


def sanitize_answer(c: Column) -> Column:
    """Foreign scripts out, doubled marks and blanks as one, no space before a mark."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{t.FOREIGN_SCRIPTS}]+", " ")
    c = F.regexp_replace(c, r"([،,؛.])\s*[،,؛]+", "$1")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(c, r" +([،؛.:])", "$1"), r"^\s+|\s+$", "")


def without_default_diacritics(c: Column) -> Column:
    for old, new in t.DEFAULT_DIACRITICS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def without_tatweel(c: Column) -> Column:
    return F.replace(c, F.lit(t.TATWEEL), F.lit(""))


def without_marks(c: Column) -> Column:
    """Text without combining marks and tatweel, blanks as one."""
    return squeeze(F.regexp_replace(c, f"[{t.STRICT_MARKS}]", ""))


def clean_field(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\t\r\n]", " "))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))


_STOPS = [c.encode() for c in t.BOUNDARY_MARKS]


def _offsets(text: pa.Array) -> pa.Array:
    """Tokens of a column of texts, on the bytes of the whole batch at once."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    n = len(raw)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    # a place in the bytes before each text's first one ends a word too
    fresh = np.zeros(n + 1, bool)
    fresh[edges] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    first = np.flatnonzero(solid & (~before | fresh[:-1]))
    end = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    lead = (raw & 192) != 128
    place = np.concatenate(([0], np.cumsum(lead)))  # code points before each byte
    stop = np.zeros(n + 1, np.int64)
    for mark in _STOPS:
        hit = np.ones(max(0, n - len(mark) + 1), bool)
        for k, byte in enumerate(mark):
            hit &= raw[k : k + len(hit)] == byte
        stop[1 : len(hit) + 1] += hit
    stop = np.cumsum(stop)  # stops that begin before each byte
    of = np.searchsorted(edges, first, "right") - 1
    gap = np.concatenate((first[1:], [n]))[: len(first)]
    gap = np.minimum(gap, edges[of + 1]) if len(first) else gap
    at = np.flatnonzero(lead)
    tail = np.maximum(first, at[np.maximum(place[end] - 2, 0)]) if len(first) else first
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(end - first))).astype(np.int32)), pa.py_buffer(raw[solid])])
    origin = place[edges[of]]
    fields = [words, pa.array((place[first] - origin).astype(np.int32)), pa.array((place[end] - origin).astype(np.int32)), pa.array(stop[gap] > stop[tail])]
    return pa.ListArray.from_arrays(np.searchsorted(first, edges).astype(np.int32), pa.StructArray.from_arrays(fields, ["word", "start", "end", "boundary"]))


def offset_tokens(c: Column) -> Column:
    """Tokens (word, start, end, boundary): half-open code-point offsets, and a strong stop after.

    Blank-separated words; a boundary is a stop among the last two characters or in the gap behind.  In Arrow
    batches, because a fold in the JVM copies its array at each word.
    """
    # the types are given, since this module's annotations are text
    whole = F.arrow_udf(_offsets, "array<struct<word:string,start:int,end:int,boundary:boolean>>", ArrowUDFType.SCALAR)
    return whole(c)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays, by rows of the table."""
    return once(a, lambda u: once(b, lambda v: _lcs(u, v)))


def _lcs(a: Column, b: Column) -> Column:
    zero = F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0)))

    def row(previous: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.get(b, j) == x, F.get(previous, j) + 1).otherwise(F.greatest(F.get(previous, j + 1), F.element_at(acc, -1)))
            return F.array_append(acc, best)

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), cell)).otherwise(previous)

    return F.aggregate(a, zero, row, lambda last: F.element_at(last, -1))


def edit_similarity(a: Column, b: Column, most: int = 600) -> Column:
    a, b = F.substring(a, 1, most), F.substring(b, 1, most)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def allowed_gap(n: Column) -> Column:
    return F.when(n <= 3, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n * 0.2).cast("int")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def contains_sequence(s: Column, q: Column) -> Column:
    return F.when(F.size(q) == 0, F.lit(True)).when(F.size(q) > F.size(s), F.lit(False)).otherwise(
        F.exists(F.sequence(F.lit(1), F.size(s) - F.size(q) + 1), lambda i: F.slice(s, i, F.size(q)) == q)
    )


def answer_text(json: Column) -> Column:
    """The answer in a model's reply: ``response``, first choice, joined output parts, or plain text."""
    parts = F.from_json(F.get_json_object(json, "$.output[*].content[*].text"), "array<string>")
    return F.coalesce(F.get_json_object(json, "$.response"), F.get_json_object(json, "$.choices[0].message.content"), F.array_join(parts, ""), json)


@dataclass(frozen=True)
class Profile:
    """How a language is normalised, stopped and keyed."""

    name: str
    stopwords: tuple[str, ...]

    def normalise(self, c: Column) -> Column:
        return matching(c) if self.name == "arabic" else latin(c)

    def forms(self, words: Column) -> Column:
        """Each word's letters alone, as one text's, since an expression a word costs more."""
        joined = F.array_join(words, "\n")
        if self.name == "arabic":
            return F.transform(words, lambda w: F.replace(self.normalise(w), F.lit(" "), F.lit("")))
        return F.slice(F.split(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}\n]+", ""), "\n"), 1, F.size(words))

    def plain_forms(self, text: Column) -> Column:
        """The forms of a whole text's blank-separated words that have letters, without their places."""
        if self.name == "arabic":
            return F.filter(self.forms(F.split(text, r"\s+")), lambda w: w != "")
        return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: w != "")

    def key(self, c: Column) -> Column:
        return phonetic(c) if self.name == "arabic" else collapse(c)

    def keys(self, words: Column) -> Column:
        """``key`` of words that hold no line feed, as of one text."""
        return F.slice(F.split(self.key(F.array_join(words, "\n")), "\n"), 1, F.size(words))

    def content(self, words: Column) -> Column:
        return content_words(words, list(self.stopwords))


ARABIC = Profile("arabic", tuple(t.ARABIC_STOPWORDS))
LATIN = Profile("latin", tuple(t.LATIN_STOPWORDS))
