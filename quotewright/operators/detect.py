"""Rule detection of quotations: segments, triggers, guards, labels, selection."""

from __future__ import annotations

import itertools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import tables as t
from ..functions.lazy import arrow_udf
from ..functions.text import tokens, trim_span
from .spans import non_overlapping


_PAIRED = [re.compile(f"{re.escape(left)}([\\s\\S]*?){re.escape(right)}") for left, right in t.BRACKETS]


def segments(text: str) -> list[tuple[int, int]]:
    """Inside of quotes and of brackets, as half-open places.

    Quotes even in number pair up; an odd number leaves open which of them begin, so every two neighbours count.
    """
    parts = text.split('"')
    marks = list(itertools.accumulate((len(p) + 1 for p in parts[:-1]), initial=-1))[1:]
    between = list(itertools.pairwise(marks))
    quoted = between if len(marks) % 2 else between[::2]
    return [(a + 1, b) for a, b in quoted] + [m.span(1) for pattern in _PAIRED for m in pattern.finditer(text)]


@arrow_udf("array<struct<start:int,end:int>>")
def segments_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"start": a, "end": b} for a, b in segments(x or "")])


def trigger(context: Column) -> Column:
    """Label of the announcement that ends last in ``context``; sequence triggers first on ties."""
    back = F.reverse(context)
    best = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("label"))
    options, rank = [best], 0
    for label, words in (("Ayah", t.SEQUENCE_TRIGGERS), ("Hadith", t.FLAT_TRIGGERS)):
        for word in words:
            rank -= 1
            at = F.locate(word[::-1], back)
            options.append(F.struct(F.when(at > 0, F.length(context) - at + 1).otherwise(-1).alias("end"), F.lit(rank).alias("rank"), F.when(at > 0, F.lit(label)).alias("label")))
    return F.array_max(F.array(*options))["label"]


def announces(text: Column, label: str) -> Column:
    """Whether any trigger of ``label`` stands in ``text``."""
    words = t.SEQUENCE_TRIGGERS if label == "Ayah" else t.FLAT_TRIGGERS
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def sequence_coverage(claims: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, cover): the greatest share of a claim's distinct words in one to three consecutive records.

    ``claims`` (qid, words), ``found`` (qid, idx) the best records of each; a window starts up to two records
    before a found one and holds it.  It goes on over a record only if that shares a word of four letters or more.
    """
    words = claims.select("qid", F.array_distinct("words").alias("own")).where(F.size("own") > 0)
    start = found.select("qid", "idx").join(records.select("idx", "section", F.col("pos").alias("at")), "idx").withColumn("first", F.explode(F.sequence(F.col("at") - 2, F.col("at"))))
    starts = start.select("qid", "section", "at", "first").distinct()
    places = starts.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("pos", F.col("first") + F.col("k"))
    r = records.select("section", "pos", F.array_distinct("words").alias("theirs"))
    rows = places.join(r, ["section", "pos"]).groupBy("qid", "section", "at", "first").agg(F.array_sort(F.collect_list(F.struct("k", "theirs"))).alias("r")).join(words, "qid")
    shares = lambda x: F.exists(F.array_intersect("own", x["theirs"]), lambda w: F.length(w) >= 4)
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), none.alias("held"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = acc["open"] & (x["k"] == acc["n"]) & ((x["k"] == 0) | shares(x))
        held = F.when(goes_on, F.array_union(acc["held"], F.array_intersect("own", x["theirs"]))).otherwise(acc["held"])
        counts = goes_on & (F.col("at") <= F.col("first") + x["k"])
        best = F.when(counts, F.greatest(acc["best"], F.size(held) / F.size("own"))).otherwise(acc["best"])
        return F.struct((acc["n"] + 1).alias("n"), goes_on.alias("open"), held.alias("held"), best.alias("best"))

    return rows.select("qid", F.aggregate("r", state, step, lambda acc: acc["best"]).alias("cover")).groupBy("qid").agg(F.max("cover").alias("cover"))


def flat_coverage(claims: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, cover): the greatest share of a claim's distinct words in one of its best records."""
    words = claims.select("qid", F.array_distinct("words").alias("own")).where(F.size("own") > 0)
    j = found.select("qid", "idx").join(records.select("idx", F.array_distinct("words").alias("theirs")), "idx").join(words, "qid")
    return j.groupBy("qid").agg(F.max(F.size(F.array_intersect("own", "theirs")) / F.size("own")).alias("cover"))


def label_of(trigger_label: Column, cover: Column, cover_flat: Column, n_words: Column, settings: Settings = Settings()) -> Column:
    """Label by corpus coverage; a trigger settles near ties, and stands where coverage does not."""
    long = n_words >= 4
    seq, flat = (cover >= settings.quoted_coverage) & long, (cover_flat >= settings.quoted_coverage_flat) & long
    agrees = F.coalesce(F.when(trigger_label == "Ayah", seq).when(trigger_label == "Hadith", flat), F.lit(False))
    return (
        F.when(agrees & (F.abs(cover - cover_flat) < 0.25), trigger_label)
        .when(seq & (~flat | (cover >= cover_flat)), F.lit("Ayah"))
        .when(flat, F.lit("Hadith"))
        .otherwise(trigger_label)
    )


def candidates(docs: DataFrame, normalise, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, end, span, trigger, n_words): trimmed segments that pass the guards."""
    cut = docs.select("doc_id", "text", F.explode(segments_udf("text")).alias("raw"))
    cut = cut.select("doc_id", "text", trim_span(F.col("text"), F.col("raw.start"), F.col("raw.end")).alias("at")).select("doc_id", "text", "at.start", "at.end")
    cut = cut.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") <= settings.segment_chars))
    cut = cut.withColumn("span", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    begin = F.greatest(F.col("start") - settings.context_chars, F.lit(0))
    cut = cut.withColumn("trigger", trigger(F.substring("text", begin + 1, F.col("start") - begin)))
    cut = cut.withColumn("words", tokens(normalise(F.col("span"))))
    share = F.size(F.filter("words", lambda w: w.isin(sorted({*t.FORMULA_WORDS})))) / F.greatest(F.size("words"), F.lit(1))
    ok = (F.size("words") >= 2) & ((F.size("words") >= 3) | F.col("trigger").isNotNull()) & (share < settings.formula_share)
    return cut.where(ok).select("doc_id", "start", "end", "span", "trigger", F.size("words").alias("n_words"))


def select(found: DataFrame) -> DataFrame:
    """Greedy choice by trigger, coverage and length (all descending)."""
    order = [F.col("trigger").isNull().cast("int"), -F.col("coverage"), F.col("start") - F.col("end"), F.col("start")]
    return non_overlapping(found, order)
