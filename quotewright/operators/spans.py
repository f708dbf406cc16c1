"""Interval operators: overlap, greedy selection, merging, runs, matching, entity pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.tables import ENTITY_LABELS
from ..functions.text import once


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """Pairs of spans of one document that overlap; an equi-join carries the shuffle."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")), how)


def without_overlap(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return overlap_join(left, right, key, "left_anti")


def greedy(spans: Column) -> Column:
    """Spans kept in array order, each unless it overlaps one kept before."""
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.array_append(kept, s)))


def non_overlapping(spans: DataFrame, order: list[Column], key: str = "doc_id") -> DataFrame:
    """Greedy selection per document by ``order`` (ascending); a document's spans are its own."""
    body = F.struct(*(F.col(c) for c in spans.columns if c != key))
    ordered = spans.select(key, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), body.alias("s")).alias("r"))
    kept = ordered.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r")).select(key, greedy(F.transform("r", lambda r: r["s"])).alias("s"))
    return kept.select(key, F.explode("s").alias("s")).select(key, "s.*")


def runs(tokens: Column, taken: Column) -> Column:
    """Maximal runs of tokens that overlap none of the intervals ``taken``.

    Runs are slices between their first and last places: a fold copies its array at each token.
    """

    def cut(out: Column) -> Column:
        n = F.size(out)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        free = lambda i: F.coalesce(~F.get(out, i), F.lit(False))
        first = F.filter(places, lambda i: free(i) & ~free(i - 1))
        last = F.filter(places, lambda i: free(i) & ~free(i + 1))
        return F.zip_with(first, last, lambda a, b: F.slice(tokens, a + 1, b - a + 1))

    return once(F.transform(tokens, lambda t: F.exists(taken, lambda x: overlaps(t, x))), cut)


def merge_adjacent(pieces: DataFrame, gap: int, key: str = "doc_id") -> DataFrame:
    """Pieces of one label at most ``gap`` apart as one, unless a piece says it begins a new one."""
    w = Window.partitionBy(key).orderBy("start", "end", "label")
    flags = pieces.select(key, "label", "start", "end", "score", "begin", F.lag("label").over(w).alias("last"), F.lag("end").over(w).alias("last_end"))
    # the running end restarts with every span, so chained ends matter only inside one
    flags = flags.withColumn("high", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("last").isNull() | (F.col("last") != F.col("label")) | F.col("begin") | (F.col("start") - F.col("high") > gap)
    numbered = flags.withColumn("span", F.sum(new.cast("int")).over(w))
    return numbered.groupBy(key, "span").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("span")


def entity_label(raw: Column) -> Column:
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?i)^[BI]-", "")))
    out = F.lit(None).cast("string")
    for k, v in ENTITY_LABELS.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def entity_spans(entities: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """(doc, entity, entity_group, start, end, score) pieces as labelled spans with mean score."""
    label = entity_label(F.coalesce("entity_group", "entity"))
    pieces = entities.select(key, label.alias("label"), "start", "end", F.coalesce("score", F.lit(1.0)).alias("score"), F.upper(F.coalesce("entity", F.lit(""))).startswith("B-").alias("begin"))
    merged = merge_adjacent(pieces.where(F.col("label").isNotNull() & (F.col("end") > F.col("start"))), settings.entity_gap, key)
    return merged.where(F.col("score") >= settings.entity_score).withColumn("score", F.round("score", 4))


def with_model_spans(found: DataFrame, model: DataFrame, docs: DataFrame, least_words: int = 3, key: str = "doc_id") -> DataFrame:
    """``found`` and the spans of a model that lie in its gaps, from the left, of ``least_words`` words or more.

    ``found`` (doc_id, start, end, label, hint, source), ``model`` (doc_id, label, start, end, ...), ``docs`` (doc_id, text).
    """
    m = model.select(key, "start", "end", "label").join(docs.select(key, "text"), key).where((F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")))
    words = F.filter(F.split(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), r"\s+"), lambda w: w != "")
    free = without_overlap(m.where(F.size(words) >= least_words).select(key, "start", "end", "label"), found, key)
    # among themselves the first from the left stays
    kept = non_overlapping(free, [F.col("start"), F.col("end"), F.col("label")], key)
    return found.unionByName(kept.select(key, "start", "end", "label", F.lit(None).cast("string").alias("hint"), F.lit("model").alias("source")))


def token_labels(labels: Column, tokens: Column) -> Column:
    """BIO label of each token from labels per character: its first character's, ``B-`` where that begins anew."""
    own = F.transform(tokens, lambda t: F.get(labels, t["start"]))
    joined = lambda i: (i > 0) & (F.get(own, i - 1) == F.get(own, i))
    return F.transform(own, lambda x, i: F.when(x == "O", x).otherwise(F.concat(F.when(joined(i), "I-").otherwise("B-"), x)))


def spans_of_labels(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, label, start, end) of runs of BIO tokens; ``labelled`` (doc_id, tokens, labels)."""
    t = labelled.select(key, F.posexplode(F.arrays_zip("tokens", "labels")).alias("i", "t")).select(key, "i", "t.tokens.start", "t.tokens.end", F.col("t.labels").alias("bio"))
    w = Window.partitionBy(key).orderBy("i")
    t = t.withColumn("label", F.regexp_replace("bio", "^[BI]-", "")).withColumn("new", (F.col("bio").startswith("B-") | (F.lag("label").over(w) != F.col("label")) | (F.col("i") == 0)).cast("int"))
    g = t.withColumn("g", F.sum(F.coalesce("new", F.lit(1))).over(w)).where("label <> 'O'").groupBy(key, "g")
    return g.agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    either = (a["end"] - a["start"]) + (b["end"] - b["start"]) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def match_gold(gold: DataFrame, found: DataFrame, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """One-to-one pairs of gold and found spans with one label, best overlap first."""
    a, b = F.struct("a.start", "a.end"), F.struct("b.start", "b.end")
    pairs = overlap_join(gold, found, key).where(F.col("a.label") == F.col("b.label"))
    pairs = pairs.select(F.col(f"a.{key}").alias(key), F.round(iou(a, b), 6).alias("iou"), a.alias("gold"), b.alias("found")).where(F.col("iou") >= least)
    ordered = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "gold", "found", "iou"))).alias("p"))
    kept = F.aggregate("p", F.slice("p", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y["gold"] == x["gold"]) | (y["found"] == x["found"])), acc).otherwise(F.array_append(acc, x)))
    return ordered.select(key, F.explode(kept).alias("m")).select(key, "m.gold", "m.found", "m.iou")


def char_labels(spans: Column, size: Column) -> Column:
    """Label per character, longest span first, so that inner ones show."""
    by_length = F.array_sort(F.transform(spans, lambda s: F.struct((-(s["end"] - s["start"])).alias("o"), s.alias("s"))))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(by_length, F.lit("O"), lambda acc, x: F.when((x["s"]["start"] <= i) & (i < x["s"]["end"]), x["s"]["label"]).otherwise(acc)))


def padded_windows(size: Column, width: int = 512, stride: int = 256) -> Column:
    """(from, to) of overlapping model windows over ``size`` tokens; the last ones are short and to be padded."""
    return F.when(size <= 0, F.array().cast("array<struct<from:int,to:int>>")).otherwise(F.transform(F.sequence(F.lit(0), size - 1, F.lit(stride)), lambda a: F.struct(a.alias("from"), F.least(a + width, size).alias("to"))))


def overlap_share(a: Column, b: Column) -> Column:
    """The part of ``b`` that ``a`` covers."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return both / F.greatest(F.lit(1), b["end"] - b["start"])


def sliding(size: Column, whole: int = 40, width: int = 24, stride: int = 12, tail: int = 6) -> Column:
    """(from, to) windows over ``size`` tokens: one if short, else strided ones."""
    many = F.transform(F.sequence(F.lit(0), F.greatest(size - tail - 1, F.lit(0)), F.lit(stride)), lambda a: F.struct(a.alias("from"), F.least(a + width, size).alias("to")))
    return F.when(size <= whole, F.array(F.struct(F.lit(0).alias("from"), size.alias("to")))).otherwise(many)
