"""Evaluation: character macro-F1, accuracies, stress tables, dataset counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import NO_SOURCE
from ..functions.text import without_default_diacritics
from .spans import overlap_join, overlap_share


def detection_score(docs: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, score): macro-F1 over characters of the labels present in either side.

    Spans are intervals, so agreement per label is summed overlap, not a row per character;
    spans of one side do not overlap each other.
    """
    size = docs.select("doc_id", F.length("text").alias("size"))
    lengths = lambda s, n: s.groupBy("doc_id", "label").agg(F.sum(F.col("end") - F.col("start")).alias(n))
    both = overlap_join(gold, found).select(F.col("a.doc_id").alias("doc_id"), F.col("a.label").alias("g"), F.col("b.label").alias("p"), (F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("n"))
    tp = both.where("g = p").groupBy("doc_id", F.col("g").alias("label")).agg(F.sum("n").alias("tp"))
    any_overlap = both.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    g, p = lengths(gold, "gold"), lengths(found, "found")
    named = g.join(p, ["doc_id", "label"], "full").join(tp, ["doc_id", "label"], "left").na.fill(0)
    sums = named.groupBy("doc_id").agg(F.sum("gold").alias("all_gold"), F.sum("found").alias("all_found"))
    outside = size.join(sums, "doc_id").join(any_overlap, "doc_id", "left").na.fill(0)
    outside = outside.select("doc_id", F.lit("").alias("label"), (F.col("size") - F.col("all_gold")).alias("gold"), (F.col("size") - F.col("all_found")).alias("found"), (F.col("size") - F.col("all_gold") - F.col("all_found") + F.col("shared")).alias("tp")).where("gold > 0 or found > 0")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("gold") + F.col("found"))).otherwise(0.0)
    scored = named.unionByName(outside).groupBy("doc_id").agg(F.avg(f1).alias("f1"))
    has = lambda s, n: s.select("doc_id").distinct().withColumn(n, F.lit(True))
    j = size.join(has(gold, "g"), "doc_id", "left").join(has(found, "p"), "doc_id", "left").join(scored, "doc_id", "left")
    score = F.when(F.col("g").isNull() & F.col("p").isNull(), 1.0).when(F.col("g").isNull() | F.col("p").isNull(), 0.0).otherwise(F.col("f1"))
    return j.select("doc_id", F.round(score, 6).alias("score"))


def accuracy(judged: DataFrame, truth: str, guess: str, constant) -> DataFrame:
    """Rows, accuracy, and the accuracy of always answering ``constant``."""
    return judged.agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(guess)).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col(truth) == constant).cast("int")), 6).alias("baseline"))


def verification_scores(judged: DataFrame) -> DataFrame:
    """One row: accuracy of (truth, status) where truth is Correct or not, its baseline, and what was marked verified."""
    right, verified = F.col("truth") == "Correct", F.col("status") == "VERIFIED"
    return judged.agg(
        F.count("*").alias("n"), F.round(F.avg((right == verified).cast("int")), 6).alias("accuracy"), F.round(F.avg(right.cast("int")), 6).alias("baseline"),
        F.count_if(~right & verified).alias("wrong_verified"), F.count_if(~right).alias("wrong"), F.count_if(right & verified).alias("right_verified"), F.count_if(right).alias("right"),
    )


def correction_scores(proposed: DataFrame, database: DataFrame) -> DataFrame:
    """One row: share of corrections (proposed, reference) that are right, and that of always naming no source.

    A proposal is right if it equals the reference, or holds it and is itself a text of ``database`` (text); both
    without default marks.  The database is met by an equi-join.
    """
    plain = lambda c: without_default_diacritics(F.col(c))
    p = proposed.select(plain("proposed").alias("p"), plain("reference").alias("r"))
    j = p.join(database.select(plain("text").alias("p")).distinct().withColumn("held", F.lit(True)), "p", "left")
    right = (F.col("p") == F.col("r")) | (F.contains("p", "r") & F.coalesce("held", F.lit(False)))
    return j.agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("r") == NO_SOURCE).cast("int")), 6).alias("baseline"))


def best_found(cases: DataFrame, found: DataFrame, key: str = "case", least: float = 0.0) -> DataFrame:
    """``cases`` with the span of ``found`` (case, start, end, ...) that covers most of each case's (start, end)."""
    share = overlap_share(F.struct("b.start", "b.end"), F.struct("a.start", "a.end"))
    body = F.struct(*(F.col(f"b.{c}") for c in found.columns if c != key))
    j = cases.alias("a").join(found.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), F.round(share, 6).alias("share"), body.alias("best"))
    # the most covered one, the first of equals
    best = j.where(F.col("share") >= least).groupBy(key).agg(F.max_by(F.struct("share", "best"), F.struct("share", (-F.col("best.start")).alias("first"))).alias("f"))
    return cases.join(best.select(key, "f.share", "f.best"), key, "left")


def stress_table(cases: DataFrame, found: DataFrame, plain) -> DataFrame:
    """Per kind of case: number, found, right type, expected outcome, flagged, exactly mended, falsely verified.

    ``cases`` as from ``synth.stress_suite``, ``found`` (case, start, end, label, status, correction); ``plain`` is the
    match form of a text column.
    """
    j = best_found(cases, found, least=0.6)
    status, expect = F.coalesce("best.status", F.lit("MISSED")), F.col("expect")
    ok = F.when(expect == "NOT_VERIFIED", status != "VERIFIED").otherwise(status == expect)
    mended = (status == "CORRECTED") & (plain(F.coalesce("best.correction", F.lit(""))) == plain(F.col("gold")))
    return j.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("best").isNotNull()).alias("found"), F.count_if(F.col("best.label") == F.col("label")).alias("typed"), F.count_if(ok).alias("ok"),
        F.count_if((expect == "CORRECTED") & status.isin("CORRECTED", "HUMAN_REVIEW", "UNSUPPORTED")).alias("flagged"), F.count_if((expect == "CORRECTED") & mended).alias("mended"),
        F.count_if((expect == "NOT_VERIFIED") & (status == "VERIFIED")).alias("false_verified"),
    )


def unannounced_recall(cases: DataFrame, found: DataFrame, backed: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: recall of quotations in plain prose, of those that a corpus holds, of changed ones, and false alarms.

    ``cases`` (case, changed, label, start, end), ``found`` (case, start, end, label), ``backed`` (case) those that verify
    or correct when shown their place, ``alarms`` spans found in prose without quotations.
    """
    hit = cases.join(found.select("case", F.col("label").alias("l"), F.col("start").alias("s"), F.col("end").alias("e")), "case").where((F.col("l") == F.col("label")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))).select("case").distinct()
    j = cases.join(hit.withColumn("hit", F.lit(True)), "case", "left").join(backed.select("case").distinct().withColumn("backed", F.lit(True)), "case", "left")
    hit_, backed_ = F.coalesce("hit", F.lit(False)), F.coalesce("backed", F.lit(False))
    rate = lambda part, all_: F.round(F.count_if(part & all_) / F.greatest(F.count_if(all_), F.lit(1)), 4)
    out = j.agg(
        F.count_if(~F.col("changed")).alias("tested"), rate(hit_, ~F.col("changed")).alias("recall"), F.count_if(~F.col("changed") & backed_).alias("backed_tested"), rate(hit_, ~F.col("changed") & backed_).alias("backed_recall"),
        F.count_if("changed").alias("changed_tested"), rate(hit_, F.col("changed")).alias("changed_recall"),
    )
    return out.join(F.broadcast(alarms.agg(F.count("*").alias("false_alarms"))))  # one row each


def training_rows(records: DataFrame, held_out: DataFrame, sources: list[str]) -> DataFrame:
    """Records (id, source, complete) of ``sources`` that are completely labelled and not held out (id)."""
    return records.where(F.col("source").isin(sources) & F.col("complete")).join(held_out.select("id"), "id", "left_anti")


def gated(spans: DataFrame, least: float = 0.60) -> DataFrame:
    """Spans detected with less confidence go to review; their correction becomes a suggestion."""
    low = F.coalesce(F.col("detection_confidence") < least, F.lit(False))
    return spans.withColumns({
        "status": F.when(low, F.lit("HUMAN_REVIEW")).otherwise(F.col("status")), "suggestion": F.when(low, F.coalesce("suggestion", "correction")).otherwise(F.col("suggestion")), "correction": F.when(~low, F.col("correction")),
    })


def error_class(message: Column) -> Column:
    """What a failed call to a model amounts to, from the text of its error."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike(r"quota|rate.?limit|429|neurons"), "quota").when(m.rlike(r"not found|deprecated|no longer|404|410"), "model_gone").when(m == "", F.lit(None)).otherwise("other")


def dataset_stats(spans: DataFrame) -> DataFrame:
    return spans.rollup("source", "label", "verdict").agg(F.count("*").alias("n"))
