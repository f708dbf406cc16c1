"""Reports: summaries, corrected texts, highlights, task rows, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import NO_SOURCE
from ..functions.text import clean_field

STATUSES = ("VERIFIED", "CORRECTED", "UNSUPPORTED", "HUMAN_REVIEW")

# Messages by reason code; ``%s`` is the number of words that differ.
MESSAGES = {
    "whole_ayah": "The text equals a whole record.", "exact_match": "Every word agrees with the source.", "close_match": "The text agrees closely with the source.",
    "altered_passage": "%s words differ from the source.", "weak_match": "The agreement is too weak to settle.", "no_source": "No source supports the text.",
    "insufficient_evidence": "There is too little evidence.", "candidate_not_strong": "The candidate is not strong enough.", "hadith_altered": "%s words differ from the record.",
    "hadith_candidate": "A record may be the source.", "too_short": "The text is too short to settle.", "ungrounded": "The proposal is not in the cited source.",
    "internal_error": "The span could not be processed.", "unknown_type": "The kind of text is unknown.",
    "is_ayah": "The text stands in the sequenced corpus.", "is_hadith": "The text stands in the flat corpus.",
}


def message(code: Column, *values: Column) -> Column:
    """The message of a reason code with its parameters; an unknown code stands for itself."""
    plain = F.coalesce(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))[code], code)
    return F.replace(plain, F.lit("%s"), F.coalesce(values[0].cast("string"), F.lit("Some"))) if values else plain


def source_label(section: Column, first: Column, last: Column, rec_id: Column) -> Column:
    """``section first-last`` of a passage, or the number of a record where there is no section."""
    place = F.when(last != first, F.concat(first.cast("string"), F.lit("–"), last.cast("string"))).otherwise(first.cast("string"))
    return F.when(section.isNotNull(), F.concat_ws(" ", section.cast("string"), place)).otherwise(F.concat(F.lit("record "), rec_id.cast("string")))


def match_percent(word_similarity: Column, composite: Column) -> Column:
    """How far a span agrees with its evidence: by words if compared, else by signals, else 0."""
    return F.round(100 * F.coalesce(word_similarity, composite, F.lit(0.0))).cast("int")


def diff_segments(spans: DataFrame, key: str = "qid") -> DataFrame:
    """(qid, n, kind, words): what a comparison shows in order, words of the span before those of the source."""
    steps = spans.select(key, F.posexplode("word_diff").alias("at", "d"))
    shown = F.when(F.col("d.op") == "equal", F.array(F.struct(F.lit("equal").alias("kind"), F.col("d.span").alias("words")))).otherwise(
        F.filter(F.array(F.struct(F.lit("extra").alias("kind"), F.col("d.span").alias("words")), F.struct(F.lit("missing").alias("kind"), F.col("d.source").alias("words"))), lambda x: x["words"] != "")
    )
    parts = steps.select(key, F.struct("at").alias("at"), F.posexplode(shown).alias("i", "s"))
    return parts.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at", "i")).alias("n"), "s.kind", "s.words")


def tiles(summary: DataFrame) -> DataFrame:
    """Counts that a page shows: all, right, wrong (corrected or without source), and to be looked at."""
    return summary.select("doc_id", "n_spans", F.col("verified").alias("right"), (F.col("corrected") + F.col("unsupported")).alias("wrong"), F.col("human_review").alias("open"))


def text_report(found: DataFrame) -> DataFrame:
    """(doc_id, value): a report in plain lines; ``found`` (doc_id, start, end, span, label, status, message)."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    line = F.format_string("%d. [%s] %s (%s-%s): %s", F.col("k"), "status", "label", F.col("start").cast("string"), F.col("end").cast("string"), clean_field(F.col("span")))
    lines = found.withColumn("k", F.row_number().over(w)).select("doc_id", "k", F.concat_ws("\n   ", line, "message").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("value"))


def ordinal(spans: DataFrame) -> DataFrame:
    return spans.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")))


def summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a document: counts by type and status, and whether a person must look."""
    counts = spans.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.count_if(F.col("label") == "Ayah").alias("n_sequence"), F.count_if(F.col("label") == "Hadith").alias("n_flat"),
        *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES),
    )
    out = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    return out.withColumn("needs_human_review", F.col("human_review") > 0)


def status_rollup(spans: DataFrame) -> DataFrame:
    return spans.rollup("label", "status").agg(F.count("*").alias("n"))


def apply_corrections(text: Column, edits: Column) -> Column:
    """``text`` with edits (start, end, correction) set in from the right."""
    backwards = F.reverse(F.array_sort(edits))
    return F.aggregate(backwards, text, lambda acc, e: F.concat(F.substring(acc, 1, e["start"]), e["correction"], F.substring(acc, e["end"] + 1, F.length(acc))))


#: What stands behind a span that still needs attention.
FLAGS = {"UNSUPPORTED": " [no matching source]", "HUMAN_REVIEW": " [needs review]"}


def flagged_text(text: Column, spans: Column) -> Column:
    """``text`` with corrections set in, and a flag behind every other span that is not verified."""

    def edited(s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        flags = F.coalesce(*(F.when(s["status"] == k, F.lit(v)) for k, v in FLAGS.items()), F.lit(""))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["status"] == "CORRECTED", F.coalesce(s["correction"], own)).otherwise(F.concat(own, flags)).alias("correction"))

    return apply_corrections(text, F.transform(spans, edited))


def highlight_pieces(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, status): every text cut into spans and what lies between (null)."""
    w = Window.partitionBy("doc_id").orderBy("start")
    s = spans.select("doc_id", "start", "end", "status")
    gaps = s.withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0))).where("from < start").select("doc_id", F.col("from").alias("start"), F.col("start").alias("end"))
    last = docs.select("doc_id", F.length("text").alias("size")).join(s.groupBy("doc_id").agg(F.max("end").alias("start")), "doc_id", "left").select("doc_id", F.coalesce("start", F.lit(0)).alias("start"), F.col("size").alias("end")).where("start < end")
    rest = gaps.unionByName(last).withColumn("status", F.lit(None).cast("string"))
    return s.unionByName(rest)


def task_a(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(qid, start, end, type); a text without spans gives one row that says so."""
    j = docs.select("doc_id").join(spans.select("doc_id", "start", "end", "label"), "doc_id", "left")
    return j.select(F.col("doc_id").cast("string").alias("qid"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"), F.coalesce("label", F.lit("No_Spans")).alias("type"))


def task_b(spans: DataFrame) -> DataFrame:
    return ordinal(spans).select(F.concat_ws("_", "doc_id", "k").alias("qid"), F.when(F.col("status") == "VERIFIED", "Correct").otherwise("Incorrect").alias("verdict"))


def task_c(spans: DataFrame) -> DataFrame:
    wrong = spans.where("status <> 'VERIFIED'")
    text = F.when(F.col("status") == "CORRECTED", clean_field(F.col("correction"))).otherwise(F.lit(NO_SOURCE))
    return wrong.select(F.concat_ws("_", "doc_id", "start", "end").alias("qid"), text.alias("correction"))


def tsv_line(*columns: str) -> Column:
    return F.concat_ws("\t", *(clean_field(F.col(c).cast("string")) for c in columns)).alias("value")
