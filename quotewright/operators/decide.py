"""Correction matches, decision tables, cross-check and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.kernels import best_window


def correct(pairs: DataFrame, both: bool = False) -> DataFrame:
    """(qid, key, strength, full_ratio, passage) of the best passage per query.

    ``pairs`` holds (qid, quote, order, key, passage); a query's passages are bounded by its
    retrieved seeds, so a group is small.  With ``both`` the strength is the lesser of the quote's and the
    passage's coverage, as a record that only holds the quote is no correction of it.
    """
    grouped = pairs.dropDuplicates(["qid", "key"]).groupBy("qid").agg(F.first("quote").alias("quote"), F.array_sort(F.collect_list(F.struct("order", "key", "passage"))).alias("p"))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for qid, quote, p in zip(b.qid, b.quote, b.p, strict=True):
                found = best_window(quote, [(x["key"], x["passage"]) for x in p], both)
                if found:
                    rows.append((qid, *found[:3], found[3]))
            yield pd.DataFrame(rows, columns=["qid", "key", "strength", "full_ratio", "passage"])

    kind = dict(pairs.dtypes)
    return grouped.mapInPandas(run, f"qid {kind['qid']}, key {kind['key']}, strength double, full_ratio double, passage string")


def status(code: str, name: str) -> Column:
    return F.struct(F.lit(name).alias("status"), F.lit(code).alias("code"))


def _unresolved(settings: Settings) -> Column:
    """Whether a weak or missing match amounts to no source."""
    weak = F.col("strength").isNull() | (F.col("strength") < settings.unsupported_strength)
    return weak | ((F.col("confidence") >= settings.unsupported_confidence) & ~F.col("method").startswith("borderline"))


def decide_sequence(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """status and code from verdict, match and alignment columns, first rule that holds."""
    c = settings.correction
    local = F.col("near") & (F.col("word_similarity") >= 0.75) & (F.length("source_excerpt") > 0)
    rule = (
        F.when(F.col("whole"), status("whole_ayah", "VERIFIED"))
        .when(F.col("exact") & (F.col("n_tokens") >= settings.exact_tokens), status("exact_match", "VERIFIED"))
        .when((F.col("strength") >= c.strong) & ((F.col("full_ratio") >= c.full_ratio) | local), status("altered_passage", "CORRECTED"))
        .when(F.col("verdict") == "Correct", status("weak_match", "HUMAN_REVIEW"))
        .when((F.col("strength").isNull() | (F.col("strength") < c.low)) & _unresolved(settings), status("no_source", "UNSUPPORTED"))
        .when(F.col("strength").isNull() | (F.col("strength") < c.low), status("insufficient_evidence", "HUMAN_REVIEW"))
        .otherwise(status("candidate_not_strong", "HUMAN_REVIEW"))
    )
    return df.withColumn("d", rule).select("*", "d.status", "d.code").drop("d")


def decide_flat(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    c = settings.correction
    exact_tokens = F.col("exact") & (F.col("n_tokens") >= settings.flat_exact_tokens)
    good = (F.col("verdict") == "Correct") | exact_tokens
    sure = ~F.col("method").startswith("borderline") & (F.col("confidence") >= settings.verified_confidence)
    low = F.col("strength").isNull() | (F.col("strength") < c.flat_low)
    rule = (
        F.when(good & ~exact_tokens & ~F.col("exact") & (F.col("mismatches") >= 1), status("hadith_altered", "HUMAN_REVIEW"))
        .when(good & exact_tokens, status("exact_match", "VERIFIED"))
        .when(good & sure, status("close_match", "VERIFIED"))
        .when(good, status("weak_match", "HUMAN_REVIEW"))
        .when(low & _unresolved(settings), status("no_source", "UNSUPPORTED"))
        .when(low, status("insufficient_evidence", "HUMAN_REVIEW"))
        .otherwise(status("hadith_candidate", "HUMAN_REVIEW"))
    )
    return df.withColumn("d", rule).select("*", "d.status", "d.code").drop("d")


def too_short(df: DataFrame, quoted: Column, settings: Settings = Settings()) -> DataFrame:
    """Quoted spans of under three words go to review without a proposal; what ``quoted`` leaves out stays."""
    short = quoted & (F.col("n_words") < settings.short_words)
    out = {"status": F.when(short, F.lit("HUMAN_REVIEW")).otherwise(F.col("status")), "code": F.when(short, F.lit("too_short")).otherwise(F.col("code"))}
    out |= {c: F.when(~short, F.col(c)) for c in ("correction", "suggestion") if c in df.columns}
    return df.withColumns(out)


def misattributed(label: Column, hint: Column, status: Column) -> Column:
    """Note for a verified span that was announced as the other kind."""
    own = F.when(label == "Ayah", F.lit("is_ayah")).otherwise(F.lit("is_hadith"))
    return F.when((status == "VERIFIED") & hint.isNotNull() & (hint != label), own)


def isolated(df: DataFrame, failed: Column) -> DataFrame:
    """Spans that could not be processed go to review and leave the others alone."""
    return df.withColumns({
        "status": F.when(failed, F.lit("HUMAN_REVIEW")).otherwise(F.col("status")), "code": F.when(failed, F.lit("internal_error")).otherwise(F.col("code")),
        **{c: F.when(~failed, F.col(c)) for c in ("evidence", "correction", "suggestion") if c in df.columns},
    })


def passages(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(section, first, k, cited, text) of references to ``k`` consecutive records; one that lacks a record has none.

    ``refs`` (section, first, k), ``records`` (section, pos, norm, text).
    """
    places = refs.select("section", "first", "k").distinct().withColumn("pos", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)))
    r = places.join(records.select("section", "pos", "norm", "text"), ["section", "pos"]).groupBy("section", "first", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "text"))).alias("r"))
    whole = r.where(F.size("r") == F.col("k"))
    numbered = lambda x: F.when(F.col("k") > 1, F.format_string("%s (%d)", x["text"], x["pos"].cast("long"))).otherwise(x["text"])
    return whole.select(
        "section", "first", "k", F.array_join(F.transform("r", lambda x: x["norm"]), " ").alias("cited"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("source_text"),
        F.array_join(F.transform("r", numbered), " ").alias("display"),
    )


def ground(df: DataFrame) -> DataFrame:
    """What is shown must stand in the cited source; else it goes and the status falls.

    Columns: cited (normalised source text, null if it cannot be found), shown_correction and
    shown_suggestion (normalised), correction, suggestion, status, code.
    """
    missing = F.col("evidence").isNotNull() & F.col("cited").isNull()
    bad = F.lit(False)
    for c in ("shown_correction", "shown_suggestion"):
        bad = bad | (F.col(c).isNotNull() & ~F.coalesce(F.contains("cited", c), F.lit(False)))
    lower = bad & F.col("status").isin("CORRECTED", "VERIFIED")
    out = df.withColumns({
        "grounding": F.when(missing | bad, F.lit("removed")).otherwise(F.lit("verified")),
        "status": F.when(missing | lower, F.lit("HUMAN_REVIEW")).otherwise(F.col("status")),
        "code": F.when(missing | lower, F.lit("ungrounded")).otherwise(F.col("code")),
        "evidence": F.when(~missing, F.col("evidence")),
        "correction": F.when(~missing & ~bad, F.col("correction")),
        "suggestion": F.when(~missing & ~bad, F.col("suggestion")),
    })
    return out.withColumn("final_verdict", F.when(F.col("status") == "VERIFIED", "Correct").otherwise("Incorrect"))
