"""Inverted index tables of a corpus: tokens, postings, statistics, anchors, record windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import Profile, anchor_keys, tokens
from ..storage import materialise


def normalised(corpus: DataFrame, profile: Profile) -> DataFrame:
    """corpus (idx, text, ...) with its match form, words and word count."""
    c = corpus.withColumn("norm", profile.normalise(F.col("text")))
    c = c.withColumn("words", tokens(F.col("norm")))
    return c.withColumn("n_words", F.size("words").cast("long"))


def extra_words(full: F.Column, kept: F.Column) -> F.Column:
    """Words of the whole record that its main text lacks, sorted, once each."""
    return F.array_sort(F.array_distinct(F.array_except(full, kept)))


def postings(c: DataFrame, profile: Profile, settings: Settings = Settings()) -> DataFrame:
    """(idx, term, tf) of content words, counted before any shuffle of records."""
    terms = c.select("idx", F.explode(profile.content(F.col("words"))).alias("term"))
    return terms.groupBy("idx", "term").agg(F.least(F.count("*"), F.lit(settings.tf_cap)).alias("tf"))


def doc_stats(c: DataFrame, profile: Profile) -> DataFrame:
    """(idx, dl); records without content words count, with length 0."""
    return c.select("idx", F.size(profile.content(F.col("words"))).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of records and mean length (1.0 for no records)."""
    return stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def term_stats(post: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    one = totals.select("n")
    return df.join(F.broadcast(one)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row


def asked(c: DataFrame, terms: DataFrame, profile: Profile, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, stats, totals, terms) for searches of ``terms`` (qid, term) alone, from one pass over the records.

    Postings hold no other terms; lengths and counts are of whole records.
    """
    cut = c.select("idx", profile.content(F.col("words")).alias("content"))
    # no content word is empty: the empty one stands for its record
    rows = cut.select("idx", F.size("content").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "content")).alias("term"))
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    held = materialise(rows.groupBy("idx", "dl", "term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi"), "asked")
    post = held.where("term <> ''").groupBy("idx", "term").agg(F.least(F.sum("n"), F.lit(settings.tf_cap)).alias("tf"))
    stats = held.where("term = ''").select("idx", F.explode(F.array_repeat("dl", F.col("n").cast("int"))).alias("dl"))
    totals = corpus_stats(stats)
    return post, stats, totals, materialise(term_stats(post, totals), "terms")


def word_index(c: DataFrame) -> DataFrame:
    return c.select("idx", F.explode(F.array_distinct("words")).alias("word"))


def vocabulary(c: DataFrame) -> DataFrame:
    return c.select(F.explode("words").alias("word")).distinct()


def whole_map(c: DataFrame) -> DataFrame:
    """(norm, idx): the first record of each match form of two words or more."""
    return c.where("n_words >= 2").groupBy("norm").agg(F.min("idx").alias("idx"))


def anchors(c: DataFrame, profile: Profile) -> DataFrame:
    """(h, idx, src_pos) of trigram and skip-gram keys over phonetic words."""
    keyed = c.select("idx", F.explode(anchor_keys(F.transform("words", profile.key))).alias("a"))
    return keyed.select(F.xxhash64("a.key").alias("h"), "idx", F.col("a.pos").alias("src_pos"))


def capped(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Anchors without those that stand in more than the cap; the counts are pre-aggregated."""
    rare = found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= settings.scan.posting_cap).select("h")
    return found.join(rare, "h")


def record_windows(c: DataFrame, most: int = 8) -> DataFrame:
    """(section, first, k, text): every ``k`` <= ``most`` consecutive records of a section, joined."""
    w = Window.partitionBy("section").orderBy("pos")
    ahead = c.withColumn("ahead", F.collect_list("norm").over(w.rowsBetween(0, most - 1)))
    spread = ahead.select("section", F.col("pos").alias("first"), "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("k"))
    return spread.select("section", "first", "k", F.array_join(F.slice("ahead", 1, F.col("k")), " ").alias("text"))


def by_title(records: DataFrame) -> DataFrame:
    """(rec_id, title, norm): the first record of each number and title, as evidence is cited."""
    first = records.groupBy("rec_id", "title").agg(F.min("idx").alias("idx"))
    return first.join(records.select("idx", "norm"), "idx").drop("idx")


def exact_passages(claims: DataFrame, seeds: DataFrame, records: DataFrame, back: int = 3, most: int = 5) -> DataFrame:
    """(qid): claims (qid, norm) that stand literally in one to ``most`` consecutive records around a seed (qid, idx)."""
    at = seeds.join(records.select("idx", "section", "pos"), "idx").select("qid", "section", F.explode(F.sequence(F.col("pos") - back, "pos")).alias("first")).distinct()
    places = at.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("pos", F.col("first") + F.col("at"))
    r = places.join(records.select("section", "pos", "norm"), ["section", "pos"]).groupBy("qid", "section", "first").agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("r"))
    run = F.aggregate("r", F.lit(0), lambda n, x: F.when(x["at"] == n, n + 1).otherwise(n))
    text = F.array_join(F.transform(F.slice("r", 1, run), lambda x: x["norm"]), " ")
    return r.where(run > 0).select("qid", text.alias("passage")).join(claims.select("qid", "norm"), "qid").where(F.contains("passage", "norm") & (F.length("norm") > 0)).select("qid").distinct()
