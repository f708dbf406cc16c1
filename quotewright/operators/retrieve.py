"""Retrieval: BM25, vote F1, rank union, n-gram re-ranking.  Ties go by score, then record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import Profile, char_ngrams
from ..storage import materialise


def ranked(scored: DataFrame, k: int, score: str = "score", tie: str = "idx") -> DataFrame:
    """The best ``k`` per query by rounded score; the limit is pushed below the window's shuffle."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, profile: Profile) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(profile.content(F.col("words")))).alias("term"))


def bm25(terms: DataFrame, post: DataFrame, stats: DataFrame, idf: DataFrame, totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(qid, idx, score) of all records that share a term with a query."""
    k1, b = settings.k1, settings.b
    wanted = terms.join(idf.select("term", "idf"), "term")
    hits = wanted.join(post, "term").join(stats, "idx").join(F.broadcast(totals.select("avgdl")))  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "idx").agg(F.round(F.sum(part), 6).alias("score"))


def weights(post: DataFrame, stats: DataFrame, idf: DataFrame, totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(idx, term, weight): what a record gets of each query that has the term; for few queries over many records."""
    k1, b = settings.k1, settings.b
    held = post.join(idf.select("term", "idf"), "term").join(stats, "idx").join(F.broadcast(totals.select("avgdl")))  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return held.select("idx", "term", part.alias("weight"))


def by_weights(terms: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, idx, score) as by ``bm25``; the records' shuffle, by record, serves their sums too."""
    return held.join(terms, "term").groupBy("qid", "idx").agg(F.round(F.sum("weight"), 6).alias("score"))


def vote_f1(queries: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, idx, score): harmonic mean of covered query words and record words; repeats count."""
    words = queries.select("qid", F.size("words").alias("q_len"), F.explode("words").alias("word"))
    votes = words.join(index, "word").groupBy("qid", "q_len", "idx").agg(F.count("*").alias("v"))
    r = votes.join(sizes.select("idx", "n_words"), "idx")
    cover, precision = F.col("v") / F.col("q_len"), F.col("v") / F.greatest("n_words", F.lit(1))
    return r.select("qid", "idx", F.round(2 * cover * precision / (cover + precision), 6).alias("score"))


def idf_vote(queries: DataFrame, index: DataFrame, n_records: Column | int) -> DataFrame:
    """(qid, idx, score): sum of smoothed inverse frequencies of shared words."""
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log((F.lit(n_records) + 1) / (F.col("df") + 1)) + 1
    words = queries.select("qid", F.explode("words").alias("word")).join(df.select("word", weight.alias("w")).where("w > 0"), "word")
    return words.join(index, "word").groupBy("qid", "idx").agg(F.round(F.sum("w"), 6).alias("score"))


def rank_union(first: DataFrame, second: DataFrame, k: int, extra: int) -> DataFrame:
    """First list's best ``k``, then the second's best unseen ``extra``, in order."""
    a = first.where(F.col("rank") <= k).select("qid", "idx", "score", F.lit(0).alias("list"), "rank")
    unseen = second.join(a.select("qid", "idx"), ["qid", "idx"], "left_anti")
    w = Window.partitionBy("qid").orderBy("rank")
    b = unseen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= extra).select("qid", "idx", "score", F.lit(1).alias("list"), "rank")
    order = Window.partitionBy("qid").orderBy("list", "rank")
    return a.unionByName(b).withColumn("place", F.row_number().over(order)).drop("rank")


def set_cosine(a: Column, b: Column) -> Column:
    both = F.sqrt(F.size(a) * F.size(b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def ngram_rerank(pool: DataFrame, queries: DataFrame, c: DataFrame, k: int, n: int = 4) -> DataFrame:
    """The pool by cosine of character n-gram sets, ties by its own rank.

    The pool is written first, so that only its records are cut into n-grams and a small one meets them unshuffled.
    """
    pool = materialise(pool.select("qid", "idx", "rank"), "pool")
    grams = c.join(pool.select("idx"), "idx", "left_semi").select("idx", char_ngrams(F.col("norm"), n).alias("c_grams"))
    joined = pool.join(grams, "idx").join(queries.select("qid", char_ngrams(F.col("norm"), n).alias("q_grams")), "qid")
    scored = joined.select("qid", "idx", F.col("rank").alias("pool_rank"), F.round(set_cosine(F.col("q_grams"), F.col("c_grams")), 6).alias("score"))
    return ranked(scored, k, tie="pool_rank")
