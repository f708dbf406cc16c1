"""Similarity signals, composite score and the verdict ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.kernels import common_words_udf
from ..functions.text import edit_similarity, jaccard

# Weights by corpus and by length of the claim (short: under four tokens).
WEIGHTS = {
    ("sequence", True): {"coverage": 0.35, "diacritic_sim": 0.30, "lcs_ratio": 0.15, "token_overlap": 0.10, "char_overlap": 0.05, "edit_sim": 0.05},
    ("sequence", False): {"coverage": 0.25, "diacritic_sim": 0.30, "lcs_ratio": 0.20, "token_overlap": 0.10, "char_overlap": 0.05, "edit_sim": 0.10},
    ("flat", True): {"coverage": 0.40, "lcs_ratio": 0.20, "token_overlap": 0.20, "char_overlap": 0.10, "edit_sim": 0.10},
    ("flat", False): {"coverage": 0.30, "lcs_ratio": 0.28, "token_overlap": 0.18, "char_overlap": 0.12, "edit_sim": 0.12},
}


def signals(df: DataFrame, kind: str, claim: str = "claim", source: str = "source", light_claim: str | None = None, light_source: str | None = None) -> DataFrame:
    """``df`` with the nine signals of normalised ``claim`` and ``source`` columns."""
    c, s = F.col(claim), F.col(source)
    words = df.withColumns({"_c": F.filter(F.split(c, " "), lambda w: w != ""), "_s": F.filter(F.split(s, " "), lambda w: w != "")})
    words = words.withColumns({"_cs": F.array_distinct("_c"), "_ss": F.array_distinct("_s"), "_cf": F.replace(c, F.lit(" "), F.lit("")), "_sf": F.replace(s, F.lit(" "), F.lit(""))})
    chars = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda y: y != ""))
    full = (F.size("_cs") > 0) & (F.size("_ss") > 0)
    edit = edit_similarity(c, s)
    part = words.withColumns({
        "token_overlap": F.when(full, jaccard(F.col("_cs"), F.col("_ss"))).otherwise(0.0),
        "coverage": F.when(full, F.size(F.array_intersect("_cs", "_ss")) / F.size("_cs")).otherwise(0.0),
        "lcs_ratio": F.when(F.size("_c") > 0, common_words_udf("_c", "_s") / F.size("_c")).otherwise(0.0),
        "edit_sim": edit,
        "diacritic_sim": edit_similarity(F.col(light_claim), F.col(light_source), 800) if light_claim else edit,
        "char_overlap": jaccard(chars(F.col("_cf")), chars(F.col("_sf"))),
        "is_substring": ((F.length("_cf") > 0) & (F.length("_sf") > 0) & (F.contains("_sf", "_cf") | F.contains("_cf", "_sf"))).cast("int"),
        "source_fraction": F.least(F.lit(1.0), F.size("_c") / F.greatest(F.size("_s"), F.lit(1))),
    })

    def weighted(short: bool) -> Column:
        return sum((w * F.col(n) for n, w in WEIGHTS[kind, short].items()), F.lit(0.0))

    raw = F.when(F.size("_c") < 4, weighted(True)).otherwise(weighted(False))
    floor = F.when(F.col("diacritic_sim") >= 0.60, 0.88).otherwise(0.75) if kind == "sequence" else F.lit(0.82)
    part = part.withColumn("composite", F.when(F.col("is_substring") == 1, F.greatest(raw, floor)).otherwise(raw))
    names = ("token_overlap", "coverage", "lcs_ratio", "edit_sim", "diacritic_sim", "char_overlap", "source_fraction", "composite")
    return part.withColumns({n: F.round(n, 4) for n in names}).drop("_c", "_s", "_cs", "_ss", "_cf", "_sf")


def best_candidate(scored: DataFrame) -> DataFrame:
    """Per query: candidates, strong and moderate ones, top retrieval, and the first best composite."""
    top = F.struct(F.col("composite").alias("o"), (-F.col("rank")).alias("r"))
    picked = F.struct("idx", "composite", "coverage", "is_substring")
    return scored.groupBy("qid").agg(
        F.count("*").alias("n_candidates"),
        F.count_if((F.col("rank") <= 10) & (F.col("coverage") >= 0.80) & (F.col("lcs_ratio") >= 0.75)).alias("strong"),
        F.count_if((F.col("rank") <= 8) & (F.col("coverage") >= 0.65) & (F.col("lcs_ratio") >= 0.55)).alias("moderate"),
        F.max("score").alias("retrieval_top"),
        F.max_by(F.when(F.col("composite") > 0, picked), top).alias("best"),
    )


def verdict(best: DataFrame, kind: str, settings: Settings = Settings()) -> DataFrame:
    """verdict, confidence and method by the ladder of the corpus, top down."""
    cfg = settings.sequence if kind == "sequence" else settings.flat
    s, cover = F.coalesce("best.composite", F.lit(0.0)), F.coalesce("best.coverage", F.lit(0.0))
    sub, top = F.coalesce("best.is_substring", F.lit(0)) == 1, F.coalesce("retrieval_top", F.lit(0.0))
    out = lambda v, c, m: F.struct(F.lit(v).alias("verdict"), F.round(c, 4).alias("confidence"), F.lit(m).alias("method"))
    cap = lambda most, base, slope, x: F.least(F.lit(most), base + slope * x)
    passed = (s >= cfg.correct) & (cover >= cfg.least_coverage)
    if kind == "sequence":
        ladder = (
            F.when(F.col("n_candidates") == 0, out("Incorrect", F.lit(0.80), "no_candidates"))
            .when(sub & (cover >= cfg.least_coverage), out("Correct", cap(0.98, 0.85, 0.15, s), "substring_match"))
            .when(passed, out("Correct", cap(0.95, 0.70, 0.25, s), "threshold_pass"))
            .when(s <= cfg.uncertain, out("Incorrect", cap(0.95, 0.70, 0.25, 1 - s), "threshold_fail"))
            .when(F.col("strong") >= 2, out("Correct", 0.60 + F.least(F.lit(0.20), 0.05 * F.col("strong")), "borderline_multi_cov"))
            .otherwise(out("Incorrect", F.lit(0.58), "borderline_default"))
        )
    else:
        ladder = (
            F.when(F.col("n_candidates") == 0, out("Incorrect", F.lit(0.75), "no_candidates"))
            .when(sub & (cover >= cfg.least_coverage) & (top >= cfg.guard), out("Correct", cap(0.97, 0.80, 0.17, s), "substring_match"))
            .when(passed, out("Correct", cap(0.92, 0.65, 0.27, s), "threshold_pass"))
            .when(s <= cfg.uncertain, out("Incorrect", cap(0.90, 0.65, 0.25, 1 - s), "threshold_fail"))
            .when((F.col("moderate") >= 2) & (top >= 0.30), out("Correct", 0.58 + F.least(F.lit(0.22), 0.06 * F.col("moderate")), "borderline_multi_cov"))
            .when((top < 0.25) | (s < 0.45), out("Incorrect", F.lit(0.60), "borderline_low_retrieval"))
            .otherwise(out("Incorrect", F.lit(0.55), "borderline_default"))
        )
    return best.withColumn("v", ladder).select("*", "v.verdict", "v.confidence", "v.method").drop("v")
