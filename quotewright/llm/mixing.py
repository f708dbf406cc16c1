"""Mixing sources to target weights by temperature, as budgeted block permutations.

Source weights are token shares raised to an exponent and normalised.  The exponent is bisected, from
1 (as found) to 0 (uniform): the largest that reaches the target entropy, unless a source would then
be repeated more than the limit, which asks for the largest flattening within the limit.  A budget over
the limit times all tokens can not be met by any weights and is an error.  The sources stay a table: a
step of the search sums over it for ``GRID`` exponents at once.

A source's weight times the budget is its quota of tokens.  Its documents are dealt by a
hash into ``BLOCKS`` blocks of about equal size.  Whole passes take every document; the part of a
pass that is left takes blocks in an order permuted by a hash of the seed, source and pass, and of
the block that crosses the quota its documents in hash order.  Where in that block the quota ends is
found by sums over digits of the hash, so no task ranks a whole block.  A permuted pass so is cut where
the quota ends, within one document.

Null source is a source of its own; null text has no tokens.  Repeated rows are dealt alike.  A
source without tokens takes part in no pass.  Extra columns stay, whatever their names; an empty table
gives an empty result.  Tokens are runs of non-blank characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise

ENTROPY_SHARE, REPEATS, BLOCKS, SEED = 0.97, 4.0, 256, 17
#: Exponents tried at once, and steps: the exponent is exact to GRID ** -STEPS.
GRID, STEPS = 32, 7
#: Bits of the hash above those of the block, by digit; the rest orders documents.
DIGIT, DIGITS = 12, 3
NULL_SOURCE = "\x00"

#: For each exponent: (entropy of the weights, most repetitions of a source).
Measure = Callable[[list[float]], list[tuple[float, float]]]


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exponent(measure: Measure, sources: int, entropy_share: float, repeats: float) -> float:
    target = entropy_share * math.log(sources) if sources > 1 else 0.0
    entropy, repeated = measure([1.0])[0]
    if repeated > repeats * (1 + 1e-12):
        raise ValueError(f"the budget repeats all tokens {repeated:.3f} times, over the limit of {repeats}")
    if sources < 2:
        return 1.0

    def least(ok: Callable[[tuple[float, float]], bool]) -> float:
        """The least exponent where ``ok`` holds, as it does at 1 and from there on down to some point."""
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            grid = [lo + (hi - lo) * i / GRID for i in range(1, GRID)]
            good = [ok(m) for m in measure(grid)]
            k = good.index(True) if True in good else len(grid)
            lo, hi = ([lo, *grid][k], [*grid, hi][k])
        return hi

    alpha = 1.0 if entropy >= target else least(lambda m: m[0] < target)
    return alpha if measure([alpha])[0][1] <= repeats else least(lambda m: m[1] <= repeats)


def _moments(alpha: float, zero: float, one: float, most: float, ratio: float) -> tuple[float, float]:
    """(entropy, most repetitions) from the sums of p**a and p**a * log p, and the most of p**(a-1)."""
    return math.log(zero) - alpha * one / zero, ratio * most / zero


def temperature(tokens: dict, budget: float, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> tuple[float, dict]:
    """(exponent, weights) for a few token counts by source."""
    sources = {s: n for s, n in tokens.items() if n > 0}
    if not sources:
        return 1.0, {}
    total = sum(sources.values())
    shares = [n / total for n in sources.values()]

    def measure(alphas: list[float]) -> list[tuple[float, float]]:
        return [_moments(a, sum(p**a for p in shares), sum(p**a * math.log(p) for p in shares), max(p ** (a - 1) for p in shares), budget / total) for a in alphas]

    alpha = _exponent(measure, len(sources), entropy_share, repeats)
    norm = sum(p**alpha for p in shares)
    return alpha, {s: p**alpha / norm for s, p in zip(sources, shares, strict=True)}


def weights(sums: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, its tokens ``t`` and its ``quota`` from a table of (source, t); sources without tokens go."""
    sums = sums.where("t > 0")
    n, total = sums.agg(F.count("*"), F.sum("t")).first()
    if not n:
        return sums.withColumn("quota", F.lit(0.0))
    budget = budget or total
    p = F.col("t") / F.lit(float(total))

    def measure(alphas: list[float]) -> list[tuple[float, float]]:
        parts = [x for a in alphas for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1))))]
        got = sums.agg(*(x.alias(f"m{i}") for i, x in enumerate(parts))).first()
        return [_moments(a, *got[3 * i : 3 * i + 3], budget / total) for i, a in enumerate(alphas)]

    alpha = round(_exponent(measure, n, entropy_share, repeats), 9)  # sums may differ in their last bits
    norm = sums.agg(F.sum(F.pow(p, F.lit(alpha)))).first()[0]
    return sums.withColumn("quota", F.pow(p, F.lit(alpha)) / norm * F.lit(float(budget)))


def _taken(docs: DataFrame, budget: float | None, entropy_share: float, repeats: float, seed: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``tokens`` and ``copies`` of every document."""
    spot = F.xxhash64("doc_id", "text", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("source", F.lit(NULL_SOURCE)).alias("source"), word_count("text").alias("tokens"), spot.alias("spot"))
    rows = rows.withColumn("block", F.pmod("spot", F.lit(BLOCKS)).cast("int"))
    narrow = materialise(rows.select("source", "block", F.shiftright("spot", 8).alias("spot"), "tokens"), "mixing")
    blocks = materialise(narrow.groupBy("source", "block").agg(F.sum("tokens").alias("t")), "mixing-blocks")
    sums = materialise(blocks.groupBy("source").agg(F.sum("t").alias("t")), "mixing-sources")  # read at each step of the search
    quotas = materialise(weights(sums, budget, entropy_share, repeats), "mixing-quotas")
    per = blocks.join(quotas.withColumnRenamed("t", "whole"), "source").withColumns({"passes": F.floor(F.col("quota") / F.col("whole")).cast("int"), "rest": F.col("quota") % F.col("whole")})

    def rooms(parts: DataFrame, order: list) -> DataFrame:
        """``parts`` with the tokens still wanted (``room``) when each one's turn comes, and the tokens of the quota that fall in it."""
        before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn("room", F.col("rest") - F.coalesce(F.sum("t").over(before), F.lit(0)))

    crosses = (F.col("room") > 0) & (F.col("room") < F.col("t"))
    per = rooms(per, [F.xxhash64("source", "block", "passes", F.lit(seed)), "block"]).select("source", "block", "passes", "t", "room")
    per = materialise(per.withColumn("crossing", crosses), "mixing-blocks")
    # the crossing block of a source, then the digit that crosses inside it, and so on: a row a source
    inside = narrow.join(per.where("crossing").select("source", "block", F.col("room").alias("rest")), ["source", "block"]).drop("block")
    top = 54
    for _ in range(DIGITS):
        top -= DIGIT
        digit = F.shiftright("spot", top)
        sums = inside.groupBy("source", "rest", digit.alias("digit")).agg(F.sum("tokens").alias("t"))
        # where sums end exactly at the quota the part before is whole and the next takes nothing
        found = rooms(sums, ["digit"]).where((F.col("room") > 0) & (F.col("room") <= F.col("t"))).select("source", "digit", F.col("room").alias("more"))
        inside = materialise(inside.join(found, "source").where(digit == F.col("digit")).select("source", "spot", "tokens", F.col("more").alias("rest")), "mixing-digit")
    last = rooms(inside.groupBy("source", "rest", "spot").agg(F.sum("tokens").alias("t")), ["spot"]).where("room > 0").groupBy("source").agg(F.max("spot").alias("last"))
    per = per.drop("t").join(last, "source", "left")
    out = rows.join(per, ["source", "block"], "left")
    extra = F.when(F.col("crossing"), F.shiftright("spot", 8) <= F.col("last")).otherwise(F.col("room") > 0)
    return out.select("row", "tokens", F.coalesce(F.col("passes") + extra.cast("int"), F.lit(0)).alias("copies"))


def plan(docs: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_tokens`` and ``mix_copies``: how often each document is taken (0: not).

    A column of ``docs`` of such a name keeps it; the new one then ends in underscores.
    """
    tokens, copies = (free_name(docs.columns, c) for c in ("mix_tokens", "mix_copies"))
    return _taken(docs, budget, entropy_share, repeats, seed).select("row.*", F.col("tokens").alias(tokens), F.col("copies").alias(copies))


def mix(docs: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, seed: int = SEED) -> DataFrame:
    """``docs`` with each document as often as its source's quota asks."""
    taken = _taken(docs, budget, entropy_share, repeats, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
