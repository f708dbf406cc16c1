"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets word, symbol, line and repetition counts from built-in functions only.  Each
(language, source) region builds one KLL sketch per metric over its documents that pass the
base rule; sketches of a language's regions merge into the language's sketch, and those of all languages
into one.  A region's thresholds come from its own sketch's tail quantiles and median, drawn towards its
language's by ``PRIOR`` documents' worth of weight, and the language's towards the whole's likewise; so
small regions lean on larger ones by degrees, without a switch, and no constant bounds a threshold.  The
upper fence is the tail quantile plus ``REACH`` of its distance from the median, the lower one alike.  A
join brings the fences to the documents; ``failed`` names the metrics that lie beyond theirs.

Null text counts as no text; null ``lang`` or ``source`` is a region of its own (``""``).  Where no
document passes the base rule there are no fences: the base rule alone decides.  Repeated rows are
judged one by one; a null id is one more row; extra columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANK = r"[\x20\x09-\x0D]+"
#: metric -> (reject below the lower fence, reject above the upper one)
METRICS = {
    "mean_word_chars": (True, True),
    "symbols_per_word": (False, True),
    "dup_line_share": (False, True),
    "repeat_share": (False, True),
}
SKETCH_K = 4096
#: The tail that a fence starts from, how far it reaches beyond, and the weight of the wider region in documents.
TAIL, REACH, PRIOR = 0.01, 0.5, 100.0
#: A value this near a fence counts as on it, which is inside.
EPSILON = 1e-9


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array."""

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            last = F.size(s) - 1
            return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))

        return _once(pairs, lambda s: F.size(F.array_distinct(F.flatten(F.transform(repeated(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        _once(grams(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))

    def measures(w: Column) -> Column:
        lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _once(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    words = F.filter(F.split("text", BLANK), lambda x: x != "")
    m = base.select("doc_id", "lang", "source", _once(words, measures).alias("m"))
    return m.select(
        "doc_id", "lang", "source", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").cast("long").alias("n_dup_lines"),
        "m.n_repeat_words", F.col("m.lines.n").cast("long").alias("n_lines"),
    )


def fences(judged: DataFrame, tail: float = TAIL, k: int = SKETCH_K, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """lang, source and for each metric its lower and upper fence (null: none)."""
    ok = ~F.col("base_failed")
    per = judged.groupBy("lang", "source").agg(
        F.count_if(ok).alias("n"), *(F.kll_sketch_agg_double(F.when(ok, F.col(m)), F.lit(k)).alias(f"s_{m}") for m in METRICS)
    )
    by_lang = per.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n_of"), *(F.kll_merge_agg_double(f"s_{m}", F.lit(k)).alias(f"l_{m}") for m in METRICS))
    whole = by_lang.agg(F.sum("n_of").alias("n_all"), *(F.kll_merge_agg_double(f"l_{m}", F.lit(k)).alias(f"a_{m}") for m in METRICS))
    both = per.join(by_lang, F.col("lang") == F.col("of")).join(F.broadcast(whole)).where("n_all > 0")  # one row
    points = F.array(*map(F.lit, (tail, 0.5, 1 - tail)))

    def drawn(n: str, own: Column, wider: Column) -> Column:
        """Quantiles of ``n`` documents' sketch, drawn towards the wider region's."""
        quantiles = F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(own, points))
        return F.when(F.col(n) > 0, F.zip_with(quantiles, wider, lambda x, y: (F.col(n) * x + prior * y) / (F.col(n) + prior))).otherwise(wider)

    q = {m: drawn("n", F.col(f"s_{m}"), drawn("n_of", F.col(f"l_{m}"), F.kll_sketch_get_quantile_double(f"a_{m}", points))) for m in METRICS}
    found = both.select("lang", "source", *(q[m].alias(m) for m in METRICS))
    out = []
    for m, (low, high) in METRICS.items():
        bottom, middle, top = (F.col(m)[i] for i in range(3))
        below, above = bottom - reach * (middle - bottom), top + reach * (top - middle)
        out += [(below if low else F.lit(None).cast("double")).alias(f"{m}_low"), (above if high else F.lit(None).cast("double")).alias(f"{m}_high")]
    return found.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *out)


def apply_rules(docs: DataFrame, tail: float = TAIL, k: int = SKETCH_K, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """Counts, ``base_failed``, ``failed`` and ``kept`` of every document, with its metrics and fences."""
    c = counts(docs)
    n = F.greatest("n_words", F.lit(1))
    judged = materialise(
        c.select(
            "*",
            ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
            (F.col("word_chars") / n).alias("mean_word_chars"),
            (F.col("n_symbols") / n).alias("symbols_per_word"),
            (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
            (F.col("n_repeat_words") / n).alias("repeat_share"),
        ),
        "quality-rules",
    )
    f = fences(judged, tail, k, reach, prior)
    joined = judged.join(f, (F.col("lang") == F.col("f_lang")) & (F.col("source") == F.col("f_source")), "left")
    outside = [(F.col(m) < F.col(f"{m}_low") - EPSILON) | (F.col(m) > F.col(f"{m}_high") + EPSILON) for m in METRICS]
    failed = F.filter(F.array(*(F.when(F.coalesce(o, F.lit(False)), F.lit(m)) for m, o in zip(METRICS, outside, strict=True))), lambda x: x.isNotNull())
    return joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("f_lang", "f_source")
