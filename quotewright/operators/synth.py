"""Synthetic cases: exact, partial, altered, spliced and made-up quotations in carriers, from arithmetic seeds.

Draws are a remainder of numbers in the row, never a random source, so every engine and every run agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("exact", "partial", "substituted", "dropped", "swapped", "embedded")


def altered(words: Column, kind: str, seed: Column) -> Column:
    """A record's words changed in the way of ``kind``; ``seed`` picks the place."""
    n = F.size(words)
    at = (F.pmod(seed, n - 2) + 1).cast("int")  # neither the first nor the last word
    head, tail = F.slice(words, 1, at), F.slice(words, at + 2, n)
    return {
        "exact": words, "embedded": words,
        "partial": F.slice(words, 1, F.greatest(F.lit(3), (n / 2).cast("int"))),
        "substituted": F.concat(head, F.array(F.reverse(F.get(words, at))), tail),
        "dropped": F.concat(head, tail),
        "swapped": F.concat(F.slice(words, 1, at - 1), F.array(F.get(words, at), F.get(words, at - 1)), tail),
    }[kind]


def stress_cases(c: DataFrame, seed: int = 7) -> DataFrame:
    """(idx, kind, text, start, end, expect): every kind from every record of six words or more."""
    base = c.where(F.size("words") >= 6)
    rows = []
    for kind in KINDS:
        quote = F.array_join(altered(F.col("words"), kind, F.col("idx") * 31 + seed), " ")
        lead = "it was said plainly that " if kind == "embedded" else 'he said: "'
        close = " and so on" if kind == "embedded" else '"'
        text = F.concat(F.lit(lead), quote, F.lit(close))
        expect = "CORRECTED" if kind in ("substituted", "dropped", "swapped") else "VERIFIED"
        rows.append(F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(len(lead)).alias("start"), (F.lit(len(lead)) + F.length(quote)).alias("end"), F.lit(expect).alias("expect")))
    return base.select("idx", F.explode(F.array(*rows)).alias("r")).select("idx", "r.*")


def spliced(c: DataFrame) -> DataFrame:
    """(idx, other, text): the first half of a record and the second half of the next one."""
    half = lambda w: (F.size(w) / 2).cast("int")
    a, b = c.select("idx", "words"), c.select((F.col("idx") - 1).alias("idx"), F.col("idx").alias("other"), F.col("words").alias("w2"))
    j = a.join(b, "idx")
    return j.select("idx", "other", F.array_join(F.concat(F.slice("words", 1, half("words")), F.slice("w2", half("w2") + 1, F.size("w2"))), " ").alias("text"))


#: kind -> (label, how the quotation is shown, what the pipeline should say)
STRESS = {
    "sequence_exact": ("Ayah", "quoted", "VERIFIED"), "sequence_plain": ("Ayah", "quoted", "VERIFIED"), "sequence_unmarked": ("Ayah", "bare", "VERIFIED"),
    "sequence_embedded": ("Ayah", "embedded", "VERIFIED"), "sequence_partial": ("Ayah", "quoted", "VERIFIED"), "sequence_substituted": ("Ayah", "quoted", "CORRECTED"),
    "sequence_dropped": ("Ayah", "quoted", "CORRECTED"), "sequence_swapped": ("Ayah", "quoted", "CORRECTED"), "sequence_fabricated": ("Ayah", "quoted", "NOT_VERIFIED"),
    "flat_exact": ("Hadith", "quoted", "VERIFIED"), "flat_plain": ("Hadith", "quoted", "VERIFIED"), "flat_unmarked": ("Hadith", "bare", "VERIFIED"),
    "flat_spliced": ("Hadith", "quoted", "NOT_VERIFIED"), "flat_fabricated": ("Hadith", "quoted", "NOT_VERIFIED"),
}
LEADS, CLOSES = ("he said plainly: ", "it stands written: ", "as we were told: "), (" and so on", " as is known", " so they say")


def wrapped(mode: str, quote: Column, seed: Column) -> tuple[Column, Column]:
    """(text, place of the quotation in it): in quotes after a lead, bare after a lead, or within a sentence."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(seed, F.lit(len(words))) + 1).cast("int"))
    lead, close = (F.lit("and to end with what follows "), F.lit(" and that is all")) if mode == "embedded" else (pick(LEADS), pick(CLOSES))
    mark = F.lit('"' if mode == "quoted" else "")
    return F.concat(lead, mark, quote, mark, close), F.length(lead) + F.length(mark)


def made_up(vocabulary: Column, seed: Column, n: Column) -> Column:
    """``n`` words of a vocabulary array in an order that no text has."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(vocabulary, (F.pmod(seed * 7919 + i * (seed + 104729), F.size(vocabulary)) + 1).cast("int")))


def stress_suite(records: DataFrame, kind: str, vocabulary: DataFrame, seed: int = 7) -> DataFrame:
    """(case, kind, label, text, start, end, expect, gold) of every case that a record allows.

    ``records`` (idx, text, words) of the ``kind`` of corpus, ``vocabulary`` one row with a sorted array ``vocab``.
    """
    least = 4 if kind == "sequence" else 8
    base = records.where(F.size("words") >= least).join(F.broadcast(vocabulary))  # one row
    n, s, plain = F.size("words"), F.col("idx") * 31 + seed, F.array_join("words", " ")
    cases: dict[str, tuple[Column, Column]] = {}  # kind -> (quotation, when it is possible)
    if kind == "sequence":
        at = F.pmod(s, F.greatest(n - 7, F.lit(1))).cast("int")
        for k in ("substituted", "dropped", "swapped"):
            changed = altered(F.col("words"), k, s)
            cases[f"sequence_{k}"] = (F.array_join(changed, " "), (n >= 5) & (changed != F.col("words")))
        cases |= {"sequence_exact": (F.trim("text"), F.lit(True)), "sequence_partial": (F.array_join(F.slice("words", at + 1, 6), " "), n >= 8)}
        cases |= {f"sequence_{k}": (plain, F.lit(True)) for k in ("plain", "unmarked", "embedded")}
    else:
        size = F.least(n, F.lit(7) + F.pmod(s, F.lit(18))).cast("int")
        part = F.slice("words", F.pmod(s, n - size + 1).cast("int") + 1, size)
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        written = F.when(F.size(words) == n, F.array_join(F.slice(words, F.pmod(s, n - size + 1).cast("int") + 1, size), " ")).otherwise(F.array_join(part, " "))
        half = (size / 2).cast("int")
        other = records.select((F.col("idx") - 1).alias("idx"), F.col("words").alias("other"))
        base = base.join(other, "idx", "left")
        spliced_ = F.array_join(F.concat(F.slice(part, 1, half), F.slice("other", 1, F.greatest(F.lit(4), half))), " ")
        cases = {"flat_exact": (written, F.lit(True)), "flat_plain": (F.array_join(part, " "), F.lit(True)), "flat_unmarked": (F.array_join(part, " "), F.lit(True)), "flat_spliced": (spliced_, F.col("other").isNotNull())}
    cases[f"{kind}_fabricated"] = (F.array_join(made_up(F.col("vocab"), s, F.lit(6 if kind == "sequence" else 8) + F.pmod(s, F.lit(5)).cast("int")), " "), F.size("vocab") > 0)
    rows = []
    for name, (quote, possible) in cases.items():
        label, mode, expect = STRESS[name]
        text, start = wrapped(mode, quote, s)
        gold = plain if expect == "CORRECTED" else F.lit(None).cast("string")
        row = F.struct(F.lit(name).alias("kind"), F.lit(label).alias("label"), text.alias("text"), start.alias("start"), (start + F.length(quote)).alias("end"), F.lit(expect).alias("expect"), gold.alias("gold"))
        rows.append(F.when(possible, row))
    spread = base.select("idx", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
    return spread.select(F.concat_ws(":", "idx", "r.kind").alias("case"), "r.*")


def quotes(records: DataFrame, seed: int = 11) -> DataFrame:
    """(idx, quote, verdict, mode): half right, three in ten corrupted, the rest made up; some over two records.

    ``records`` (idx, section, pos, text, words); the next record of the section may be added.
    """
    draw = F.pmod(F.col("idx") * 7919 + seed, F.lit(100))
    pairs = records.select("idx", "section", "pos", "words").join(records.select("section", (F.col("pos") - 1).alias("pos"), F.col("words").alias("next")), ["section", "pos"], "left")
    both = F.when((F.pmod(F.col("idx") * 31 + seed, F.lit(100)) < 12) & F.col("next").isNotNull(), F.concat("words", "next")).otherwise(F.col("words"))
    q = pairs.withColumn("w", both).where(F.size("w") >= 4)
    how = F.element_at(F.array(*map(F.lit, ("dropped", "swapped", "substituted"))), (F.pmod(F.col("idx"), F.lit(3)) + 1).cast("int"))
    corrupt = F.when(how == "dropped", altered(F.col("w"), "dropped", F.col("idx"))).when(how == "swapped", altered(F.col("w"), "swapped", F.col("idx"))).otherwise(altered(F.col("w"), "substituted", F.col("idx")))
    fake = F.transform(F.reverse("w"), lambda w: F.reverse(w))
    mode = F.element_at(F.array(*map(F.lit, ("quoted", "bare", "embedded"))), (F.pmod(F.col("idx") * 13 + seed, F.lit(3)) + 1).cast("int"))
    out = q.select("idx", F.when(draw < 50, F.col("w")).when(draw < 80, corrupt).otherwise(fake).alias("q"), F.when(draw < 50, "Correct").when(draw < 80, "Wrong").otherwise("Fabricated").alias("verdict"), mode.alias("mode"))
    return out.select("idx", F.array_join("q", " ").alias("quote"), "verdict", "mode")


def composed(made: DataFrame, label: str, per: int = 3) -> DataFrame:
    """(doc, text, spans): documents of ``per`` quotations each, with the place of each (start, end, label, verdict, span)."""
    parts = made.withColumns({m: F.struct(*(c.alias(n) for c, n in zip(wrapped(m, F.col("quote"), F.col("idx")), ("text", "at"), strict=True))) for m in ("quoted", "bare", "embedded")})
    parts = parts.withColumn("p", F.when(F.col("mode") == "quoted", F.col("quoted")).when(F.col("mode") == "bare", F.col("bare")).otherwise(F.col("embedded")))
    doc = F.floor(F.col("idx") / per)
    rows = parts.select(doc.alias("doc"), F.struct("idx", "p.text", "p.at", "quote", "verdict").alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,verdict:string,span:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.length(acc["text"]) + F.when(F.length(acc["text"]) > 0, 2).otherwise(0) + x["at"]
        span = F.struct(start.alias("start"), (start + F.length(x["quote"])).alias("end"), F.lit(label).alias("label"), x["verdict"].alias("verdict"), x["quote"].alias("span"))
        return F.struct(F.concat(acc["text"], F.when(F.length(acc["text"]) > 0, F.lit(". ")).otherwise(""), x["text"]).alias("text"), F.array_append(acc["spans"], span).alias("spans"))

    made_ = rows.select("doc", F.aggregate("x", F.struct(F.lit("").alias("text"), none.alias("spans")), step).alias("d"))
    return made_.select(F.concat(F.lit("synthetic-"), F.col("doc").cast("string")).alias("id"), F.lit("synthetic").alias("source"), "d.text", "d.spans")


def unified(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic documents (id, source, text, spans) as one table; a span that its offsets do not give is an error."""
    both = real.unionByName(synthetic, allowMissingColumns=True)
    wrong = F.exists("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) != s["span"])
    return both.withColumn("spans", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("span and offsets differ in "), F.col("id").cast("string")))).otherwise(F.col("spans")))


#: Sentences that a quotation is set into without a mark or an announcement.
CARRIERS = ("what is worth saying in this place {} and this is what we meant to show here", "people thought about it for long. {} then they went back to work", "the speaker says at the end {} and after that all went home")


def unannounced(quoted: DataFrame) -> DataFrame:
    """(case, changed, label, text, start, end): quotations (idx, label, quote) in plain prose, whole and with one word changed."""
    words = F.filter(F.split("quote", r"\s+"), lambda w: w != "")
    n = F.size(words)
    middle = (n / 2).cast("int")
    other = F.concat(F.slice(words, 1, middle), F.array(F.get(words, F.pmod(middle + 3, n))), F.slice(words, middle + 2, n))
    both = quoted.where(n >= 6).select("idx", "label", F.explode(F.filter(F.array(F.struct(F.lit(False).alias("changed"), F.trim("quote").alias("q")), F.when(n >= 8, F.struct(F.lit(True).alias("changed"), F.array_join(other, " ").alias("q")))), lambda x: x.isNotNull())).alias("x"))
    heads, tails = ([c.split("{}")[i] for c in CARRIERS] for i in (0, 1))
    pick = lambda parts: F.element_at(F.array(*map(F.lit, parts)), (F.pmod("idx", F.lit(len(parts))) + 1).cast("int"))
    start = F.length(pick(heads))
    return both.select(F.concat_ws(":", "idx", F.col("x.changed").cast("string")).alias("case"), "x.changed", "label", F.concat(pick(heads), F.col("x.q"), pick(tails)).alias("text"), start.alias("start"), (start + F.length("x.q")).alias("end"))
