"""The whole verification flow: detect, scan, retrieve, score, correct, align, decide, ground, report."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.kernels import align_udf, assimilate_udf, best_region_udf
from ..functions.text import Profile, light, offset_tokens, tokens, without_tatweel
from ..operators import decide, detect, index, report, retrieve, scan, score, spans
from ..storage import materialise

LABELS = {"sequence": "Ayah", "flat": "Hadith"}


@dataclass(frozen=True)
class Corpus:
    """Index tables of one corpus of records (idx, section, pos, text); ``names`` holds titles by record."""

    records: DataFrame
    postings: DataFrame
    stats: DataFrame
    totals: DataFrame
    terms: DataFrame
    words: DataFrame
    anchors: DataFrame
    profile: Profile
    weights: DataFrame | None = None  # (idx, term, weight) where the queries are few and known

    @classmethod
    def build(cls, records: DataFrame, profile: Profile, settings: Settings = Settings()) -> Corpus:
        """Index tables; a column ``extra`` of ``records`` holds more text whose other words are searched too."""
        c = index.normalised(records, profile)
        c = c.withColumn("keys", F.transform("words", profile.key))
        searched = c
        if "extra" in records.columns:
            more = index.extra_words(tokens(profile.normalise(F.col("extra"))), F.col("words"))
            searched = c.withColumn("words", F.concat("words", F.coalesce(more, F.array().cast("array<string>"))))
        post, stats = index.postings(searched, profile, settings), index.doc_stats(searched, profile)
        totals = index.corpus_stats(stats)
        return cls(c, post, stats, totals, index.term_stats(post, totals), index.word_index(c), index.capped(index.anchors(c, profile), settings), profile)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("records", "postings", "stats", "totals", "terms", "words", "anchors")}

    def on(self, found: dict[str, DataFrame]) -> Corpus:
        """This corpus on other tables of the same kind, such as a stored index."""
        return replace(self, **found)

    def settled(self) -> Corpus:
        """This corpus on tables that were written once, so that no step normalises the records anew."""
        return self.on({n: materialise(t, f"index-{n}") for n, t in self.tables().items()})


def retrieved(queries: DataFrame, corpus: Corpus, kind: str, settings: Settings = Settings(), most: int | None = None) -> DataFrame:
    """(qid, idx, rank, score) of the corpus's candidates for (qid, norm, words), ``most`` a query if given."""
    terms = retrieve.query_terms(queries, corpus.profile)
    if corpus.weights is None:
        found = retrieve.bm25(terms, corpus.postings, corpus.stats, corpus.terms, corpus.totals, settings)
    else:
        found = retrieve.by_weights(terms, corpus.weights)
    if kind == "flat":
        return retrieve.ngram_rerank(retrieve.ranked(found, 60), queries, corpus.records, most or settings.flat.top_k).select("qid", "idx", "rank", "score")
    k = most or settings.sequence.top_k
    votes = retrieve.ranked(retrieve.vote_f1(queries, corpus.words, corpus.records), k)
    both = retrieve.rank_union(votes, retrieve.ranked(found, settings.sequence.top_k), k, 0 if most else 10)
    return both.select("qid", "idx", F.col("place").alias("rank"), "score")


def _asked(claims: DataFrame, corpus: Corpus) -> DataFrame:
    return claims.withColumn("norm", corpus.profile.normalise(F.col("span"))).withColumn("words", tokens(F.col("norm")))


def scored(claims: DataFrame, corpus: Corpus, kind: str, settings: Settings = Settings()) -> DataFrame:
    """Signals of claims (qid, span) and the region of each candidate record that they would be compared with."""
    q = _asked(claims, corpus)
    # the candidates are written first, so that a small table of them meets the records unshuffled
    pairs = materialise(retrieved(q, corpus, kind, settings), "retrieved").join(corpus.records.select("idx", F.col("text").alias("record")), "idx")
    pairs = pairs.join(q.select("qid", "span", F.col("norm").alias("claim")), "qid")
    local = pairs.withColumn("part", best_region_udf(corpus.profile.name)("span", "record")).withColumn("source", corpus.profile.normalise(F.col("part")))
    if kind == "flat":
        return score.signals(local, kind).drop("part")
    # the sequenced corpus is compared with its marks too
    lit = local.withColumns({"light_claim": light(F.col("span"), nfc=True), "light_source": light(F.col("part"), nfc=True)})
    return score.signals(lit, kind, light_claim="light_claim", light_source="light_source").drop("part", "light_claim", "light_source")


def verified(claims: DataFrame, corpus: Corpus, kind: str, settings: Settings = Settings()) -> DataFrame:
    """Verdicts of claims (qid, span)."""
    best = claims.select("qid", "span").join(score.best_candidate(scored(claims, corpus, kind, settings)), "qid", "left").na.fill(0, ["n_candidates", "strong", "moderate"])
    return score.verdict(best, kind, settings)


def matched(claims: DataFrame, corpus: Corpus, kind: str, settings: Settings = Settings()) -> DataFrame:
    """(qid, section, first, k, strength, full_ratio, passage) of the passage that would correct each claim."""
    q, r = _asked(claims, corpus), corpus.records
    most = settings.sequence.top_k if kind == "sequence" else settings.correction.flat_top_k
    found = retrieve.bm25(retrieve.query_terms(q, corpus.profile), corpus.postings, corpus.stats, corpus.terms, corpus.totals, settings)
    seeds = retrieve.ranked(found, most).join(r.select("idx", "section", "pos"), "idx")
    if kind == "sequence":
        # only records around a seed are joined to passages; a passage need not hold its seed
        back = seeds.select("qid", "rank", "section", "pos", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("back")).withColumn("first", F.col("pos") - F.col("back"))
        places = back.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(settings.correction.window - 1)))).withColumn("pos", F.col("first") + F.col("at"))
        near = places.join(r.select("section", "pos", "norm"), ["section", "pos"]).groupBy("qid", "rank", "back", "section", "first").agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("r"))
        run = F.aggregate("r", F.lit(0), lambda n, x: F.when(x["at"] == n, n + 1).otherwise(n))
        spread = near.select("*", F.explode(F.when(run > 0, F.sequence(F.lit(1), run))).alias("k"))
        passage = F.array_join(F.transform(F.slice("r", 1, F.col("k")), lambda x: x["norm"]), " ")
        pairs = spread.select("qid", F.struct("rank", "back", "k").alias("order"), F.struct("section", F.col("first").cast("long").alias("first"), "k").alias("key"), passage.alias("passage"))
    else:
        pairs = seeds.join(r.select("idx", F.col("norm").alias("passage")), "idx").select("qid", F.struct("rank").alias("order"), F.struct("section", F.col("pos").cast("long").alias("first"), F.lit(1).alias("k")).alias("key"), "passage")
    best = decide.correct(pairs.join(q.select("qid", F.col("norm").alias("quote")), "qid"), both=kind == "flat")
    return best.select("qid", "key.section", "key.first", "key.k", "strength", "full_ratio", "passage")


def known_words(claims: DataFrame, corpus: Corpus) -> DataFrame:
    """(qid, known): the words of each claim that the corpus has; the vocabulary stays a table."""
    words = _asked(claims, corpus).select("qid", F.explode(F.array_distinct("words")).alias("word"))
    return words.join(index.vocabulary(corpus.records), "word", "left_semi").groupBy("qid").agg(F.collect_set("word").alias("known"))


DECIDED = ["qid", "span", "verdict", "confidence", "method", "status", "code", "grounding", "final_verdict", "evidence", "correction", "suggestion", "strength", "full_ratio", "word_similarity", "word_diff", "mismatches", "section", "first", "k"]


def decided(claims: DataFrame, corpus: Corpus, kind: str, settings: Settings = Settings()) -> DataFrame:
    """Status, code, evidence and proposal of claims (qid, span)."""
    q, r = _asked(claims, corpus), corpus.records
    v = materialise(verified(claims, corpus, kind, settings), "verdicts")
    match = materialise(matched(claims, corpus, kind, settings), "matches")
    whole = q.join(index.whole_map(r).select("norm", F.col("idx").alias("whole_idx")), "norm").select("qid", "whole_idx") if kind == "sequence" else q.select("qid", F.lit(None).cast("long").alias("whole_idx")).limit(0)
    j = v.join(match, "qid", "left").join(whole, "qid", "left").join(known_words(claims, corpus), "qid", "left")
    # one record or passage is the source of all that follows: the whole record, else the match, else the best candidate
    single = r.select(F.col("idx").alias("e"), F.col("section").alias("e_section"), F.col("pos").cast("long").alias("e_pos"))
    own = F.when(F.col("whole_idx").isNotNull(), F.col("whole_idx")).when(F.col("first").isNull(), F.col("best.idx"))
    j = j.withColumn("e", own).join(single, "e", "left")
    named = F.col("e_pos").isNotNull()
    j = materialise(j.withColumns({"section": F.when(named, F.col("e_section")).otherwise(F.col("section")), "first": F.when(named, F.col("e_pos")).otherwise(F.col("first")), "k": F.when(named, F.lit(1)).otherwise(F.col("k"))}).drop("e", "e_section", "e_pos"), "sources")
    # its text is looked up by its key, apart from what was matched
    j = j.join(decide.passages(j.where("first is not null"), r), ["section", "first", "k"], "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    j = j.withColumn("a", align_udf(corpus.profile.name)("span", F.coalesce("source_text", F.lit("")), known))
    j = j.select("*", "a.exact", "a.near", "a.word_similarity", "a.word_diff", "a.source_excerpt", "a.mismatches", "a.n_tokens").withColumn("whole", F.col("whole_idx").isNotNull())
    sure = {"verdict": F.lit("Correct"), "confidence": F.lit(0.98), "method": F.lit("whole_ayah")}
    j = j.withColumns({c: F.when(F.col("whole"), x).otherwise(F.col(c)) for c, x in sure.items()})
    d = decide.decide_sequence(j, settings) if kind == "sequence" else decide.decide_flat(j, settings)
    shown = without_tatweel(assimilate_udf("display")) if corpus.profile.name == "arabic" and kind == "sequence" else F.col("display")
    near_text = F.when(F.col("near") & (F.length("source_excerpt") > 0), F.col("source_excerpt")).otherwise(shown)
    d = d.withColumns({
        "evidence": F.when(F.col("status") != "UNSUPPORTED", F.col("source_text")),
        "correction": F.when(F.col("status") == "CORRECTED", near_text), "suggestion": F.when((F.col("status") == "HUMAN_REVIEW") & F.col("strength").isNotNull(), shown),
    })
    plain = lambda c: corpus.profile.normalise(F.regexp_replace(F.col(c), r"\(\d+\)", " "))
    d = d.withColumns({f"shown_{c}": F.when(F.col(c).isNotNull(), plain(c)) for c in ("correction", "suggestion")})
    d = decide.isolated(decide.ground(d), F.col("exact").isNull())
    return d.withColumn("final_verdict", F.when(F.col("status") == "VERIFIED", "Correct").otherwise("Incorrect")).select(DECIDED)


@dataclass(frozen=True)
class Corpora:
    """The sequenced and the flat corpus that texts are checked against; one may be absent."""

    sequence: Corpus | None = None
    flat: Corpus | None = None

    def items(self) -> list[tuple[str, Corpus]]:
        return [(k, c) for k, c in (("sequence", self.sequence), ("flat", self.flat)) if c is not None]

    @property
    def profile(self) -> Profile:
        return self.items()[0][1].profile

    @classmethod
    def of(cls, corpus: Corpus | Corpora, kind: str) -> Corpora:
        return corpus if isinstance(corpus, Corpora) else cls(**{kind: corpus})


def coverage(claims: DataFrame, corpora: Corpora, settings: Settings = Settings()) -> DataFrame:
    """(qid, cover, cover_flat) of claims (qid, span): how much of each the corpora hold."""
    out = claims.select("qid")
    for kind, corpus in corpora.items():
        q = _asked(claims, corpus)
        found = retrieved(q, corpus, kind, settings, 5)
        cover = detect.sequence_coverage(q, found, corpus.records) if kind == "sequence" else detect.flat_coverage(q, found, corpus.records)
        out = out.join(cover.withColumnRenamed("cover", "cover" if kind == "sequence" else "cover_flat"), "qid", "left")
    for c in ("cover", "cover_flat"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)) if c in out.columns else F.lit(0.0))
    return out


def ruled(docs: DataFrame, corpora: Corpora, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, end, label, hint): quoted spans, labelled by coverage and trigger, without overlap."""
    quoted = materialise(detect.candidates(docs, corpora.profile.normalise, settings).withColumn("qid", F.concat_ws("_", "doc_id", "start", "end")), "quoted")
    seen = coverage(quoted.select("qid", "span").dropDuplicates(["qid"]), corpora, settings)
    named = quoted.join(seen, "qid").withColumn("label", detect.label_of(F.col("trigger"), F.col("cover"), F.col("cover_flat"), F.col("n_words"), settings))
    found = named.where(F.col("label").isNotNull()).select("doc_id", "start", "end", "label", F.col("trigger").alias("hint"), "trigger", F.greatest("cover", "cover_flat").alias("coverage"))
    return detect.select(found).select("doc_id", "start", "end", "label", "hint")


def runs(docs: DataFrame, taken: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, tokens, words, keys): the runs of tokens of each text outside the spans ``taken``."""
    t = docs.select("doc_id", offset_tokens(F.col("text")).alias("tokens"))
    t = t.select("doc_id", F.zip_with("tokens", profile.forms(F.transform("tokens", lambda x: x["word"])), lambda x, w: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), x["boundary"].alias("boundary"), w.alias("form"))).alias("tokens"))
    t = t.select("doc_id", F.filter("tokens", lambda x: x["form"] != "").alias("tokens"))
    held = taken.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    cut = t.join(held, "doc_id", "left")
    none = F.array().cast(held.schema["taken"].dataType)
    parts = cut.select("doc_id", F.explode(spans.runs(F.col("tokens"), F.coalesce("taken", none))).alias("tokens"))
    words = parts.select("doc_id", F.transform("tokens", lambda x: x.dropFields("form")).alias("tokens"), F.transform("tokens", lambda x: x["form"]).alias("words"))
    # a run has an id of its own for what follows
    return words.select(F.struct("doc_id", F.get("tokens", F.lit(0))["start"].alias("at")).alias("run"), "tokens", "words", profile.keys(F.col("words")).alias("keys"))


def scanned(docs: DataFrame, taken: DataFrame, corpora: Corpora, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, end, label): unmarked quotations outside ``taken``, by each corpus's own rule."""
    found = []
    r = materialise(runs(docs, taken, corpora.profile).withColumn("doc_id", F.to_json("run")).drop("run"), "runs")
    back = F.from_json("doc_id", F.schema_of_json(F.lit('{"doc_id": "", "at": 0}')))
    for kind, corpus in corpora.items():
        if kind == "sequence":
            got = scan.sequence_scan(r, corpus.records, corpus.anchors, corpus.terms, corpus.profile, settings.scan)
        else:
            # a window that shares too few blocks with every record can give no region, whatever its candidates
            shared = materialise(scan.shared_blocks(r, corpus.records, settings.scan), "shared")
            windows = materialise(scan.flat_windows(r, corpus.profile, settings.scan, shared), "windows")
            best = retrieve.ranked(retrieve.bm25(retrieve.query_terms(windows, corpus.profile), corpus.postings, corpus.stats, corpus.terms, corpus.totals, settings), 3)
            got = scan.flat_scan(windows, best, corpus.records, corpus.terms, settings.scan)
        found.append(got.select(back["doc_id"].cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "start", "end", F.lit(LABELS[kind]).alias("label")))
    return reduce(DataFrame.unionByName, found)


def detected(docs: DataFrame, corpora: Corpora, settings: Settings = Settings(), model: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, label, hint, span, source): quoted spans, scanned ones in the gaps, longest first, then a model's.

    ``model`` holds entity pieces (doc_id, entity, entity_group, start, end, score).
    """
    rules = materialise(ruled(docs, corpora, settings), "rules")
    free = spans.without_overlap(scanned(docs, rules, corpora, settings), rules)
    free = spans.non_overlapping(free, [F.col("start") - F.col("end"), F.col("start"), F.col("label")])
    found = rules.withColumn("source", F.lit("rules")).unionByName(free.withColumns({"hint": F.lit(None).cast("string"), "source": F.lit("scan")}))
    if model is not None:
        found = spans.with_model_spans(found, spans.entity_spans(model, settings), docs)
    cut = found.join(docs.select("doc_id", "text"), "doc_id")
    trimmed = cut.withColumn("at", detect.trim_span(F.col("text"), F.col("start"), F.col("end"))).withColumns({"start": F.col("at.start"), "end": F.col("at.end")})
    return trimmed.select("doc_id", "start", "end", "label", "hint", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"), "source")


def judged(found: DataFrame, corpora: Corpora, settings: Settings = Settings()) -> DataFrame:
    """Decisions of labelled spans (qid, span, label, hint, source), with notes of the other corpus."""
    known = {LABELS[kind]: (kind, corpus) for kind, corpus in corpora.items()}
    parts = []
    for label, (kind, corpus) in known.items():
        d = decided(found.where(F.col("label") == label).select("qid", "span"), corpus, kind, settings).drop("span")
        parts.append(materialise(d.withColumn("section", F.col("section").cast("string")), "decided"))
    d = found.join(reduce(DataFrame.unionByName, parts), "qid", "left")
    unknown = ~F.col("label").isin(sorted(known))
    d = d.withColumns({
        "status": F.when(unknown, F.lit("HUMAN_REVIEW")).otherwise(F.col("status")), "code": F.when(unknown, F.lit("unknown_type")).otherwise(F.col("code")),
        "final_verdict": F.coalesce("final_verdict", F.lit("Incorrect")), "n_words": F.size(tokens(corpora.profile.normalise(F.col("span")))),
    })
    whole = F.col("code") == "whole_ayah"
    d = materialise(decide.too_short(d, (F.col("source") == "rules") & ~whole, settings), "judged")
    open_ = d.where(F.col("status").isin("UNSUPPORTED", "HUMAN_REVIEW") & (F.col("code") != "too_short") & (F.col("n_words") >= settings.short_words))
    notes = []
    for label, (kind, corpus) in known.items():
        other = verified(open_.where(F.col("label") != label).select("qid", "span"), corpus, kind, settings)
        notes.append(other.where((F.col("verdict") == "Correct") & (F.col("method") == "substring_match")).select("qid", F.lit("is_ayah" if label == "Ayah" else "is_hadith").alias("note")))
    if len(known) > 1:
        d = d.join(reduce(DataFrame.unionByName, notes), "qid", "left")
    else:
        d = d.withColumn("note", F.lit(None).cast("string"))
    return d.withColumn("note", F.coalesce("note", decide.misattributed(F.col("label"), F.col("hint"), F.col("status"))))


SPAN = ["start", "end", "span", "label", "source", "status", "code", "message", "note", "evidence", "correction", "suggestion", "confidence", "word_similarity", "word_diff"]


def report_of(docs: DataFrame, found: DataFrame, corpora: Corpora, settings: Settings = Settings()) -> DataFrame:
    """One row a document from given spans (doc_id, start, end, label, hint, span, source)."""
    ok = docs.where(F.length("text") <= settings.max_chars)
    d = judged(found.withColumn("qid", F.concat_ws("_", "doc_id", "start")), corpora, settings)
    d = materialise(d.withColumn("message", report.message(F.col("code"), F.col("mismatches"))), "spans")
    per = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in SPAN if c != "word_diff"), F.to_json("word_diff").alias("word_diff")))).alias("spans"))
    out = docs.select("doc_id", "text").join(per, "doc_id", "left").join(report.summary(ok, d), "doc_id", "left")
    own = F.coalesce("spans", F.array().cast(per.schema["spans"].dataType))
    edits = F.transform(F.filter(own, lambda s: (s["status"] == "CORRECTED") & s["correction"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["correction"].alias("correction")))
    return out.withColumns({
        "corrected_text": report.apply_corrections(F.col("text"), edits), "final_text": report.flagged_text(F.col("text"), own),
        "error": F.when(F.length("text") > settings.max_chars, "too_long"),
    })


def document_report(docs: DataFrame, corpus: Corpus | Corpora, kind: str = "flat", settings: Settings = Settings(), model: DataFrame | None = None) -> DataFrame:
    """One row a document: spans with decisions, corrected text, counts.  Overlong texts are errors.

    Each step's rows are written once; what follows reads them, and plans stay small.
    """
    corpora = Corpora.of(corpus, kind)
    ok = docs.where(F.col("text").isNotNull() & (F.length("text") <= settings.max_chars))
    corpora = Corpora(**{k: c.settled() for k, c in corpora.items()})
    found = materialise(detected(ok, corpora, settings, model), "found")
    return report_of(docs, found, corpora, settings)


def verify_texts(spark, texts: list[str], corpora: Corpora, settings: Settings = Settings(), model: DataFrame | None = None) -> list[dict]:
    """Reports of a few texts, for interactive use."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict(recursive=True) for r in document_report(docs, corpora, settings=settings, model=model).orderBy("doc_id").collect()]


def needs(label: str, text: Column) -> Column:
    """Whether a text holds a trigger of ``label``, so that this corpus has to be at hand."""
    return F.coalesce(detect.announces(text, label), F.lit(False))
