"""Registered queries of the quotation flow over the shared tables.

The flat corpus is ``benchmark``; the sequenced one its sentences, section by item.  Texts to check are whole
``documents`` and cases made from the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import decide, detect, evaluate, index, report, scan, spans, synth
from ..storage import materialise
from . import verify
from .catalogue import GREEDY, NORM, SPANS, WORDS, _kept, _spans, query

SENTENCES = f"""sentences as (select item_id as section, pos, text, {NORM.format('text')} as norm, {WORDS.format(NORM.format('text'))} as words
    from (select item_id, i as pos, trim(s[i]) as text from (select item_id, s, unnest(range(1, len(s) + 1)) as i from (select item_id, string_split(text, '. ') as s from benchmark))) where length(trim(text)) > 0)"""


def _sentences(read) -> DataFrame:
    """(idx, section, pos, text): sentences of the benchmark's items in order."""
    s = read("benchmark").select(F.col("item_id").alias("section"), F.posexplode(F.split("text", r"\. ")).alias("i", "text"))
    s = s.select("section", (F.col("i") + 1).cast("long").alias("pos"), F.trim("text").alias("text")).where("length(text) > 0")
    return s.select((F.col("section") * 1000 + F.col("pos")).alias("idx"), "section", "pos", "text")


def _flat(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("idx"), F.col("item_id").alias("section"), F.lit(1).cast("long").alias("pos"), "text")


def _corpora(read) -> verify.Corpora:
    return verify.Corpora(verify.Corpus.build(_sentences(read), x.LATIN).settled(), verify.Corpus.build(_flat(read), x.LATIN).settled())


def _texts(read) -> DataFrame:
    return read("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# detection and scanning over whole documents


@query()
def scan_regions(read):
    """Unmarked quotations of both corpora in whole documents."""
    docs, corpora = _texts(read), _corpora(read)
    none = docs.limit(0).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"))
    return verify.scanned(docs, none, corpora).select("doc_id", "start", "end", "label")


@query()
def rule_labels(read):
    """Quoted segments of whole documents and of cases, with the label that coverage and trigger give."""
    corpora = _corpora(read)
    cases = synth.stress_suite(corpora.flat.records, "flat", _vocabulary(corpora.flat)).select(F.col("case").alias("doc_id"), "text")
    docs = _texts(read).select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(cases)
    return verify.ruled(docs, corpora).select("doc_id", "start", "end", "label")


_PLACED = r"""raw as (select doc_id, unnest(regexp_extract_all(text, '[^\s]+\s*')) as piece, generate_subscripts(regexp_extract_all(text, '[^\s]+\s*'), 1) as i from documents),
    tok as (select doc_id, row_number() over (partition by doc_id order by i) as i, word, stop from (select doc_id, i, replace(norm, ' ', '') as word, stop from (select doc_id, i, trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) as norm,
      regexp_matches(right(trim(piece), 2) || regexp_extract(piece, '\s*$'), '[.؟?!؛;:\n…]') as stop from raw) where norm <> '')),
    arr as (select doc_id, list(word order by i) as w, list(stop order by i) as b from tok group by doc_id)"""


@query(
    rf"""with {SENTENCES}, {_PLACED}, c as (select section, pos, words, words[1:3] as head from sentences where len(words) >= 4),
    p as (select doc_id, w, b, unnest(range(1, len(w) + 1)) as i from arr), m as (select doc_id, i, len(words) as n, section, pos from p join c on w[i:i + 2] = head and w[i:i + len(words) - 1] = words and not list_contains(b[i:i + len(words) - 2], true)),
    o as (select *, row_number() over (partition by doc_id order by i, -n, section, pos) as k from m),
    g as (with recursive r as (select doc_id, 0 as k, 0 as till, 0 as hits, 0 as places from (select distinct doc_id from o)
      union all select r.doc_id, r.k + 1, case when o.i > till then o.i + n - 1 else till end, case when o.i > till then hits + 1 else hits end, case when o.i > till then places + o.i else places end from r join o on o.doc_id = r.doc_id and o.k = r.k + 1)
      select doc_id, arg_max(hits, k) as hits, arg_max(places, k) as places from r group by doc_id)
    select doc_id, cast(hits as bigint) as n, cast(places as bigint) as places from g"""
)
def whole_records(read):
    """Sentences of the benchmark that stand whole in documents, without a stop inside: how many, and where."""
    c = index.normalised(_sentences(read), x.LATIN)
    none = _texts(read).limit(0).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"))
    # most documents hold no record's first words: only those that do are cut into tokens
    docs = _texts(read)
    words = docs.select("doc_id", x.LATIN.plain_forms(F.col("text")).alias("words"))
    at = words.select("doc_id", F.explode(scan.heads(F.col("words"), 4)).alias("h")).select("doc_id", "h.key")
    near = materialise(at.join(scan.record_heads(c).select("key"), "key", "left_semi").select("doc_id").distinct(), "near")
    t = verify.runs(docs.join(near, "doc_id", "left_semi"), none, x.LATIN).withColumn("doc_id", F.col("run.doc_id"))
    t = materialise(t.select("doc_id", "tokens", "words"), "runs")
    found = scan.whole_records(t.select("doc_id", "tokens", "words"), c)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("first") + 1).alias("places"))


@query(
    f"""with {SENTENCES}, q as (select section, pos as first, k from sentences, (select unnest([1, 2, 3]) as k))
    select q.section as section, q.first as first, q.k as k, md5(string_agg(norm, ' ' order by s.pos)) as cited from q join sentences s on s.section = q.section and s.pos between q.first and q.first + q.k - 1 group by q.section, q.first, q.k having count(*) = q.k"""
)
def evidence_lookup(read):
    """The cited text of every reference to one to three consecutive sentences; a reference past the end has none."""
    r = index.normalised(_sentences(read), x.LATIN)
    refs = r.select("section", F.col("pos").alias("first"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    return decide.passages(refs, r).select("section", "first", "k", F.md5("cited").alias("cited"))


COVER = f"""{SENTENCES}, claims as (select item_id as qid, list_distinct({WORDS.format(NORM.format('text'))}) as own from benchmark), seeds as (select section as qid, section, pos as seat from sentences where pos <= 5),
    starts as (select distinct qid, section, seat, unnest(range(seat - 2, seat + 1)) as first from seeds),
    a as (select st.*, s.words as w1 from starts st join sentences s on s.section = st.section and s.pos = st.first),
    b as (select a.*, s.words as w2 from a left join sentences s on s.section = a.section and s.pos = a.first + 1),
    c as (select b.*, s.words as w3 from b left join sentences s on s.section = b.section and s.pos = b.first + 2),
    d as (select c.*, own, w2 is not null and len(list_filter(list_intersect(own, w2), lambda w: length(w) >= 4)) > 0 as go2, w3 is not null and len(list_filter(list_intersect(own, w3), lambda w: length(w) >= 4)) > 0 as go3 from c join claims using (qid)),
    e as (select qid, greatest(case when seat <= first then len(list_intersect(own, w1)) else 0 end, case when go2 and seat <= first + 1 then len(list_intersect(own, w1 || w2)) else 0 end, case when go2 and go3 and seat <= first + 2 then len(list_intersect(own, w1 || w2 || w3)) else 0 end) / len(own) as cover from d)"""


@query(f"with {COVER} select qid, round(max(cover), 6) as cover from e group by qid")
def window_coverage(read):
    """How much of each item up to three consecutive sentences of it hold, around its first five."""
    r = index.normalised(_sentences(read), x.LATIN)
    claims = index.normalised(_flat(read), x.LATIN).select(F.col("idx").alias("qid"), "words")
    seeds = r.where("pos <= 5").select(F.col("section").alias("qid"), "idx")
    return detect.sequence_coverage(claims, seeds, r).select("qid", F.round("cover", 6).alias("cover"))


@query(
    f"""with {SENTENCES}, ask as (select section as qid, pos, norm from sentences where pos % 2 = 0 and norm <> ''), st as (select distinct qid, pos, unnest(range(pos - 3, pos + 1)) as first from ask),
    w as (select st.qid, st.pos, st.first, string_agg(s.norm, ' ' order by s.pos) as passage from st join sentences s on s.section = st.qid and s.pos between st.first and st.first + 4 join sentences f on f.section = st.qid and f.pos = st.first group by st.qid, st.pos, st.first)
    select distinct ask.qid as section, ask.pos as pos from ask join w on w.qid = ask.qid and w.pos = ask.pos where contains(passage, ask.norm)"""
)
def exact_passages(read):
    """Every second sentence, looked for in passages of up to five sentences around it."""
    r = index.normalised(_sentences(read), x.LATIN)
    ask = r.where("pos % 2 = 0 and norm <> ''")
    found = index.exact_passages(ask.select(F.col("idx").alias("qid"), "norm"), ask.select(F.col("idx").alias("qid"), "idx"), r)
    return found.join(ask.select(F.col("idx").alias("qid"), "section", "pos"), "qid").select("section", "pos")


# spans of models


@query(
    f"""with {SPANS}, {GREEDY}, m as (select s.*, string_split_regex(trim(substr(text, start + 1, "end" - start)), '\\s+') as w from s join documents d using (doc_id) where k % 2 = 1 and len(string_split_regex(trim(substr(text, start + 1, "end" - start)), '\\s+')) >= 3),
    f as (select * from kept where k % 2 = 0), free as (select m.doc_id, m.k, m.start, m."end", m.label from m where not exists (select 1 from f where f.doc_id = m.doc_id and f.start < m."end" and f."end" > m.start)),
    o as (select *, row_number() over (partition by doc_id order by start, "end", label) as n from free),
    walked as (with recursive w as (select doc_id, 0 as n, -1 as till, 0 as many, 0 as places from (select distinct doc_id from o)
      union all select w.doc_id, w.n + 1, case when o.start >= till then o."end" else till end, case when o.start >= till then many + 1 else many end, case when o.start >= till then places + o.start else places end from w join o on o.doc_id = w.doc_id and o.n = w.n + 1)
      select doc_id, arg_max(many, n) as many, arg_max(places, n) as places from w group by doc_id),
    b as (select doc_id, count(*) as n, sum(start) as places from f group by doc_id)
    select coalesce(b.doc_id, walked.doc_id) as doc_id, cast(coalesce(b.n, 0) as bigint) as found, cast(coalesce(many, 0) as bigint) as model, cast(coalesce(b.places, 0) + coalesce(walked.places, 0) as bigint) as places from b full join walked on walked.doc_id = b.doc_id"""
)
def model_gaps(read):
    """Model spans in the gaps of found ones: every second span is a model's, the others are found."""
    found = _kept(read).where("k % 2 = 0").select("doc_id", "start", "end", "label", F.lit(None).cast("string").alias("hint"), F.lit("rules").alias("source"))
    model = _spans(read).where("k % 2 = 1").select("doc_id", "label", "start", "end")
    both = spans.with_model_spans(found, model, read("documents"))
    return both.groupBy("doc_id").agg(F.count_if(F.col("source") == "rules").alias("found"), F.count_if(F.col("source") == "model").alias("model"), F.sum("start").alias("places"))


@query(f"with w as (select doc_id, len(regexp_extract_all(text, '[^\\s]+')) as n from documents) select doc_id, a as \"from\", least(a + 512, n) as \"to\" from (select doc_id, n, unnest(range(0, n, 256)) as a from w)")
def model_windows(read):
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return _texts(read).select("doc_id", F.explode(spans.padded_windows(n)).alias("w")).select("doc_id", "w.from", "w.to")


# synthesis and evaluation


def _vocabulary(corpus: verify.Corpus) -> DataFrame:
    return index.vocabulary(corpus.records).agg(F.array_sort(F.collect_set("word")).alias("vocab"))


@query()
def stress_suite(read):
    """All cases of both corpora; the invariant that offsets give the quotation is part of the result."""
    corpora = _corpora(read)
    both = [synth.stress_suite(c.records, kind, _vocabulary(c)) for kind, c in corpora.items()]
    cases = both[0].unionByName(both[1])
    return cases.groupBy("kind", "label", "expect").agg(F.count("*").alias("n"), F.min(F.col("end") - F.col("start")).alias("least"), F.max(F.length("text")).alias("most"))


@query()
def stress_table(read):
    """The whole flow over all cases: found, typed, right outcome, flagged, mended, falsely verified."""
    corpora = _corpora(read)
    cases = materialise(reduce_union([synth.stress_suite(c.records, kind, _vocabulary(c)) for kind, c in corpora.items()]), "cases")
    docs = cases.select(F.col("case").alias("doc_id"), "text")
    r = verify.document_report(docs, corpora)
    found = r.select(F.col("doc_id").alias("case"), F.explode("spans").alias("s")).select("case", "s.start", "s.end", "s.label", "s.status", "s.correction")
    return evaluate.stress_table(cases, found, x.latin)


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def unannounced_recall(read):
    """Recall of the items' sentences set into plain prose, whole and with a word changed; false alarms on plain carriers."""
    corpora = _corpora(read)
    quoted = corpora.sequence.records.select("idx", F.lit("Ayah").alias("label"), F.col("norm").alias("quote"))
    cases = materialise(synth.unannounced(quoted), "cases")
    found = verify.detected(cases.select(F.col("case").alias("doc_id"), "text"), corpora).withColumnRenamed("doc_id", "case")
    shown = cases.where("not changed").select(F.col("case").alias("qid"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))
    backed = verify.decided(shown, corpora.sequence, "sequence").where("status in ('VERIFIED', 'CORRECTED')").select(F.col("qid").alias("case"))
    prose = cases.select(F.lit(0).alias("n")).limit(1).select(F.explode(F.array(*(F.lit(c.replace("{}", "")) for c in synth.CARRIERS))).alias("text")).select(F.xxhash64("text").alias("doc_id"), "text")
    return evaluate.unannounced_recall(cases, found, backed, verify.detected(prose, corpora))


@query(
    f"""with {SENTENCES}, q as (select *, section * 1000 + pos as idx, lead(words) over (partition by section order by pos) as next, lead(pos) over (partition by section order by pos) as np from sentences),
    w as (select idx, case when (idx * 31 + 11) % 100 < 12 and np = pos + 1 then words || next else words end as w from q), v as (select *, (idx * 7919 + 11) % 100 as d, len(w) as n from w where len(w) >= 4)
    select idx, case when d < 50 then 'Correct' when d < 80 then 'Wrong' else 'Fabricated' end as verdict, ['quoted', 'bare', 'embedded'][(idx * 13 + 11) % 3 + 1] as mode, case when d < 50 then md5(array_to_string(w, ' ')) when d >= 80 then md5(array_to_string(list_transform(list_reverse(w), lambda y: reverse(y)), ' ')) end as quote from v"""
)
def made_quotes(read):
    """Quotations of sentences: right, corrupted or made up; a corrupted one's text is left to the tests."""
    made = synth.quotes(index.normalised(_sentences(read), x.LATIN))
    return made.select("idx", "verdict", "mode", F.when(F.col("verdict") != "Wrong", F.md5("quote")).alias("quote"))


@query()
def unified_dataset(read):
    """Documents with their spans and documents composed of made quotations; a span that its offsets do not give is an error."""
    real = _kept(read).join(read("documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", F.lit("Correct").alias("verdict"), F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("span")).alias("s"))
    real = real.groupBy("id").agg(F.lit("real").alias("source"), F.first("text").alias("text"), F.array_sort(F.collect_list("s")).alias("spans"))
    made = synth.composed(synth.quotes(index.normalised(_sentences(read), x.LATIN)), "Ayah")
    d = synth.unified(real, made)
    return d.select("id", "source", F.size("spans").alias("n_spans"), F.md5("text").alias("text"))


# decisions, reports


@query(
    """with g as (select item_id, unnest([0.3, 0.5, 0.9])::double as strength, unnest([0.6, 0.76, 0.9])::double as confidence from benchmark),
    d as (select *, item_id % 2 = 0 as ok, item_id % 3 = 0 as exact, item_id % 6 as n, item_id % 4 as mm, item_id % 5 = 0 as border from g), e as (select *, ok or (exact and n >= 4) as good, exact and n >= 4 as et from d),
    r as (select *, case when good and not et and not exact and mm >= 1 then 'HUMAN_REVIEW/hadith_altered' when good and et then 'VERIFIED/exact_match' when good and not border and confidence >= 0.75 then 'VERIFIED/close_match' when good then 'HUMAN_REVIEW/weak_match'
      when strength < 0.45 and (strength < 0.35 or (confidence >= 0.7 and not border)) then 'UNSUPPORTED/no_source' when strength < 0.45 then 'HUMAN_REVIEW/insufficient_evidence' else 'HUMAN_REVIEW/hadith_candidate' end as r from e)
    select item_id, strength, string_split(r, '/')[1] as status, string_split(r, '/')[2] as code from r"""
)
def decide_flat_table(read):
    """The flat decision table over a grid of its inputs."""
    g = read("benchmark").select("item_id", F.explode(F.arrays_zip(F.array(*map(F.lit, (0.3, 0.5, 0.9))).alias("strength"), F.array(*map(F.lit, (0.6, 0.76, 0.9))).alias("confidence"))).alias("z")).select("item_id", "z.strength", "z.confidence")
    i = F.col("item_id")
    g = g.withColumns({"verdict": F.when(i % 2 == 0, "Correct").otherwise("Incorrect"), "exact": i % 3 == 0, "n_tokens": i % 6, "mismatches": i % 4, "method": F.when(i % 5 == 0, "borderline_default").otherwise("threshold_pass")})
    return decide.decide_flat(g).select("item_id", "strength", "status", "code")


@query(
    """with g as (select item_id, item_id % 3 as a, item_id % 4 as b from benchmark), d as (select *, case when a = 0 then null when a = 1 then 'one two' else 'two three' end as shown, case when b = 0 then null else 'zero one two' end as cited,
      ['VERIFIED', 'CORRECTED', 'HUMAN_REVIEW'][item_id % 3 + 1] as status from g), e as (select *, cited is null as missing, shown is not null and not coalesce(contains(cited, shown), false) as bad from d)
    select item_id, case when missing or bad then 'removed' else 'verified' end as grounding, case when missing or (bad and status <> 'HUMAN_REVIEW') then 'HUMAN_REVIEW' else status end as status, case when missing or (bad and status <> 'HUMAN_REVIEW') then 'ungrounded' else 'c' end as code,
      case when not missing then 'e' end as evidence, case when not missing and not bad then shown end as correction from e"""
)
def grounding(read):
    """Proposals that do not stand in the cited source, and evidence whose source is missing."""
    i = F.col("item_id")
    g = read("benchmark").select("item_id", F.when(i % 3 == 1, "one two").when(i % 3 == 2, "two three").alias("correction"), F.when(i % 4 != 0, "zero one two").alias("cited"), F.element_at(F.array(*map(F.lit, ("VERIFIED", "CORRECTED", "HUMAN_REVIEW"))), (i % 3 + 1).cast("int")).alias("status"), F.lit("e").alias("evidence"), F.lit("c").alias("code"))
    g = g.withColumns({"shown_correction": F.col("correction"), "shown_suggestion": F.lit(None).cast("string"), "suggestion": F.lit(None).cast("string")})
    return decide.ground(g).select("item_id", "grounding", "status", "code", "evidence", "correction")


@query(f"""with {SPANS} select doc_id, count(*) as n_spans, count(*) filter (status = 'VERIFIED') as "right", count(*) filter (status in ('CORRECTED', 'UNSUPPORTED')) as wrong, count(*) filter (status = 'HUMAN_REVIEW') as open from s group by doc_id""")
def summary_tiles(read):
    s = _spans(read)
    return report.tiles(report.summary(s.select("doc_id").distinct(), s))


@query(f"with {SENTENCES} select section, pos, case when pos % 3 = 0 then 'record ' || section when pos % 3 = 1 then section || ' ' || pos else section || ' ' || pos || '–' || (pos + 1) end as label from sentences")
def source_labels(read):
    place = F.when(F.col("pos") % 3 != 0, F.col("section"))
    last = F.when(F.col("pos") % 3 == 2, F.col("pos") + 1).otherwise(F.col("pos"))
    return _sentences(read).select("section", "pos", report.source_label(place, F.col("pos"), last, F.col("section")).alias("label"))


@query("""select doc_id, quality, toxic, case when toxic = 1 then 'HUMAN_REVIEW' else 'CORRECTED' end as status, case when toxic = 1 then 'fix' end as suggestion, case when toxic = 0 then 'fix' end as correction from labels""")
def confidence_gate(read):
    s = read("labels").withColumns({"detection_confidence": F.when(F.col("toxic") == 1, 0.4).otherwise(0.9), "status": F.lit("CORRECTED"), "correction": F.lit("fix"), "suggestion": F.lit(None).cast("string")})
    return evaluate.gated(s).select("doc_id", "quality", "toxic", "status", "suggestion", "correction")


@query("select d.doc_id as id, source from documents d where source in ('src1', 'src2') and exists (select 1 from labels l where l.doc_id = d.doc_id) and not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)")
def training_rows(read):
    r = read("documents").join(read("labels").select("doc_id").distinct().withColumn("complete", F.lit(True)), "doc_id", "left").select(F.col("doc_id").alias("id"), "source", F.coalesce("complete", F.lit(False)).alias("complete"))
    held = read("labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return evaluate.training_rows(r, held, ["src1", "src2"]).select("id", "source")


@query(
    """with p as (select l.doc_id, d.text as proposed, case when l.quality = 1 then d.text when l.toxic = 1 then left(d.text, 40) else 'xyz' || d.text end as reference from labels l join documents d using (doc_id))
    select count(*) as n, round(avg(case when proposed = reference or (contains(proposed, reference) and proposed in (select text from documents)) then 1 else 0 end), 6) as accuracy, round(avg(case when reference = 'خطأ' then 1 else 0 end), 6) as baseline from p"""
)
def correction_scores(read):
    """Proposals that equal the reference, or hold it and are texts of the database."""
    p = read("labels").join(read("documents").select("doc_id", "text"), "doc_id")
    p = p.select(F.col("text").alias("proposed"), F.when(F.col("quality") == 1, F.col("text")).when(F.col("toxic") == 1, F.substring("text", 1, 40)).otherwise(F.concat(F.lit("xyz"), "text")).alias("reference"))
    return evaluate.correction_scores(p, read("documents").select("text"))


@query("select count(*) as n, round(avg(((l.quality = 1) = (l.toxic = 0))::int), 6) as accuracy, round(avg((l.quality = 1)::int), 6) as baseline, count(*) filter (quality <> 1 and toxic = 0) as wrong_verified, count(*) filter (quality <> 1) as wrong, count(*) filter (quality = 1 and toxic = 0) as right_verified, count(*) filter (quality = 1) as \"right\" from labels l")
def verification_scores(read):
    j = read("labels").select(F.when(F.col("quality") == 1, "Correct").otherwise("Incorrect").alias("truth"), F.when(F.col("toxic") == 0, "VERIFIED").otherwise("UNSUPPORTED").alias("status"))
    return evaluate.verification_scores(j)


@query(
    """select conv_id, turn, case when regexp_matches(lower(text), 'quota|rate.?limit|429|neurons') then 'quota' when regexp_matches(lower(text), 'not found|deprecated|no longer|404|410') then 'model_gone' when text is null or text = '' then null else 'other' end as kind from conversations"""
)
def error_classes(read):
    return read("conversations").select("conv_id", "turn", evaluate.error_class(F.col("text")).alias("kind"))


@query(
    """with s as (select item_id, min(item_id) over (partition by left(text, 1)) as first, left(text, 1) as title, text from benchmark)
    select title, item_id as rec_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) as norm from s"""
)
def flat_evidence(read):
    """The text of every (number, title), the first record of each."""
    r = index.normalised(_flat(read), x.LATIN).select("idx", F.col("idx").alias("rec_id"), F.substring("text", 1, 1).alias("title"), "norm")
    return index.by_title(r.unionByName(r.withColumns({"idx": F.col("idx") + 100_000, "norm": F.lit("a later one")}))).select("title", "rec_id", F.md5("norm").alias("norm"))


@query(
    f"""with {SPANS}, {GREEDY}, o as (select doc_id, start, "end", row_number() over (partition by doc_id order by start, "end") as k, status, label from kept)
    select doc_id, md5(string_agg(k || '. [' || status || '] ' || label || ' (' || start || '-' || "end" || ')', '\\n' order by k)) as value from o group by doc_id""".replace("'\\n'", "chr(10)")
)
def text_report(read):
    """Reports in plain lines, without the spans' own words."""
    s = _kept(read).withColumns({"span": F.lit(""), "message": F.lit("")})
    lines = report.text_report(s)
    return lines.select("doc_id", F.md5(F.regexp_replace("value", r": \n   ", "")).alias("value"))


@query(
    """with d as (select item_id, string_split(text, ' ') as w from benchmark), s as (select item_id, [{'op': 'equal', 'a': w[1], 'b': w[1]}, {'op': 'replace', 'a': w[2], 'b': w[3]}, {'op': 'insert', 'a': '', 'b': w[4]}, {'op': 'delete', 'a': w[5], 'b': ''}] as x from d),
    p as (select item_id as qid, unnest(['equal', 'extra', 'missing', 'missing', 'extra']) as kind, unnest([x[1].a, x[2].a, x[2].b, x[3].b, x[4].a]) as words, unnest([1, 2, 3, 4, 5]) as n from s)
    select qid, n, kind, words from p"""
)
def diff_segments(read):
    w = F.split("text", " ")
    step = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.alias("span"), b.alias("source"))
    d = F.array(step("equal", w[0], w[0]), step("replace", w[1], w[2]), step("insert", F.lit(""), w[3]), step("delete", w[4], F.lit("")))
    return report.diff_segments(read("benchmark").select(F.col("item_id").alias("qid"), d.alias("word_diff")))


@query("select item_id, cast(round(100 * coalesce(case when item_id % 3 = 0 then (item_id % 10) / 10 end, case when item_id % 3 = 1 then (item_id % 7) / 7 end, 0)) as bigint) as percent from benchmark")
def match_percent(read):
    i = F.col("item_id")
    return read("benchmark").select("item_id", report.match_percent(F.when(i % 3 == 0, i % 10 / 10), F.when(i % 3 == 1, i % 7 / 7)).alias("percent"))

