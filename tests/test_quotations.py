"""Detection, scanning, decisions, synthesis and evaluation on small texts."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quotewright.config import ScanSettings
from quotewright.functions import kernels as k
from quotewright.functions import text as x
from quotewright.operators import decide, detect, evaluate, index, report, retrieve, scan, spans, synth
from quotewright.plans import catalogue, quotations, verify
from quotewright.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["whole_records", "evidence_lookup", "window_coverage", "exact_passages", "model_gaps", "grounding", "decide_flat_table", "diff_segments", "text_report", "iou_match", "final_text", "norm_match", "norm_light"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_alefs_count_without_a_vocabulary():
    quote, source = "قال قتل الناس", "قال قاتل الناس"
    assert not k.align(quote, source)["exact"]
    assert not k.align(quote, source, {"قتل", "قاتل"})["exact"]  # a real word of the corpus
    known = k.align(quote, source, {"قال", "قاتل", "الناس"})
    assert known["exact"] and known["orthographic_variants"] == [{"word": "قتل", "source_word": "قاتل"}]


def test_steps_cover_both_texts():
    q, s = "a b X d e".split(), "z a b c d e f".split()
    got = k.steps(q, s, 10)
    assert [(t.kind, t.a, t.b, t.c - 10, t.d - 10) for t in got] == [("insert", 0, 0, 0, 1), ("equal", 0, 2, 1, 3), ("replace", 2, 3, 3, 4), ("equal", 3, 5, 4, 6), ("insert", 5, 5, 6, 7)]


def test_moved_words_at_an_edge_count():
    moved = k.align("beta gamma delta alpha", "alpha beta gamma delta", profile="latin")
    assert not moved["exact"] and moved["reordered"]
    assert k.align("beta gamma", "alpha beta gamma delta", profile="latin")["exact"]


def test_flat_strength_is_of_both_sides():
    long = "alpha beta gamma " + "other words " * 40
    assert k.best_window("alpha beta gamma", [("long", long), ("near", "alpha beta gamme")], both=True)[0] == "near"
    assert k.best_window("alpha beta gamma", [("long", long), ("near", "alpha beta gamme")])[0] == "long"


def test_edit_similarity_equals_the_builtin(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("flaw", "lawn"), ("a" * 30 + "b", "a" * 31)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(x.edit_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in rows] == [round(k.edit_similarity(*p), 9) for p in pairs]


def test_growth_takes_the_upper_median_and_crosses_no_stop():
    own, source = "p a b c d e f g".split(), "a b c d e f g".split()
    # diagonals of source less own places: -1, -1, 0, 0; the upper median is 0, where nothing is equal
    assert scan.grow([(1, 0), (2, 1), (3, 3), (4, 4)], own, source, [False] * 8)[2] == 0
    assert scan.grow([(2, 1)], own, source, [False, False, False, False, True, False, False, False]) == (1, 5, 1)


def test_acceptance_is_judged_with_soft_edges():
    cfg = ScanSettings()
    words = "one two three four fivx".split()
    idf = dict.fromkeys([*words, "five"], 3.0)
    found = scan.regions_of(words, words, [False] * 5, {7: [(0, 0), (1, 1)]}, {7: "one two three four five".split()}, idf, cfg)
    assert found == [(0, 5, 7, 4, 0.8, 12.0)]  # with four words alone the weight would be under 14


def test_flat_regions():
    cfg = ScanSettings()
    words = "x alpha beta gamma delta epsilon zeta y".split()
    idf = dict.fromkeys(words, 3.0)
    assert scan.flat_region(words, words, [(1, "alpha beta".split()), (2, "alpha beta gamma delta epsilon zeta".split())], idf, cfg) == (1, 7, 2, 6, 1.0, 18.0)
    assert scan.flat_region(words, words, [(2, "alpha beta gamma other epsilon zeta".split())], idf, cfg) is None


def test_adjacent_records_merge(spark):
    records = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 4)], "idx long, section long, pos long")
    found = spark.createDataFrame([(9, 0, 10, 1, 4, 1.0, 9.0, 0, 4), (9, 11, 20, 2, 3, 0.75, 9.0, 4, 8), (9, 30, 40, 3, 4, 1.0, 9.0, 12, 16)], "doc_id long, " + scan.REGION)
    got = sorted((r.start, r.end, r.first_pos, r.last_pos, r.matched, r.ratio) for r in scan.merge_regions(found, records).collect())
    assert got == [(0, 20, 1, 2, 7, 0.875), (30, 40, 4, 4, 4, 1.0)]


def test_labels_by_coverage_and_trigger(spark):
    rows = [(None, 0.6, 0.1, 5, "Ayah"), (None, 0.1, 0.8, 5, "Hadith"), ("Hadith", 0.8, 0.9, 5, "Hadith"), ("Hadith", 0.95, 0.8, 5, "Hadith"), ("Hadith", 1.0, 0.7, 5, "Ayah"), (None, 0.9, 0.8, 5, "Ayah"), ("Ayah", 0.0, 0.0, 5, "Ayah"), (None, 0.9, 0.9, 3, None), (None, 0.3, 0.3, 9, None)]
    df = spark.createDataFrame(rows, "t string, a double, b double, n int, expected string")
    got = df.select(detect.label_of(F.col("t"), F.col("a"), F.col("b"), F.col("n")).alias("l"), "expected").collect()
    assert [r.l for r in got] == [r.expected for r in got]


def test_segments():
    assert detect.segments('a "b" c "d" e') == [(3, 4), (9, 10)]
    assert detect.segments('a "b" c "d') == [(3, 4), (5, 8)]
    assert detect.segments("no «x\ny» (z)") == [(4, 7), (10, 11)]


def test_model_spans_fill_gaps_from_the_left(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 5, "Ayah", None, "rules")], "doc_id long, start int, end int, label string, hint string, source string")
    model = spark.createDataFrame([(1, "Hadith", 3, 14), (1, "Hadith", 6, 14), (1, "Hadith", 9, 20), (1, "Ayah", 15, 99), (1, "Ayah", 18, 23)], "doc_id long, label string, start int, end int")
    assert sorted((r.start, r.end, r.source) for r in spans.with_model_spans(found, model, docs).collect()) == [(0, 5, "rules"), (6, 14, "model")]


def test_token_labels_round_trip(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd", [(0, 5, "Ayah"), (6, 8, "Hadith")])], "doc_id long, text string, s array<struct<start:int,end:int,label:string>>")
    t = df.select("doc_id", x.offset_tokens(F.col("text")).alias("tokens"), spans.char_labels(F.col("s"), F.length("text")).alias("chars"))
    labelled = t.select("doc_id", "tokens", spans.token_labels(F.col("chars"), F.col("tokens")).alias("labels"))
    assert labelled.first().labels == ["B-Ayah", "I-Ayah", "B-Hadith", "O"]
    assert sorted((r.label, r.start, r.end) for r in spans.spans_of_labels(labelled).collect()) == [("Ayah", 0, 5), ("Hadith", 6, 8)]


def test_a_missing_record_is_no_citation(spark):
    records = spark.createDataFrame([(1, 1, "a b", "A b"), (1, 2, "c", "C"), (1, 4, "d", "D")], "section long, pos long, norm string, text string")
    refs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1)], "section long, first long, k int")
    assert [(r.first, r.k, r.cited, r.display) for r in decide.passages(refs, records).collect()] == [(1, 2, "a b c", "A b (1) C (2)")]


def test_one_bad_span_is_isolated(spark):
    df = spark.createDataFrame([("x", "VERIFIED", "exact_match", "e"), ("y", "VERIFIED", "exact_match", "e")], "qid string, status string, code string, evidence string")
    got = [tuple(r) for r in decide.isolated(df, F.col("qid") == "y").collect()]
    assert got == [("x", "VERIFIED", "exact_match", "e"), ("y", "HUMAN_REVIEW", "internal_error", None)]


def test_stress_cases_hold_their_quotation(spark):
    corpora = quotations._corpora(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
    kinds = set()
    for kind, c in corpora.items():
        rows = synth.stress_suite(c.records, kind, quotations._vocabulary(c)).collect()
        kinds |= {r.kind for r in rows}
        for r in rows:
            mode = synth.STRESS[r.kind][1]
            assert 0 < r.start < r.end < len(r.text) and (mode != "quoted" or (r.text[r.start - 1], r.text[r.end]) == ('"', '"'))
    assert kinds == set(synth.STRESS)


def test_report_over_two_corpora(spark):
    first = "seven quiet rivers carry copper lanterns beyond the northern valley"
    second = "every autumn evening the painted boats return with amber and salt"
    flat = "an old merchant once counted his silver coins under the walnut tree at midnight"
    seq = spark.createDataFrame([(1, 1, 1, first), (2, 1, 2, second), (3, 2, 1, "nothing to see in this short line of words")], "idx long, section long, pos long, text string")
    rec = spark.createDataFrame([(1, 1, 1, flat), (2, 2, 1, "another record that nobody ever quotes in any of the texts here")], "idx long, section long, pos long, text string")
    corpora = verify.Corpora(verify.Corpus.build(seq, x.LATIN), verify.Corpus.build(rec, x.LATIN))
    docs = spark.createDataFrame(
        [(1, f'he said: "{first}" and went'), (2, f'he said: "{first.replace("copper", "golden")}" and went'), (3, f'he said: "{flat}" and went'), (4, f"it is told that {flat} as we know"), (5, "plain words of no corpus at all stand here, and nothing else is said"), (6, None), (7, f'"{first} {second}"')],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in verify.document_report(docs, corpora).collect()}
    got = {i: [(s.label, s.source, s.status, s.code) for s in r.spans or []] for i, r in rows.items()}
    assert got[1] == [("Ayah", "rules", "VERIFIED", "whole_ayah")] and got[2] == [("Ayah", "rules", "CORRECTED", "altered_passage")]
    assert got[3] == [("Hadith", "rules", "VERIFIED", "exact_match")] and got[5] == [] and got[6] == []
    assert got[7] == [("Ayah", "rules", "VERIFIED", "exact_match")]
    assert rows[2].corrected_text == docs.where("doc_id = 1").first().text and rows[2].final_text == rows[2].corrected_text
    assert rows[5].corrected_text == rows[5].text


def test_reports_and_stores(spark, tmp_path):
    found = spark.createDataFrame([(1, 4, 9, "b c", "Ayah", "VERIFIED", "fine"), (1, 0, 3, "a", "Hadith", "CORRECTED", "two")], "doc_id long, start int, end int, span string, label string, status string, message string")
    files.write_text_report(found, f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").count() == 4
    files.write_evaluation({"one": spark.range(2), "two": spark.createDataFrame([(1, 0.5)], "n int, f double")}, f"{tmp_path}/eval")
    assert json.loads(spark.read.text(f"{tmp_path}/eval").first().value) == {"one": [{"id": 0}, {"id": 1}], "two": [{"n": 1, "f": 0.5}]}
    made = []

    def build(n):
        made.append(n)
        return spark.createDataFrame([("synthetic", i) for i in range(n)], "source string, i int")

    for n in (2, 2, 3):
        assert files.unified_dataset(spark, f"{tmp_path}/data", "source string, i int", n, lambda n=n: build(n)).count() == n
    assert made == [2, 3]
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    one = files.signature(spark, [f"{tmp_path}/a.json"])
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.signature(spark, [f"{tmp_path}/a.json"]) != one
    assert files.examples(spark, f"{tmp_path}/none.json", "a int").count() == 0 and files.examples(spark, f"{tmp_path}/a.json", "a int").count() == 2
    assert files.warm({"t": spark.range(3)}) == {"t": 3}
    (tmp_path / "c.json").write_text('[{"idx": 0, "section": 1, "pos": 1, "text": "copper lanterns on the river"}]')
    files.build_index(spark, f"{tmp_path}/c.json", f"{tmp_path}/index", "idx long, section long, pos long, text string", "latin")
    assert files.load_index(spark, f"{tmp_path}/index", ["records", "anchors"])["anchors"].count() == 7


def test_unified_rows_keep_their_offsets(spark):
    bad = spark.createDataFrame([("a", "real", "some text", [(0, 4, "Ayah", "Correct", "text")])], "id string, source string, text string, spans array<struct<start:int,end:int,label:string,verdict:string,span:string>>")
    with pytest.raises(Exception, match="differ in a"):
        synth.unified(bad, bad.limit(0)).collect()


def test_recall_and_stress_tables(spark):
    cases = spark.createDataFrame([("a", "exact", "Ayah", 0, 10, "VERIFIED", None), ("b", "swapped", "Ayah", 0, 10, "CORRECTED", "x y"), ("c", "fabricated", "Ayah", 0, 10, "NOT_VERIFIED", None)], "case string, kind string, label string, start int, end int, expect string, gold string")
    found = spark.createDataFrame([("a", 0, 10, "Ayah", "VERIFIED", None), ("a", 0, 7, "Hadith", "UNSUPPORTED", None), ("b", 1, 10, "Ayah", "CORRECTED", "X, y"), ("c", 0, 3, "Ayah", "VERIFIED", None)], "case string, start int, end int, label string, status string, correction string")
    got = {r.kind: tuple(r)[1:] for r in evaluate.stress_table(cases, found, x.latin).collect()}
    assert got == {"exact": (1, 1, 1, 1, 0, 0, 0), "swapped": (1, 1, 1, 1, 1, 1, 0), "fabricated": (1, 0, 0, 1, 0, 0, 0)}
    asked = spark.createDataFrame([("a", False, "Ayah", 0, 10), ("b", False, "Ayah", 0, 10), ("c", True, "Ayah", 0, 10)], "case string, changed boolean, label string, start int, end int")
    r = evaluate.unannounced_recall(asked, found.where("case <> 'b'"), asked.where("case = 'a'").select("case"), found.limit(0)).first()
    assert tuple(r) == (2, 0.5, 1, 1.0, 1, 1.0, 0)


def test_messages_take_their_number(spark):
    r = spark.createDataFrame([("altered_passage", 3), ("no_source", 1), ("other", None)], "code string, n int").select(report.message(F.col("code"), F.col("n"))).collect()
    assert [v[0] for v in r] == ["3 words differ from the source.", "No source supports the text.", "other"]


def test_sequenced_search_reads_extra_words(spark):
    r = spark.createDataFrame([(1, 1, 1, "copper lanterns", "copper lanterns glow"), (2, 2, 1, "salt", None)], "idx long, section long, pos long, text string, extra string")
    c = verify.Corpus.build(r, x.LATIN)
    assert {p.term for p in c.postings.where("idx = 1").collect()} == {"copper", "lanterns", "glow"}
    assert index.vocabulary(c.records).count() == 3


def test_ngrams_are_cut_in_one_walk(spark):
    text = "ab😀é cdab😀é x" * 3
    df = spark.createDataFrame([(text,), ("abc",), ("",)], "t string").select(x.char_ngrams(F.col("t"), 4).alias("g"))
    assert [sorted(r.g) for r in df.collect()] == [sorted({text[i : i + 4] for i in range(len(text) - 3)}), [], []]
    assert "substring" not in df._jdf.queryExecution().optimizedPlan().toString()  # it counts from the text's begin each time


def test_tables_of_the_asked_terms_give_the_same_scores(spark):
    docs = [(1, "copper lanterns glow, copper river"), (2, "river salt"), (3, None), (2, "salt salt lanterns and amber"), (4, "")]
    c = index.normalised(spark.createDataFrame(docs, "idx long, text string"), x.LATIN)
    terms = spark.createDataFrame([(7, "copper"), (7, "salt"), (8, "salt"), (8, "nowhere")], "qid long, term string")
    post, stats = index.postings(c, x.LATIN), index.doc_stats(c, x.LATIN)
    totals = index.corpus_stats(stats)
    whole = retrieve.bm25(terms, post, stats, index.term_stats(post, totals), totals)
    post, stats, totals, idf = index.asked(c, terms, x.LATIN)
    assert {r.term for r in post.collect()} == {"copper", "salt"} and totals.first().n == 5
    assert sorted(map(tuple, retrieve.by_weights(terms, retrieve.weights(post, stats, idf, totals)).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("name", ["ngram_cosine_rerank", "lcs_ratio", "seq_blocks", "composite", "verify_flat"])
def test_whole_texts_are_not_shuffled(spark, tmp_path, name):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{r.randrange(100_000)}" for _ in range(900))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, docs[i][1][:90]) for i in range(2)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    scans = [i for i, s in enumerate(plan) if "FileScan parquet [doc_id" in s]
    assert scans
    for i in scans:
        above, at = [], depth(plan[i])
        for s in reversed(plan[:i]):
            if depth(s) < at:
                above, at = [*above, s], depth(s)
        join = next(k for k, s in enumerate(above) if "Join" in s)
        assert "BroadcastHashJoin" in above[join] and not any("Exchange" in s for s in above[:join])


def test_runs_are_cut_without_a_fold(spark):
    t = "array<struct<word:string,start:int,end:int,boundary:boolean>>"
    rows = [(1, [("a", 0, 1, False), ("b", 2, 3, False), ("c", 4, 5, True), ("d", 6, 7, False)], [(2, 3)]), (2, [("a", 0, 1, False)], []), (3, [], []), (4, [("a", 0, 1, False)], [(0, 9)])]
    df = spark.createDataFrame(rows, f"i int, tokens {t}, taken array<struct<start:int,end:int>>").select("i", spans.runs(F.col("tokens"), F.col("taken")).alias("r"))
    assert {r.i: [[w.word for w in run] for run in r.r] for r in df.collect()} == {1: [["a"], ["c", "d"]], 2: [["a"]], 3: [], 4: []}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()  # it copies its runs at each token


def test_tokens_of_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "é😀. x…\n y")], "i int, t string").select("i", x.offset_tokens(F.col("t")).alias("t"))
    assert {r.i: [tuple(w) for w in r.t] for r in df.collect()} == {1: [], 2: [], 3: [], 4: [("é😀.", 0, 3, True), ("x…", 4, 6, True), ("y", 8, 9, False)]}


def test_only_windows_with_a_records_blocks_are_searched(spark):
    flat = "an old merchant counted his silver coins near the walnut gate at midnight"
    split = "old merchant counted some things and then silver coins near it"  # two blocks of three
    texts = [(1, f"it is told that {flat} as we know"), (2, f"nobody said {split} again"), (3, "plain words of no record at all stand here today"), (4, "the old merchant counted nothing else today or tomorrow")]
    records = spark.createDataFrame([(1, 1, 1, flat), (2, 2, 1, "another record that nobody quotes in any of these texts")], "idx long, section long, pos long, text string")
    c = verify.Corpus.build(records, x.LATIN)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    r = verify.runs(docs, docs.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0), x.LATIN).withColumn("doc_id", F.col("run.doc_id")).drop("run")
    every, some = scan.flat_windows(r, x.LATIN), scan.flat_windows(r, x.LATIN, shared=scan.shared_blocks(r, c.records))
    assert {w.doc_id for w in every.collect()} == {1, 2, 3, 4} and {w.doc_id for w in some.collect()} == {1, 2}
    cfg = ScanSettings(ratio=0.1, flat_idf=0.0)
    found = [sorted(tuple(f) for f in scan.flat_scan(w, w.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), F.lit(1).alias("rank")), c.records, c.terms, cfg).collect()) for w in (every, some)]
    assert found[0] == found[1] and {f[0] for f in found[0]} == {1, 2}
