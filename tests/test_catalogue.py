"""Every registered query imports without a session; a few run against DuckDB."""

import duckdb
import pytest

from quotewright.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bm25_topk", "rank_union", "doc_summary", "greedy_nonoverlap", "macro_f1", "sessions", "stress_cases", "verbatim_contains"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "events", "pages", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_report_verifies_exact_quotations_and_flags_altered_ones(spark):
    from pyspark.sql import functions as F

    from quotewright.functions.text import LATIN
    from quotewright.operators import synth
    from quotewright.plans import verify

    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 2").select(F.col("item_id").alias("idx"), F.lit(0).alias("section"), F.col("item_id").alias("pos"), "text")
    corpus = verify.Corpus.build(items, LATIN)
    docs = synth.stress_cases(corpus.records).where("kind in ('exact', 'substituted')").select(F.concat_ws("_", "idx", "kind").alias("doc_id"), "text")
    rows = {r.doc_id: r for r in verify.document_report(docs, corpus).collect()}
    assert {k: (r.n_spans, r.verified, r.spans[0].code) for k, r in rows.items()} == {f"{i}_{k}": v for i in range(2) for k, v in (("exact", (1, 1, "exact_match")), ("substituted", (1, 0, "hadith_altered")))}


def test_names_agree():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_imports():
    import __spark_entry__

    assert "bm25_topk" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["verify_flat", "verify_sequence", "composite", "lcs_ratio", "seq_blocks"])
def test_passages_far_into_a_document_are_compared(spark, tmp_path, name):
    item = "seven quiet rivers carry copper lanterns beyond the northern valley every autumn evening"
    docs = [(i, " ".join(f"filler{i}x{k}" for k in range(200))) for i in range(6)]
    docs.append((6, docs[0][1].replace("filler0", "other") + " " + item + " " + docs[1][1].replace("filler1", "more")))
    # more than three short records that rank before the long one
    docs += [(10 + i, f"copper lanterns valley autumn evening northern rivers {w}") for i, w in enumerate("abcd")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    if name.startswith("verify"):
        assert [(r.qid, r.idx, r.verdict) for r in rows] == [(0, 6, "Correct")]
    else:
        n = len(item.split())
        whole = {"composite": lambda r: r.coverage == r.lcs_ratio == 1.0, "lcs_ratio": lambda r: r.lcs_ratio == 1.0, "seq_blocks": lambda r: r.matched == n}[name]
        assert [r.idx for r in rows if whole(r)] == [6]
