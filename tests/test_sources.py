"""Sources, sinks and the index store."""

import gzip

import pytest

from quotewright.sources import files


def test_json_list_and_corpora(spark, tmp_path):
    p = tmp_path / "s.json.gz"
    with gzip.open(p, "wt") as f:
        f.write('[{"surah_id":1,"surah_name":"x","ayah_id":1,"ayah_text":" a b "},{"surah_id":1,"surah_name":"x","ayah_id":2,"ayah_text":" "},{"surah_id":2,"surah_name":"y","ayah_id":1,"ayah_text":"c"}]')
    raw = files.json_list(spark, str(p), "surah_id int, surah_name string, ayah_id int, ayah_text string")
    assert [(r.idx, r.section, r.text) for r in files.sequenced_corpus(raw).orderBy("idx").collect()] == [(0, 1, "a b"), (1, 2, "c")]
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(files.CorpusError):
        files.json_list(spark, str(tmp_path / "o.json"), "a int")


def test_responses_are_raw_and_last_wins(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<Question><ID> 1 </ID><Response> a &amp; b</Response></Question><Question><ID>1</ID><Response>last</Response></Question><Question><ID>2</ID><Response> x&amp;\n</Response></Question>")
    assert {r.qid: r.text for r in files.responses(spark, str(tmp_path / "r.xml")).collect()} == {"1": "last", "2": " x&amp;\n"}


def test_index_store(spark, tmp_path):
    path, calls = str(tmp_path / "index"), []

    def build():
        calls.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        assert files.load_or_build(spark, path, ["t"], build)["t"].count() == 3
    assert len(calls) == 1


def test_tsv(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Question_ID\tLabel\tSpan_Start\tSpan_End\nq1\tCorrectAyah\t0\t3\nq2\tNoAnnotation\t0\t0\n")
    g = files.gold_spans(files.tsv(spark, str(tmp_path / "g.tsv"))).collect()
    assert [(r.qid, r.label, r.verdict, r.end) for r in g] == [("q1", "Ayah", "Correct", 3)]
