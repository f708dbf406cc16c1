"""Column functions on literal texts."""

import pytest
from pyspark.sql import functions as F

from quotewright.functions import text as x


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_match_form_drops_marks_and_folds_letters(spark):
    a, b = (one(spark, x.matching(F.lit(v))) for v in ("ٱلرَّحْمَـٰنِ", "الرحمن"))
    assert a == b == "الرحمن"
    assert one(spark, x.matching(F.lit("ﷲ"))) == "الله"
    assert one(spark, x.matching(F.lit("plain words"))) == ""


def test_strict_form(spark):
    assert one(spark, x.strict(F.lit("إِنَّ اللَّهَ"))) == "ان الله"


def test_phonetic_key(spark):
    assert one(spark, x.phonetic(F.lit("الصبر"))) == one(spark, x.phonetic(F.lit("السبر")))


def test_allowed_gap(spark):
    assert [one(spark, x.allowed_gap(F.lit(n))) for n in (3, 5, 20)] == [0, 1, 4]


def test_trim_span(spark):
    text = F.lit('he said "(so it is)." then')
    assert tuple(one(spark, x.trim_span(text, F.lit(8), F.lit(21)))) == (10, 18)


def test_offset_tokens(spark):
    got = one(spark, x.offset_tokens(F.lit("  ab cd.\nef ")))
    assert [(t.word, t.start, t.end, t.boundary) for t in got] == [("ab", 2, 4, False), ("cd.", 5, 8, True), ("ef", 9, 11, False)]


def test_sanitize_answer(spark):
    assert one(spark, x.sanitize_answer(F.lit("abc 漢字 def ،، x"))) == "abc def، x"
    assert one(spark, x.sanitize_answer(F.lit("clean text."))) == "clean text."


@pytest.mark.parametrize(("a", "b"), [("abcbdab", "bdcaba"), ("", "abc"), ("abc", "abc"), ("ab", "ba")])
def test_lcs_equals_the_table(spark, a, b):
    from quotewright.functions.kernels import lcs

    got = one(spark, x.lcs_length(F.lit(list(a)) if a else F.array().cast("array<string>"), F.lit(list(b))))
    assert got == lcs(list(a), list(b))


def test_contains_sequence(spark):
    s = F.lit(["a", "b", "c", "d"])
    assert one(spark, x.contains_sequence(s, F.lit(["b", "c"]))) and not one(spark, x.contains_sequence(s, F.lit(["b", "d"])))


def test_answer_text(spark):
    for j, v in (('{"response":"r"}', "r"), ('{"choices":[{"message":{"content":"c"}}]}', "c"), ("plain", "plain")):
        assert one(spark, x.answer_text(F.lit(j))) == v
