"""The ``opN_<name>`` queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, license_scan, mixing, near_dedup, packing, quality_knn, quality_rules, substring_dedup, token_records, toxicity
from .common import scratch_path, table
from .labelled import remainder


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and base rule of ``op1_quality_rules``, without what its sketches decide."""
    return op1_quality_rules(spark, sf_dir).drop("kept", "failed")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_records.write(table(spark, sf_dir, "documents"), scratch_path(spark, "token-records"), _tokenizer())
    return token_records.read(spark, files)


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_knn.score(docs, quality_knn.fit(docs, labels.where(remainder(5) != 0)))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", F.col("mix_tokens").alias("n_words"), F.col("mix_copies").alias("copies"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("matches", lambda m: m["template"]), ",")
    return found.select("doc_id", F.size("matches").alias("n_matches"), names.alias("licenses"), F.array_max(F.transform("matches", lambda m: m["containment"])).alias("best_containment"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(remainder(3) != 1)))
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, quality_base_counts, op2_token_records, op3_quality_knn, op4_mixing, op5_license_scan, op6_packing, op7_near_dedup, op8_toxicity, op9_fingerprints, op10_substring_dedup)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL of the queries that it can express; learned models, sketches, searches and files have none.
ORACLES: dict[str, str] = {
    "quality_base_counts": rf"""with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
    g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) > 1 as twice from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
    r as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from g where twice) group by doc_id),
    b as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) as lines, coalesce(n, 0) as n_repeat_words from d left join r using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b""",
    "op7_near_dedup": rf"""with recursive d as (select doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from d),
    e as (select doc_id, len(s) as n, unnest(s) as h from s),
    p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by all),
    l as (select a, b from p where 100 * c >= 85 * (na + nb - c)), both_ as (select a, b from l union all select b, a from l),
    reach as (select doc_id as node, doc_id as dest from documents union select reach.node, both_.b from reach join both_ on both_.a = reach.dest),
    c as (select node, min(dest) as component_id from reach group by node)
    select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join c on node = doc_id""",
    "op10_substring_dedup": rf"""with d as (select doc_id, {_WORDS} as w from documents),
    g as (select doc_id, i, row_number() over (partition by md5(array_to_string(w[i:i + 19], ' ')) order by doc_id, i) > 1 as later from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from d)),
    x as (select doc_id, w[i] as word, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
    m as (select x.doc_id, x.word, x.i, coalesce(max(g.later::int) over (partition by x.doc_id order by x.i rows between 19 preceding and current row), 0) = 1 as gone from x left join g on g.doc_id = x.doc_id and g.i = x.i),
    k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from m group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
}
