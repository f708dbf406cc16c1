"""Sources and sinks: JSON lists, JSON lines, raw XML replies, TSV, index tables, reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INDEX_VERSION = 1


class CorpusError(ValueError):
    """A corpus or index that cannot be used."""


def json_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a file that holds one JSON list, plain or gzipped; anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.ltrim(F.col("value")).startswith("[").alias("ok"))
    if head.where("not ok").head(1):
        raise CorpusError(f"{path}: the top level is not a list")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sequenced_corpus(raw: DataFrame) -> DataFrame:
    """(idx, section, section_name, pos, text): trimmed, blank ones out, in natural key order."""
    from pyspark.sql import Window

    kept = raw.select(F.col("surah_id").alias("section"), F.col("surah_name").alias("section_name"), F.col("ayah_id").alias("pos"), F.trim("ayah_text").alias("text")).where("length(text) > 0")
    # dense ids over the whole corpus from counts per section, ranked inside sections
    base = kept.groupBy("section").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = kept.withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy("pos")) - 1)
    return inside.join(base.select("section", "base"), "section").select((F.col("base") + F.col("k")).alias("idx"), "section", "section_name", "pos", "text")


def flat_corpus(raw: DataFrame) -> DataFrame:
    """(rec_id, book, title, matn, full): empty is null, ``full`` only where ``matn`` is missing."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    r = raw.select(F.col("hadithID").cast("string").alias("rec_id"), F.col("BookID").cast("int").alias("book"), "title", blank("Matn").alias("matn"), blank("hadithTxt").alias("text"))
    return r.where("matn is not null or text is not null").select("rec_id", "book", "title", "matn", F.when(F.col("matn").isNull(), F.col("text")).alias("full"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of ``<Question>`` blocks; the response raw, so that offsets hold; the last id wins."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Question>(.*?)</Question>"), F.lit(1))).alias("k", "b"))
    one = blocks.select("k", F.trim(F.regexp_extract("b", r"(?s)<ID>(.*?)</ID>", 1)).alias("qid"), F.regexp_extract("b", r"(?s)<Response>(.*?)</Response>", 1).alias("text"))
    return one.groupBy("qid").agg(F.max_by("text", "k").alias("text"))


def tsv(spark: SparkSession, path: str, columns: list[str] | None = None, required: str | None = "Question_ID") -> DataFrame:
    """A TSV with a header, or without one if ``columns`` are given; the key column must be there."""
    read = spark.read.option("sep", "\t").option("quote", "")
    df = read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else read.option("header", True).csv(path)
    if required and required not in df.columns:
        raise CorpusError(f"{path}: no column {required}")
    return df


def gold_spans(rows: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(qid, label, verdict, start, end, text, correction) of any of the three gold layouts."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    g = rows.where(F.coalesce(F.col("Label"), F.lit("")) != "NoAnnotation").select(
        F.col("Question_ID").alias("qid"), F.when(F.col("Label").contains("Ayah"), "Ayah").otherwise("Hadith").alias("label"),
        F.when(F.col("Label").startswith("Correct"), "Correct").otherwise("Incorrect").alias("verdict"),
        F.col("Span_Start").cast("int").alias("start"), F.col("Span_End").cast("int").alias("end"), has("Original_Span").alias("original"), has("Correction").alias("correction"),
    )
    if replies is None:
        return g.withColumnRenamed("original", "text")
    cut = F.nullif(F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))), F.lit(""))
    return g.join(replies, "qid", "left").withColumn("text", F.coalesce(cut, "original")).drop("original")


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Tables under ``path``, the version last, so that a broken write is no index."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(tables.values())).sparkSession.range(1).select(F.lit(INDEX_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/_version_")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    try:
        version = spark.read.parquet(f"{path}/_version_").first().version
    except Exception as e:
        raise CorpusError(f"{path}: no index") from e
    if version != INDEX_VERSION:
        raise CorpusError(f"{path}: index version {version}, not {INDEX_VERSION}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def load_or_build(spark: SparkSession, path: str, names: list[str], build) -> dict[str, DataFrame]:
    """The stored index, else a new one, stored if that is possible."""
    try:
        return load_index(spark, path, names)
    except CorpusError:
        tables = build()
        try:
            save_index(tables, path)
        except Exception:
            return tables
        return load_index(spark, path, names)


def write_tsv(df: DataFrame, path: str) -> None:
    """Cleaned fields, tab-separated, without header or quotes."""
    from ..operators.report import tsv_line

    df.select(tsv_line(*df.columns)).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def examples(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Example rows of a JSON list; a file that is missing or no list gives none."""
    try:
        df = json_list(spark, path, schema)
        df.head(1)
        return df
    except Exception:  # examples are a help, not a need
        return spark.createDataFrame([], schema)


def signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names and sizes of input files, to key what is derived from them."""
    sc = spark.sparkContext
    parts = []
    for p in sorted(paths):
        where = sc._jvm.org.apache.hadoop.fs.Path(p)
        status = where.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(where)
        parts.append(f"{where.getName()}:{status.getLength()}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, inputs: list[str], names: list[str], build) -> dict[str, DataFrame]:
    """Tables derived from ``inputs``, stored under their signature; other inputs are another folder."""
    return load_or_build(spark, f"{root}/{signature(spark, inputs)}", names, build)


def warm(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Read tables once into the cluster's memory; their row counts."""
    return {n: t.cache().count() for n, t in tables.items()}


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def unified_dataset(spark: SparkSession, path: str, schema: StructType | str, synthetic: int, build) -> DataFrame:
    """A stored dataset of JSON lines, made anew where it is missing or has another number of synthetic rows."""
    try:
        df = json_lines(spark, path, schema)
        if df.where("source = 'synthetic'").count() == synthetic:
            return df
    except Exception:  # no dataset yet
        pass
    write_json_lines(build(), path)
    return json_lines(spark, path, schema)


def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """Evaluation tables (a few rows each) as one JSON object of lists."""
    one = None
    for name, df in tables.items():
        rows = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        one = rows if one is None else one.join(F.broadcast(rows))
    pairs = [x for n in tables for x in (F.lit(f'"{n}": '), F.col(n), F.lit(", "))][:-1]
    one.select(F.concat(F.lit("{"), *pairs, F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text_report(found: DataFrame, path: str) -> None:
    from ..operators.report import text_report

    text_report(found).select("value").write.mode("overwrite").text(path)


def build_index(spark: SparkSession, source: str, path: str, schema: str, profile: str = "arabic") -> None:
    """Index a JSON list of records (idx, section, pos, text) at ``source`` and store it at ``path``."""
    from ..functions import text
    from ..plans.verify import Corpus

    save_index(Corpus.build(json_list(spark, source, schema), text.ARABIC if profile == "arabic" else text.LATIN).tables(), path)
