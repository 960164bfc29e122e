"""Queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..sources.tables import table
from . import binpack, docpairs, generated, mixing, natlang, parsecheck, secrets, spans, tokenize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "chunks")).select("seq", "chunk_idx", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "chunks"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "chunks"))


def p3_braces(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions of files in languages with braces."""
    return docpairs.brace_pairs(table(spark, d, "chunks"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each once, with the words of their text."""
    rows = table(spark, d, "chunks").select("seq", "chunk_idx", word_count(F.coalesce("code", "content")).cast("bigint").alias("size"))
    return rows.groupBy("seq", "chunk_idx").agg(F.max(F.coalesce("size", F.lit(0))).alias("size"))


def p4_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in an output file, for each configuration."""
    configs = table(spark, d, "run_config").select("config_id", F.col("max_words").alias("capacity"))
    packed = binpack.pack_all(_sized(spark, d), configs, ["seq", "chunk_idx"])
    return packed.select("config_id", F.col("container").alias("file_no"), "seq", "chunk_idx", "piece", F.col("size").alias("words"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The output files with their filling."""
    rows = p4_packed(spark, d).groupBy("config_id", "file_no").agg(F.sum("words").alias("words"), F.count("*").alias("chunks"))
    limits = table(spark, d, "run_config", "config_id", "max_words").distinct()
    return rows.join(limits, "config_id").withColumn("filled", F.col("words") / F.col("max_words")).select("config_id", "file_no", "words", "chunks", "max_words", "filled")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return natlang.languages(table(spark, d, "chunks"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return natlang.shares(table(spark, d, "chunks"))


def p5_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the classifier is right on labelled sentences it hasn't seen, with and without the words that label them."""
    return natlang.held_out(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_handwritten(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "skipped")).select("seq")


def p6_signs(spark: SparkSession, d: str) -> DataFrame:
    rows = generated.not_handwritten(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "skipped"))
    return rows.select("seq", F.array_join("signs", ",").alias("signs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.invalid(table(spark, d, "chunks"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.rates(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return tokenize.decode(tokenize.encode(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))[0]


def p10_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the least of those it shares a span with, without making pairs."""
    return spans.representatives(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


QUERIES = [
    p1_found, p1_redacted, p3_found, p3_pairs, p3_braces, p4_packed, p4_files, p5_found, p5_shares, p5_accuracy, p6_found, p6_signs, p7_found, p7_rates,
    p8_ids, p8_decoded, p9_mixture, p9_shares, p10_found, p10_sets, p10_shared,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where there is some; the others aren't expressible at whole-table speed and are tested against brute force."""
    return {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
