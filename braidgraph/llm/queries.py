"""Registered queries of the corpus operators: op1 .. op10 and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm import decontaminate, html_extract, language_id, licenses, line_dedup, ngram_join, oracles, packing, pii, quality_rules, substring_dedup
from braidgraph.llm.common import ship, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark, table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(book, "base", "base_ok"), "v1", "kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 does, from the failure bits of all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=1024)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "pipeline": pipeline,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.OP1,
    "op3_quality_rules": oracles.OP3,
    "quality_ablations": oracles.ablations_sql(tuple((r.name, r.bit) for r in quality_rules.RULES if r.name in quality_rules.POLICIES["v1"])),
    "op7_ngram_join": oracles.OP7,
    "op8_substring_dedup": oracles.OP8,
}
