"""Documents to training sequences: five stages, each over all rows that the one before it kept.

1. language: documents without a letter, or that no language claims (score below LEAST_SCORE), go.
2. lines: recurring lines go, save in their first document; documents left without any word go if they had one.
3. near_duplicates: one document (the smallest doc_id) of each group of documents linked by five-word shingles at Jaccard 0.8 stays.
4. benchmark: documents that hold a passage of the benchmark go.
5. packing: the rest becomes pieces of sequences.

All stages but the last return the columns of documents, n_chars being that of the text they return. Repeated rows
of one doc_id are treated alike; rows whose doc_id is null are never dropped for what they share with others, but go if they
hold a passage of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm import common, decontaminate, language_id, line_dedup, ngram_join, packing

#: Below this, the best language's regression is nearer to "another language" than any clean text's.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    found = common.fresh(docs.columns, "__language")
    tagged = language_id.tag(spark, docs, language_id.fit(spark, docs), found)
    return tagged.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.lang_score") >= LEAST_SCORE)).select(common.named(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    dropped = common.fresh(docs.columns, "__dropped")
    kept = line_dedup.rewrite(spark, docs, dropped=dropped)
    emptied = (F.col(dropped) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(common.named(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return ngram_join.keep_one(spark, docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return decontaminate.without_contaminated(spark, docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return packing.pack(docs, length=1024)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", pack)]
#: The first stage is a fitted model, which SQL can't express; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
