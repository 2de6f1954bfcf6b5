"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns they were given.
``run`` writes what a stage returns to the shared scratch folder and reads it back as the next stage's documents, so no
stage depends on another one's lineage. Empty tables pass through all stages; rows with a null text are rejected by the
first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.llm import decontaminate, jaccard, language, packing, substrings
from shardloom.session import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject: texts with letters that are not far from all centroids."""
    found = language.identify(docs, language.fit_documents(docs))
    return found.where(~F.col("rejected")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; texts without words and rows without an id stay.

    Rows that share an id stay or go together, but of equal rows one stays.
    """
    found = materialize(jaccard.near_duplicates(docs), "groups")
    keep = found.where((F.col("component_id") == F.col("doc_id")) | (F.col("n_shingles") == 0)).select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(docs.columns)
    if found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        kept = kept.dropDuplicates()
    return kept.unionByName(docs.where("doc_id IS NULL"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words in windows of 35 that occur again; a text that lost words has its new length."""
    cut = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is verbatim benchmark text."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_contaminated),
    ("best_fit_packing", pack),
]

#: The first and last stage depend on a fitted model and a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
