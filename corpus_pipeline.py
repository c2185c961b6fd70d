"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage is an operator of ``kerbside.llm`` over all that the stage before kept. Stages up to the mix return the
columns of ``documents``; a document that the mix takes twice is two rows. The last returns a row for each
packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import mixing, packing, quality, simhash, toxicity
from kerbside.llm.registry import table, tokenizer_path
from kerbside.llm.words import n_words
from kerbside.staging import written, written_from_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_grades(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded as toxic go. The model is fitted on labelled documents that are still there."""
    return written_from_texts(toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), "pipeline-civil")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places. A worker remembers few words, as it still holds what earlier stages left."""
    return packing.pack_documents(docs, tokenizer_path(), remembered=60_000)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_grades), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL cannot express fingerprints, a fitted model or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
