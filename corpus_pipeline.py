"""A training corpus in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, further columns of docs among them, whatever their names. run() writes each
stage's result to the shared folder and reads it again.

Null texts count as empty. Rows without doc_id, or without source, go through as rows of their
own: they are scored, mixed and packed like others, and never are duplicates. Repeated rows share
their fate in quality and line_dedup, stay together in near_dedup, are mixed to copies that differ by one at most and
packed one by one. Of the texts that line_dedup
leaves without words, or that had none, near_dedup keeps one, since they are equal. An empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm import compression, line_chunks, mixing, packing, weighted_minhash
from reverie.llm.common import boxed, load, word_bpe_path, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    model = compression.train(docs, load(spark, sf_dir, "labels"))
    return compression.score_quality(boxed(docs, "text"), model).where("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages, of several lines or one long line, that stand earlier; n_chars follows the text."""
    cut = line_chunks.drop_repeated_passages(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*[c for c in docs.columns if c in cut.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return weighted_minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, by sequence."""
    return packing.pack(docs, word_bpe_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("packed", packed)]

#: SQL has no compression, sampling or tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
