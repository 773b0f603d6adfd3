"""A training-data pipeline over documents: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import materialise
from millrace.llm.decontam import decontaminate
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import keep_one
from millrace.sources import table

#: Score from which a document is rejected as toxic.
TOXIC = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the classifier learns from the labelled ones outside the held-out third."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    scored = toxicity.score_toxicity(docs, model, score_col="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more share (the largest document keeps them); n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 5-grams, Jaccard similarity of 0.8 or more."""
    return keep_one(docs, n=5, num=80, den=100).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (how often), size, source_size, target and taken."""
    return mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The toxicity classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{i}")
    return docs
