"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity
from millrace.llm.ann import search
from millrace.llm.decontam import decontaminate
from millrace.llm.html_extract import extract
from millrace.llm.labelled import id_remainder
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mix, word_count
from millrace.llm.ngram_join import jaccard_components
from millrace.llm.substring_dedup import remove_repeats
from millrace.llm.url_filter import filter_urls
from millrace.sources import table

#: The rules of op1: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), text_col=None, size_col="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _judged(scored: DataFrame, modulus: int, held_out: int, least: float) -> DataFrame:
    held = (id_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return _judged(toxicity.score_toxicity(docs, model), 3, 1, 0.7)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return _judged(quality.score_quality(docs, model), 5, 0, 0.3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
}
