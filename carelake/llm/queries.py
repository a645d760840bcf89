"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import bit_slices, divergence, hard_negatives, html_text, jaccard_join, language_id, line_dedup, lm_scoring, mixing, neighbours, oracles, packing, repetition, toxicity
from carelake.llm.common import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(remainder("doc_id", 4) != 2))
    return language_id.identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host_path")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = toxicity.fit(docs, labels.where(remainder("doc_id", 5) > 0))
    return toxicity.score(docs, scorer).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "best_clause", "total", "matched_clauses")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "lines_removed", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"), F.col("text").alias("kept_text")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the target: documents that are labelled as of high quality and not as toxic
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good")).where("good")
    # labels grow with the documents: a shuffle join at every size
    marked = docs.join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("is_target"))
    return lm_scoring.score_counted(marked)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.exact_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_html_text, op3_neighbours, op4_toxicity, op5_mixing, op6_packing, op7_repetition, op8_line_dedup, op9_lm_scoring, op10_jaccard_join,
        op11_hard_negatives, op12_source_divergence, op13_exact_search,
    )
}

ORACLES = oracles.ORACLES
