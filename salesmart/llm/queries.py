"""The operators applied to their whole tables, with the columns each result is known by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import (
    embedding_dedup,
    fingerprints,
    hard_negatives,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    packing,
    quality,
    token_alignment,
    token_files,
    top_search,
    toxicity,
)
from salesmart.llm.common import id_remainder, table
from salesmart.llm.sql import ORACLES
from salesmart.llm.tokens import default_tokenizer


def _held_out(divisor: int, remainder: int):
    return F.coalesce(id_remainder(F.col("doc_id"), divisor) == remainder, F.lit(False))


def op1_embedding_near_dedup(spark: SparkSession, tables: str) -> DataFrame:
    """Links of every vector to vectors of its label at a cosine of 0.93 or more."""
    return embedding_dedup.near_copies(table(spark, tables, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, tables: str) -> DataFrame:
    """Links of every document on word 5-grams at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.join(table(spark, tables, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, tables: str) -> DataFrame:
    """Predicted language of every document; learned from ids whose remainder is not 2."""
    documents = table(spark, tables, "documents")
    model = language_id.train(documents, id_remainder(F.col("doc_id"), 4) != 2)
    return language_id.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", _held_out(4, 2).alias("held_out"), "language.lang_pred", "language.score"
    )


def op4_packing(spark: SparkSession, tables: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row per piece."""
    return packing.pack(
        table(spark, tables, "documents").select("doc_id", "text"), default_tokenizer()
    )


def op5_mixing(spark: SparkSession, tables: str) -> DataFrame:
    """The words that a mix by source takes from every document."""
    documents = table(spark, tables, "documents").select("doc_id", "text", "source")
    return mixing.taken(mixing.mix(documents))


def op6_token_files(spark: SparkSession, tables: str) -> DataFrame:
    """All documents written as files of token ids, and what the files hold of each."""
    documents = table(spark, tables, "documents").select("doc_id", "text")
    return token_files.round_trip(documents, default_tokenizer(), without_ids=True)


def op7_fingerprints(spark: SparkSession, tables: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.edited(table(spark, tables, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, tables: str) -> DataFrame:
    """Quality of every document."""
    documents = table(spark, tables, "documents")
    model = quality.train(documents, table(spark, tables, "labels"))
    return quality.quality(documents.select("doc_id", "text"), model, "score").select(
        "doc_id",
        _held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op9_html_extraction(spark: SparkSession, tables: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, tables, "pages"))


def op10_toxicity(spark: SparkSession, tables: str) -> DataFrame:
    """Toxicity of every document and the spans of its offending sentences."""
    documents = table(spark, tables, "documents")
    model = toxicity.train(documents, table(spark, tables, "labels"))
    return toxicity.toxicity(documents.select("doc_id", "text"), model).select(
        "doc_id",
        _held_out(5, 0).alias("held_out"),
        "toxicity.score",
        "toxicity.predicted",
        F.size("toxicity.offending").alias("n_offending"),
        F.get("toxicity.offending", F.lit(0))["start"].alias("first_start"),
        F.get("toxicity.offending", F.lit(0))["end"].alias("first_end"),
    )


def op11_token_alignment(spark: SparkSession, tables: str) -> DataFrame:
    """How the tokens of two tokenizers cover every document's text."""
    return token_alignment.digests(table(spark, tables, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, tables: str) -> DataFrame:
    """Hard negatives for the positives of every hundredth vector."""
    moved = (F.col("label").cast("long") + 1) % 10
    vectors = table(spark, tables, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).alias("label"),
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_top_search(spark: SparkSession, tables: str) -> DataFrame:
    """The five vectors of highest inner product with every fiftieth vector."""
    vectors = table(spark, tables, "embeddings")
    return top_search.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_embedding_near_dedup,
            op2_ngram_jaccard_join,
            op3_language_id,
            op4_packing,
            op5_mixing,
            op6_token_files,
            op7_fingerprints,
            op8_quality,
            op9_html_extraction,
            op10_toxicity,
            op11_token_alignment,
            op12_hard_negatives,
            op13_top_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
