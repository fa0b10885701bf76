"""From raw documents to packed training sequences, one operator after the other.

Every stage works on all that its predecessor kept, and is written before the next one reads
it, so that a lost executor costs no more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import jaccard_join, language_id, mixing, packing, toxicity
from salesmart.llm.common import free_name, id_remainder, perhaps_among, stored, table
from salesmart.llm.tokens import default_tokenizer

#: A document is rejected whose share of words known in its language is below this part of what
#: the poorest hundredth of the texts learned has.
LEAST_KNOWN = 0.25
#: Words, known as in that hundredth, that are added to every document: few words tell little.
ADDED_WORDS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from labels of ids not held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    into = free_name(docs, "toxicity")
    judged = toxicity.toxicity(docs, model, into)
    return judged.where(F.col(into)["predicted"] == 0).select(docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned.

    Rejected are texts without a word, and those of whose words the predicted language has too
    few: other languages and gibberish.  That share does not grow with a text's length, as the
    score does; texts of up to six words are not rejected by it.
    """
    trained = id_remainder(F.col("doc_id"), 4) != 2
    model = language_id.train(docs, trained)
    into = free_name(docs, "language")
    # Stored: what is usual is told from all of them before any is rejected.
    named = stored(language_id.identify(docs, model, into), "named")
    usual = F.lit(0.0)
    for lang, share in language_id.least_known(named, trained, into).items():
        usual = F.when(F.col(into)["lang_pred"] == lang, share).otherwise(usual)
    n_words, n_known = F.col(into)["n_words"], F.col(into)["n_known"]
    enough = n_known + ADDED_WORDS * usual >= LEAST_KNOWN * usual * (n_words + ADDED_WORDS)
    named_one = F.col(into)["lang_pred"] != language_id.UNDETERMINED
    return named.where(named_one & enough).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that of the smallest id.

    Of rows that repeat both id and text one stays; rows of one id and other texts stay or go
    together.
    """
    found = stored(jaccard_join.join(docs).select("doc_id", "kept"), "kept")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id")
    ids = ids.agg(F.max("kept").alias("kept"), F.count_if("kept").alias("times"))
    ids = stored(ids, "ids")
    # Most documents stay where they are: only those that may go meet the ids that do.
    gone = ids.where("NOT kept").select("doc_id")
    perhaps, left = perhaps_among(docs, gone, "doc_id")
    left = left.unionByName(perhaps.join(gone, "doc_id", "left_anti"))
    if not ids.where("times > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass over its source."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
