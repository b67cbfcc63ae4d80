"""A training corpus from raw documents: five stages, each an operator of tessera.llm.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame;
run() writes each stage's result as Parquet and reads it again as the next one's docs. All
stages but the last return the columns of documents; where a stage changes a text, n_chars
is counted anew.

What holds for all stages: an empty table gives an empty one. Texts of any length are worked on whole. Columns besides doc_id and
text are passed through, whatever their names (the last stage has columns of its own). doc_id should be
unique; a row without one is nobody's copy, and rows that share one but not the text are
told apart by it (common.keyed). What each stage does with null and empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common, fm_index, langid, minhash, packing, suffix_dedup

#: A document goes if its pooled probability is below this, whatever the language, or if it has no letter.
LEAST_SCORE = 0.35
#: Near copies share at least so many hundredths of their five-word shingles.
NEAR = 80


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; each row by its own text, those without a doc_id too.

    Null and empty texts and those without a letter go, as no language can be told. Of languages with equal probability the first by
    name counts, which doesn't matter here. Repeated rows are judged alike, so all of them stay or go. A null lang, source or n_chars stays
    null. Where no row has a language to learn from, all rows go.
    """
    return langid.predicted(docs, langid.fitted(docs), least=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Null and empty texts and those without a word are linked with nothing and stay. Rows that are repeated with the same doc_id and
    text are one document, of which one row stays. Rows without a doc_id stay: nothing says which of them would stand for the others.
    So does a row that shares its doc_id with another text.
    """
    key, kept = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    own = common.keyed(docs, key)
    keep = minhash.near_duplicates(docs, NEAR).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    one = own.where(F.col(key).isNotNull()).join(keep, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key])
    return one.unionByName(own.where(F.col(key).isNull())).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once, all occurrences.

    Null texts stay null, empty and short ones as they are. All rows stay; a text that is repeated whole, or only made of repeated strings, becomes
    empty. A character that was cut through goes. Rows without a doc_id, and those that share one with another text, keep their text.
    """
    return _recounted(suffix_dedup.deduplicated(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark, each row by its own text, whatever its doc_id.

    Null texts stay null, empty ones empty, and all rows stay, repeated ones too; overlapping passages are cut once. Items without
    an item_id or without a word have no passages.
    """
    return _recounted(fm_index.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens with their sequences.

    A null or empty text is one piece, of the end token. Repeated rows are packed as often as they stand there, each with its
    own place. Which of several sequences with equal space a piece goes to doesn't matter; any is as full.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL has neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        # What a stage wrote by the way goes; what it returns stays for the next one.
        with common.scope() as needed:
            docs = needed(common.kept(stage(spark, docs, sf_dir)))
    return docs
