"""A training corpus from documents: known languages, one of each group of near copies, no secrets, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents, and any others that docs has, whatever
their names.  An empty table stays empty in every stage.  Null and empty texts, and texts without a letter, have no
known language and go in the first stage; were they to come to a later one, they stay and are pieces of 0 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import jaccard, langid, packing, secrets
from quillgraph.llm.common import bounded_batches, materialize, remove, scratch_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject; the models are fitted on docs.  Repeated rows fare alike; a null
    lang is not learned from; without any lang nothing is known and all go."""
    bounded_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: the one of the smallest
    doc_id (null ids last).  One of several rows that repeat a doc_id and its text stays; texts without words stay."""
    bounded_batches(spark)
    return jaccard.keep_one_each(docs, 5, 80, 100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars set anew; texts without a secret, null ones
    too, stay as they are."""
    bounded_batches(spark)
    return secrets.redact(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_words, bin, position, text): documents in bins of 2,048 words, with the text of each piece.

    A bin holds one document of a source and of a group of equal texts; null sources conflict with nothing.
    """
    bounded_batches(spark)
    return packing.pack_texts(docs)


STAGES = [("language id", language), ("near copies", near_copies), ("secrets", redact_secrets), ("packing", pack_bins)]

#: SQL cannot express the language models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table goes once the next is written."""
    docs, path = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/{k}")
        if k:
            remove(spark, f"{path}/{k - 1}")
    return docs
