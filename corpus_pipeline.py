"""The corpus pipeline: language, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet in the
shared folder and hands the reread table to the next. All stages but the last give back rows of
`documents`, with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomlake.llm import common, language_id, near_dups, packing, quality
from geomlake.llm.queries import WORD_BPE

#: A text is in none of the languages if its best cosine lies below this share of a low quantile of
#: the learning texts' own, among texts of its size.
LOW_LANGUAGE, SHARE_LANGUAGE = 0.01, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents themselves teach.

    Null texts and texts without letters go; null languages teach nothing, and where none is learned all
    rows go; whole texts are read; a cosine at the cut stays; repeated rows are judged alike; a null
    doc_id is no reason to go; an empty table stays empty; extra columns are handed on, whatever their names.
    """
    names, vectors = language_id.profiles(docs)
    return language_id.spoken(docs, names, vectors, language_id.cuts(docs, names, vectors, LOW_LANGUAGE, SHARE_LANGUAGE))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Null texts count as empty; null metadata and labels are as in quality; without enough labels of both
    classes all rows stay; a score at the cut stays; repeated rows are judged alike; an empty table stays
    empty; extra columns are handed on.
    """
    model = quality.learned(docs, common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8.

    The row with the smallest doc_id of a class stays, then the smallest hash of its text. Rows without a
    word (null, empty) or doc_id stay; rows that share a doc_id go or stay each by its text; of rows
    equal in both one stays; an empty table stays empty; extra columns are handed on.
    """
    return near_dups.one_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is its end id alone; a null doc_id and repeated rows are packed each; an empty
    table gives no piece; other columns are not returned.
    """
    return packing.packed(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("packing", packed)]

#: Bundled vectors, fitted weights and tokenizers have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
