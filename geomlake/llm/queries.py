"""The queries of this package: each applies one operator to its whole table.

SQL is given where DuckDB can express a query in reasonable time; the others are held against
brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomlake.llm import common, language_id, license_scan, near_dups, nearest, packing, piece_sampling, quality, token_count, token_files, topk_search

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(common.table(spark, sf_dir, "documents")).drop("spans")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.similar(common.table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "token-files")
    files = token_files.write_token_files(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE))
    return token_files.read_token_files(files, folder)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(common.table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learned(docs, common.table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(common.table(spark, sf_dir, "documents"), k=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_topk_search, op3_piece_sampling, op4_token_counts, op5_token_files, op6_packing, op7_nearest_neighbours, op8_language_id, op9_quality_classifier, op10_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op10_near_duplicates": near_dups.oracle()}
