"""Queries that apply the operators of this subpackage to whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import oracles
from kinfold.llm.chunkdedup import chunk_dedup
from kinfold.llm.htmltext import extract_pages
from kinfold.llm.linefreq import quality_rules
from kinfold.llm.mixing import mix_sources
from kinfold.llm.multiindex import embedding_groups
from kinfold.llm.piecebpe import token_digests
from kinfold.llm.sharding import shard_documents
from kinfold.llm.simhash import simhash_groups
from kinfold.llm.suffixdedup import suffix_dedup
from kinfold.llm.toxicity import score_documents
from kinfold.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a table in few small files is dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def model_path() -> str:
    """The SentencePiece model: PIECE_MODEL, or the file of the package of public tokenizers."""
    if "PIECE_MODEL" in os.environ:
        return os.environ["PIECE_MODEL"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), model_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_near_dedup, op2_quality_rules, op3_mix_sources, op4_inverted_multi_index, op5_minimax_sharding, op6_site_template_removal, op7_suffix_dedup, op8_toxicity_neighbours, op9_chunk_dedup, op10_piece_encoding]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_simhash_near_dedup": oracles.simhash(),
        "op2_quality_rules": oracles.quality(),
        "op4_inverted_multi_index": oracles.EMBEDDINGS,
        "op5_minimax_sharding": oracles.shards(),
        "op6_site_template_removal": oracles.PAGES,
        "op7_suffix_dedup": oracles.repeats(),
    }
