"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mix of sources, token ids.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and returns a
DataFrame; whoever runs the stages writes each result as Parquet and reads it again as the next one's documents.

All but the last return the columns of the documents, whatever else these hold. Null and empty texts pass every filter but
near-duplicates, where they are equal to each other; rows without an id or a source are documents like others; an empty
table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import materialize, small_batches
from kinfold.llm.mixing import mix_documents
from kinfold.llm.piecebpe import token_digests
from kinfold.llm.queries import model_path, table
from kinfold.llm.simhash import near_dedup
from kinfold.llm.suffixdedup import remove_repeats
from kinfold.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; nothing is learned from the labels of held-out rows, and
    without labels nothing goes."""
    small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more over five-word shingles stays: that of the
    smallest id, ids that are null last; of equal rows one stays."""
    small_batches(spark)
    return near_dedup(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out: strings of 208 bytes, some 35 words, as a passage of 50 words seldom
    reaches the 400 bytes of op7's contract. Documents of nothing else go; null texts stay null."""
    small_batches(spark)
    return remove_repeats(docs, length=208)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; equal rows share a draw, documents without
    words stay once."""
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of them and of the text that they decode to. Null texts have no ids; every row
    stays, with its columns but for the text and those whose names the results take."""
    small_batches(spark)
    made = {"text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    return token_digests(docs, model_path(), keep=tuple(c for c in docs.columns if c.lower() not in made), with_ids=True, forget=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("piece_encoding", token_ids),
]

#: Fingerprints, suffix sorting, the random mix and token ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
