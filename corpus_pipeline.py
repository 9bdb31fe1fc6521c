"""A corpus from documents to token ids, in five stages.

Each stage takes all that its predecessor kept, written and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, language, line_dedup, mixing, near_dedup
from weftline.llm.common import delete, drop_ids, own_folder, small_batches

#: Share of a text's n-grams that its language must know.
LEAST_COVERAGE = 0.2
#: Share of the usual size of the tokenizer's caches: executors come from other stages here, with a full heap.
CACHE = 0.1
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in none of the learned languages go.

    Null and blank texts have no letters. Repeated rows are judged each; without a labelled
    row no language is known and all go; whole texts of any length are read.
    """
    small_batches(spark)
    return language.known_only(docs, language.fit(docs), LEAST_COVERAGE).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents that have no other line.

    Rows that repeat an id are one document; null ids and null texts are left alone. Of tied
    lines the first by id and line stays.
    """
    small_batches(spark)
    out = line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.where("n_removed = 0 or trim(text) <> ''").select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Null and blank texts are no duplicates; rows that repeat an id share its verdict; rows
    without an id stay.
    """
    small_batches(spark)
    found = near_dedup.near_duplicates(docs)
    return drop_ids(docs, "doc_id", found.where("not kept").select("doc_id")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, always whole, as often as the mix takes it, in the order of its shard.

    Rows that repeat an id, or have none, are taken each for itself; a null source is a
    source; documents without words are in no mix; an empty table stays empty.
    """
    small_batches(spark)
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to; a null text has no ids."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, cache=CACHE)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL has no way to state the sketches, the tree or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = own_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
