"""A corpus cleaned for training in five stages, each reading what the one before wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame: all but the last the columns of
``documents``. :func:`run` applies them to ``documents`` and returns the last one's rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, language_id, shared


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told. The dictionaries are learned from the stage's
    input, four fifths of it by a checksum of the id, as in the query of the operator."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    dictionaries = language_id.train_dictionaries(docs.filter(~F.coalesce(held_out, F.lit(False))))
    accepted = shared.free_name(docs.columns, "accepted")
    judged = language_id.identify_language(docs, dictionaries, accepted=accepted)
    return judged.filter(F.col(accepted)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_largest(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.75 the one with the smallest doc_id stays."""
    linked = jaccard_join.linked_documents(docs)
    kept = linked.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")
    return named.union(docs.filter("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of the five-word shingles of a benchmark item go."""
    out = shared.free_name(docs.columns, "items_found")
    found = decontamination.find_items(docs, shared.table(spark, sf_dir, "benchmark"), out=out)
    return found.filter(F.size(out) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the texts encoded and decoded again."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: Compression, component search and merges by rank are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        folder = shared.new_folder(spark, f"stage-{number}")
        done.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
