"""The corpus pipeline: five stages from raw documents to token ids.

Every stage but the last keeps the columns of documents, further ones too, whatever
their names; an empty table gives an empty table; texts are always taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, near, quality, repeats
from weftline.llm.common import shared_folder, table

#: Passages of over fifty words are about 250 bytes and more; shorter repeats stay.
REPEAT_BYTES = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. Null and empty texts are scored like others; repeated rows go or stay together."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the one of the smallest doc_id.

    Null and empty texts are one group; null ids come after all others; of rows repeated whole one stays.
    """
    return near.without_near_copies(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur anywhere else are cut out of the texts; documents that lose all stay, with an empty text; null texts stay null."""
    return repeats.without_repeats(docs, REPEAT_BYTES)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets. A null source is a source; null and empty texts have no words; repeated rows count each."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mix, and the characters that decoding gives back.

    Null and empty texts have no ids and no characters; copies are rows of their own.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    return decoded.select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.length(F.col("decoded").cast("string")).cast("bigint").alias("decoded_chars")
    )


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("repeats", no_repeats),
    ("mix", mixed_sources),
    ("tokens", tokens),
]

#: The classifier and the searches can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
