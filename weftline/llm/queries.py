"""The queries of this subpackage, one an operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, exact, language, matroska, merkle, middle, mixing, quality, repeats, simhash, trie, warc, wavelet
from weftline.llm.common import shared_folder, table


def op1_warc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op2_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.encode(table(spark, sf_dir, "documents")))


def op3_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "wavelet")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return wavelet.read_documents(spark, path)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_merkle_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc_splits": op1_warc_splits,
    "op2_matroska_packets": op2_matroska_packets,
    "op3_wavelet_matrix": op3_wavelet_matrix,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash_balls": op5_simhash_balls,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_quality_fm": op8_quality_fm,
    "op9_language_profiles": op9_language_profiles,
    "op10_merkle_edits": op10_merkle_edits,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_heavy_hitter_dedup": op12_heavy_hitter_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_warc_splits": warc.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op10_merkle_edits": merkle.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_heavy_hitter_dedup": exact.ORACLE,
    "op13_fill_in_middle": middle.ORACLE,
}
