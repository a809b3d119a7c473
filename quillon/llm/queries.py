"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, itq, lm, mixing, packing, quality, sharding, simhash, suffix, toxicity, trie, wavelet
from quillon.llm.common import scratch, table


def op1_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op4")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path)
    return wavelet.read_shards(spark, path)


def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group_documents(table(spark, sf_dir, "documents"), width=3, radius=3)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law behind op9: each source's size, weight and target."""
    by_source = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).groupBy("_source").agg(F.sum("size").alias("words"))
    goals = mixing.targets(by_source)
    return goals.select(F.when(F.col("_source") != "n", F.substr("_source", F.lit(2))).alias("source"), "source_size", "weight", (F.round("target", 3) + 0.0).alias("target"))


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_elias_fano_scores, op2_one_bit_search, op3_suffix_dedup, op4_wavelet_tokens, op5_itq_near_duplicates, op6_best_fit_packing, op7_simhash_groups, op8_co_training, op9_source_mixing, op10_feistel_sharding, op11_string_kernel_toxicity, op12_conversation_trie)
} | {"mixing_targets": mixing_targets}
