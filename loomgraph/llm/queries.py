"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, jaccard, jpeg, mixing, packing, sharding, simhash, suffix, tokens, toxicity, trie, warc

SHARDS = [f"shard-{k:04d}" for k in range(sharding.SHARDS)]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary())
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(read(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.describe(jpeg.store(read(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align.align(read(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_simhash": op2_simhash,
        "op3_nearest": op3_nearest,
        "op4_token_counts": op4_token_counts,
        "op5_sharding": op5_sharding,
        "op6_suffix": op6_suffix,
        "op7_toxicity": op7_toxicity,
        "op8_jpeg": op8_jpeg,
        "op9_mixing": op9_mixing,
        "op10_packing": op10_packing,
        "op11_ngram_jaccard": op11_ngram_jaccard,
        "op12_alignment": op12_alignment,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_nearest": ann.nearest_sql(), "op5_sharding": sharding.shard_sql(SHARDS), "op9_mixing": mixing.MIX_SQL}
