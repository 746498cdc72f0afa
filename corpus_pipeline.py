"""A pipeline from raw documents to packed training sequences.

Each stage works on all that the one before kept. Stages but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, near, packing, queries, suffix, toxicity
from loomgraph.session import Chain, materialise, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the training folds of ``labels``."""
    ship(spark)
    return toxicity.filter_toxic(docs, queries.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: that of the smallest id.

    SimHash goes first, keys of minima find those that its fingerprints can't reach, and
    all are verified exactly; ``jaccard.keep_one`` finds them without a chance of missing any.
    """
    ship(spark)
    return near.keep_one(docs)


def remove_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; documents with nothing left go."""
    ship(spark)
    return suffix.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, sources mixed to their target weights, in order of virtual finish time."""
    ship(spark)
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, in the order that the mix was written in."""
    ship(spark)
    return packing.pack(docs, queries.vocabulary(), order=packing.file_order(docs))


_CHAIN = Chain()
STAGES = [
    ("toxicity", _CHAIN.stage(0, drop_toxic)),
    ("simhash", _CHAIN.stage(1, drop_near_copies)),
    ("suffix_array", _CHAIN.stage(2, remove_long_repeats)),
    ("mixing", _CHAIN.stage(3, mix_sources)),
    ("packing", _CHAIN.stage(4, pack_sequences)),
]

#: Models, fingerprints and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, f"pipeline-{name}")
    return docs
