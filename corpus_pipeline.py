"""A corpus from raw documents to packed sequences: five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeweave.llm import exact_dedup, mixing, packing, simhash, toxicity
from placeweave.llm.common import saved, table


#: Words of a shingle, and bits in which near duplicates' fingerprints differ at most.
NEAR_WORDS, NEAR_BITS = 3, 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id.

    Fingerprints of shingles of NEAR_WORDS words link at NEAR_BITS or fewer
    differing bits, as op6_simhash has them.
    """
    return simhash.keep_one(docs, NEAR_WORDS, NEAR_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for.

    No document is left out here: rates are at least one, so what a domain
    lacks is made up by repeating its documents. Toxic ones are no part of
    the mixture: what the first stage missed isn't repeated.
    """
    return mixing.repeated(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; each stage's result is written to the shared folder before the next.

    Null texts count as empty, rows that repeat an id are rows of their own
    until a stage drops them, other columns are carried along. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
