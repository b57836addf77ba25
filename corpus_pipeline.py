"""Documents to token ids in five stages; each works on all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import bpe, exact, language, mixing, shingles
from voxloom.llm.common import kept, long_texts, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recognisable language go."""
    return language.keep_identified(long_texts(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.drop_exact_duplicates(long_texts(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar shingles (five words, Jaccard 0.8 or more, every such
    pair) the document with the smallest doc_id stays.  SimHash finds pairs first, a prefix join
    the pairs that its radius misses; the shingles themselves decide."""
    return shingles.drop_near_duplicates(long_texts(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in shuffled order."""
    return mixing.mixed_documents(long_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of their decoding."""
    return bpe.round_trip_digests(long_texts(docs), ids=True)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # models, fingerprints and token merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
