"""The corpus pipeline: toxicity, near-duplicates, mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each
works on all that the one before kept; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelink.llm import bpe, mixing, simhash, toxicity
from tracelink.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject; it is trained on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: SimHash neighbours (five-word shingles, 6 bits or fewer) and
    texts that share 0.8 or more of their five-word shingles."""
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by calibrated probabilities; all columns stay as they are, whatever their names."""
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: The stages' models and fingerprints cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
