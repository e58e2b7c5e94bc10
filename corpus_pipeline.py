"""A training corpus from raw documents, stage by stage.

Each stage reads what the one before it wrote.  All but the last return the columns of
``documents``; the last lists the token sequences it has written.

Defined cases: null and empty texts pass the filters (they score as ordinary, have no
words to share and none that a benchmark has), are not part of the mix, and give no
tokens; very long texts are read whole; equal rows and equal texts are copies, of which
the second stage keeps the least row; among equal candidates the least id, then the
least key, decides; a null id counts as the largest; extra columns pass through the
first four stages whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import common, decontam, mixing, neardup, token_shards, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 80 % of their five-word shingles in common stays."""
    return neardup.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut down or repeated to their target weights."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, in binary shards; one row for each."""
    return token_shards.shards_of(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: Several stages (training, hashing, random draws) have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
