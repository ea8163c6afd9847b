"""The corpus pipeline: five stages from raw documents to shards.

1. ``language``: documents in no learned language (no letters) go.
2. ``near_duplicates``: one document of each group of near copies stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``mixing``: every source is read once in full, small ones again, up to
   ``REPEATS`` times, at the temperature that this limit allows.
5. ``sharding``: the rows in byte-balanced shards, numbered.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``. An empty
table passes through as an empty one; null and empty texts fall to stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlens.llm import decontaminate, jaccard_join, langid, mixing, sharding
from boxlens.llm.common import table, written
from boxlens.llm.queries import language_model

REPEATS = 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified_kept(docs, language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, repeats=REPEATS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

# language models and sketches have no SQL form: the stages are tested against
# brute-force versions instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
