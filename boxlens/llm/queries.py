"""The registered ``opN_<name>`` queries: thin views on the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm import (
    ann,
    arc,
    decontaminate,
    divergence,
    html_extract,
    importance,
    jaccard_join,
    langid,
    mixing,
    quality,
    secrets,
    sharding,
    token_counts,
)
from boxlens.llm.common import table

MIX_ENTROPY = 0.95  # of ln(number of sources)
PASS = 0.3  # quality score from which a text passes


def op1_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.remainder(5) == 0
    machine = quality.learn(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.scored(docs, machine).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.learn(docs.where(langid.remainder(3) != 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.remainder(3) == 1
    return langid.identify(docs, language_model(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), entropy=MIX_ENTROPY)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_min_cut_extraction, op2_factorisation_quality, op3_arc_to_warc, op4_language_id, op5_decontamination,
    op6_temperature_mixing, op7_jaccard_join, op8_histogram_sharding, op9_projection_forest, op10_secret_scan,
    op11_source_divergence, op12_importance_resampling, op13_token_counts)}
