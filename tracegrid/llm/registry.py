"""Queries of the training-data operators and the SQL that some of them can be checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archive, codes, mixing, negatives, packing, pii, quality, sharding, simhash, styletree, toxicity, urlfilter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).drop("uid")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % ann.QUERY_EVERY == 0))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archived_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_packing, op4_nearest, op5_sharding, op6_quality, op7_style_tree, op8_archive, op9_simhash, op10_url_filter, op11_personal_data, op12_hard_negatives, op13_vector_codes)}
ORACLE_SQL = {"op4_nearest": ann.ORACLE, "op6_quality": quality.ORACLE, "op8_archive": archive.ORACLE, "op10_url_filter": urlfilter.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_vector_codes": codes.ORACLE}
