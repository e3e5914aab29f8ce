"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_planes, html_text, ngram_join, packing, revisits, rp_forest, secrets, shards, simhash, spaced_seeds, str_tree, suffixes, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.label_and_score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolved_pages(_read(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.stratified_shards(_read(spark, sf_dir, "documents"))


def op11_str_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return str_tree.hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.clusters(_read(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_toxicity, op2_revisits, op3_secrets, op4_neighbours, op5_suffixes, op6_simhash, op7_packing, op8_decontamination, op9_html, op10_sharding, op11_str_tree, op12_bit_planes, op13_ngram_join)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op2_revisits": revisits.ORACLE, "op10_sharding": shards.ORACLE, "op11_str_tree": str_tree.ORACLE, "op12_bit_planes": bit_planes.ORACLE, "op13_ngram_join": ngram_join.ORACLE}
