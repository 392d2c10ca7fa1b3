"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm.archives import archived
from switchyard.llm.decontam import contamination
from switchyard.llm.dedup import near_duplicates
from switchyard.llm.divergence import divergence
from switchyard.llm.maxent import scored
from switchyard.llm.merkle import manifest
from switchyard.llm.oracles import SQL
from switchyard.llm.packing import Packing, pack
from switchyard.llm.quality_qda import quality_report
from switchyard.llm.quality_rules import judged
from switchyard.llm.secrets import secret_report
from switchyard.llm.sharding import shard
from switchyard.llm.toxicity import toxicity_report
from switchyard.llm.urls import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_toxicity_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op3_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), Packing(public_tokenizers.path("word_bpe_49k.json")))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "contaminated", "n_items", ids.alias("item_ids"), "best_common")


def op9_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op10_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_arc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_distance, op2_secret_battery, op3_maxent_scoring, op4_curve_packing, op5_url_ratio, op6_minhash_dedup, op7_weak_supervision, op8_decontamination, op9_splitter_sharding, op10_quadratic_quality, op11_arc_conversion, op12_source_divergence, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
