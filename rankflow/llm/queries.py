"""The queries of this subpackage: one thin query for each operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, line_dedup, lm_score, mixing, near_dedup, packing, quality, sharding, sql, url_filter
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold_percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), shards=40)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.labels_by_path(pages, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), packing.VOCABULARY))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), lm_score.good_documents(table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_dedup, op2_mixing, op3_sharding, op4_quality, op5_language, op6_url_filter, op7_line_dedup, op8_packing, op9_lm_score, op10_decontaminate]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": sql.near_dedup(4),
        "op2_mixing": sql.mixing(mixing.POWER, mixing.ROUNDS, mixing.TOLERANCE, 12, mixing.BUDGET, mixing.SEED, mixing.TOPICS, mixing.MOST),
        "op4_quality": sql.quality(quality.QUANTILE, quality.SPREAD, quality.SCALE, {x: quality.least_docs(x) for x in quality.QUANTILE}),
        "op9_lm_score": sql.lm_score(lm_score.PRIOR, lm_score.MASS, lm_score.LEAST, lm_score.DIGITS),
        "op10_decontaminate": sql.decontaminate(),
    }
