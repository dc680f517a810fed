"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes what its predecessor kept; a stage's result is written as
Parquet and read again before the next one.  A stage begins by removing the
intermediate tables of its predecessor, whose result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm.common import remove_written, table, written, written_since, written_so_far
from rankflow.llm.decontaminate import drop_contaminated
from rankflow.llm.mixing import sample_mix
from rankflow.llm.near_dedup import keep_one
from rankflow.llm.quality import keep_good
from rankflow.llm.sharding import shard_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, threshold_percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, shards=40)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of each stage's last call.
_TABLES: dict[str, list[str]] = {}


def _tidy(stage: Stage, before: str | None) -> Stage:
    """``stage``, which removes the tables of the stage ``before`` first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_written(spark, _TABLES.pop(before, []))
        mark = written_so_far()
        out = stage(spark, docs, sf_dir)
        _TABLES[stage.__name__] = written_since(mark)
        return out

    return run_stage


_ORDER = [quality_rules, near_dedup, decontamination, mixing, sharding]
STAGES = [(stage.__name__, _tidy(stage, before.__name__ if before else None)) for before, stage in zip([None, *_ORDER], _ORDER, strict=False)]

#: MinHash candidates and random draws have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
