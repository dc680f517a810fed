"""Windows over histories: strictly earlier rows, the last n rows, spans of time, earlier days, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .exprs import MICROS_A_DAY, day_number, micros

ORDER = ("started_at", "game_id")
START = Window.unboundedPreceding


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def prior(*keys: str) -> WindowSpec:
    """All rows before this one."""
    return ordered(*keys).rowsBetween(START, -1)


def last(n: int, *keys: str) -> WindowSpec:
    """The n rows before this one."""
    return ordered(*keys).rowsBetween(-n, -1)


def within_days(n: int, *keys: str) -> WindowSpec:
    """Rows of the n days before this one, at an earlier microsecond."""
    return Window.partitionBy(*keys).orderBy(micros("started_at")).rangeBetween(-n * MICROS_A_DAY, -1)


def earlier_days(*keys: str) -> WindowSpec:
    """Rows of earlier calendar days."""
    return Window.partitionBy(*keys).orderBy(day_number("started_at")).rangeBetween(START, -1)


def earlier_time(*keys: str) -> WindowSpec:
    """Rows at an earlier microsecond."""
    return Window.partitionBy(*keys).orderBy(micros("started_at")).rangeBetween(START, -1)


def count_before(*keys: str) -> Column:
    return (F.row_number().over(ordered(*keys)) - 1).cast("long")


def sum_over(x: Column | str, spec: WindowSpec) -> Column:
    return F.coalesce(F.sum(x).over(spec), F.lit(0)).cast("long")


def sequence(*keys: str) -> Column:
    return F.row_number().over(ordered(*keys)).cast("long")


def runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Gaps and islands: ``run`` numbers the runs of equal values, ``run_len`` counts within one."""
    w = ordered(key)
    starts = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    numbered = df.withColumn("run", F.sum(starts).over(w.rowsBetween(START, 0)).cast("long"))
    return numbered.withColumn("run_len", F.row_number().over(Window.partitionBy(key, "run").orderBy(*ORDER)).cast("long"))
