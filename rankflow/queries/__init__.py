"""Registered queries of the operators, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import choice, history, metric, misc, serving, teams
from .base import ORACLES, QUERIES

_ = (choice, history, metric, misc, serving, teams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
