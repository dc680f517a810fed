"""Writers: idempotent appends, chunks, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators.joins import insert_new


def append_new(fresh: DataFrame, path: str, keys: list[str], partition: str | None = None) -> int:
    """Append the rows whose key isn't in the Parquet table yet; the number of rows written."""
    spark = fresh.sparkSession
    new = fresh.dropDuplicates(keys)
    if row_count(spark, path) is not None:
        new = insert_new(spark.read.parquet(path), new, keys)
    new = new.persist()
    n = new.count()
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    new.unpersist()
    return n


def missing_seasons(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of seasons that the table lacks."""
    return fresh.join(existing.select("season").distinct(), "season", "left_anti")


def overwrite_seasons(df: DataFrame, path: str) -> None:
    """Replace the seasons that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def write_chunk(df: DataFrame, path: str, csv: bool = False) -> None:
    """One more chunk, as Parquet or CSV."""
    writer = df.write.mode("append")
    (writer.option("header", True).csv if csv else writer.parquet)(path)


def write_table(df: DataFrame, path: str) -> str:
    """Write Parquet, or CSV beside it where Parquet can't hold the columns' types; returns the path written."""
    try:
        df.write.mode("overwrite").parquet(path)
        return path
    except AnalysisException:
        plain = [F.to_json(x).alias(x) if isinstance(df.schema[x].dataType, (ArrayType, MapType, StructType)) else F.col(x).cast("string").alias(x) for x in df.columns]
        df.select(*plain).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
        return f"{path}.csv"


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a Parquet table, None if there is none."""
    try:
        return spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows])


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small aggregate as one JSON or CSV file."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json)(path)
