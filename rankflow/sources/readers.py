"""Readers: match dumps, metadata, replay events, tech trees, live lobbies, other warehouses."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ONE_V_ONE_KINDS
from ..schema import DUMP, EVENTS, GAMES, MAP_METADATA, PARTICIPANTS, PATCH_METADATA, TEAM_PARTICIPANTS, names

SEASON_IN_NAME = r"_s(\d+)\.json"
MODE_IN_NAME = r"(rm_\dv\d|qm_\dv\d)"


def season_of(path: Column) -> Column:
    return F.when(F.regexp_extract(path, SEASON_IN_NAME, 1) != "", F.regexp_extract(path, SEASON_IN_NAME, 1).cast("int"))


def mode_of(path: Column) -> Column:
    return F.when(F.regexp_extract(path, MODE_IN_NAME, 1) != "", F.regexp_extract(path, MODE_IN_NAME, 1))


def result_of(x: Column) -> Column:
    """win and loss as true and false, anything else as null."""
    low = F.lower(x)
    return F.when(low == "win", True).when(low == "loss", False)


def utc(x: Column) -> Column:
    """An ISO time as a UTC time without zone (the session's zone is UTC)."""
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON dumps (one array in each file, perhaps gzipped).  Such a file can't be split: convert it to Parquet once."""
    raw = spark.read.schema(DUMP).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return raw.withColumns({"season": season_of(F.col("path")), "mode": mode_of(F.col("path")), "source_file": F.element_at(F.split("path", "/"), -1)})


def games_of(dump: DataFrame) -> DataFrame:
    out = dump.withColumns({"started_at": utc(F.col("started_at")), "finished_at": utc(F.col("finished_at"))})
    return out.select(*names(GAMES)).dropDuplicates(["game_id"])


def duels_of(dump: DataFrame, kinds: list[str] = ONE_V_ONE_KINDS) -> tuple[DataFrame, DataFrame]:
    """(games, participants) of 1v1 records: those of the kinds, with two players in all."""
    kept = dump.filter(F.col("kind").isin(kinds)).withColumn("players", F.flatten("teams")).filter(F.size("players") == 2)
    rows = kept.select("game_id", F.explode("players").alias("p")).select("game_id", "p.*").withColumn("result", result_of(F.col("result")))
    return games_of(kept), rows.select(*names(PARTICIPANTS)).dropDuplicates(["game_id", "profile_id"])


def teams_of(dump: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(games, participants with team_id) of records with two complete teams."""
    complete = (F.size("teams") == 2) & (F.size(F.col("teams")[0]) == F.size(F.col("teams")[1]))
    complete &= (F.size(F.col("teams")[0]) == size) if size else (F.size(F.col("teams")[0]) > 1)
    kept = dump.filter(complete)
    rows = kept.select("game_id", F.posexplode("teams").alias("team_id", "team")).select("game_id", "team_id", F.explode("team").alias("p")).select("game_id", "team_id", "p.*")
    return games_of(kept), rows.withColumn("result", result_of(F.col("result"))).select(*names(TEAM_PARTICIPANTS))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP_METADATA).option("header", True).csv(path)


def read_patches(spark: SparkSession, path: str | None, games: DataFrame | None = None) -> DataFrame:
    """Patch metadata from CSV; without a file, each patch's first match gives its start."""
    if path is not None:
        return spark.read.schema(PATCH_METADATA).option("header", True).csv(path)
    return games.filter("patch IS NOT NULL").groupBy("patch").agg(F.to_date(F.min("started_at")).alias("patch_start_at"), F.max("season").alias("season"))


def read_events(spark: SparkSession, path: str, name: str = r"(\d+)\.jsonl") -> DataFrame:
    """Replay events (a JSON object a line) with the replay's id from the file name; missing times and numbers are 0."""
    rows = spark.read.schema(EVENTS).json(path).withColumn("replay_id", F.regexp_extract(F.col("_metadata.file_path"), name, 1).cast("long"))
    return rows.withColumns({"time_s": F.coalesce("time_s", F.lit(0.0)), "command_index": F.coalesce("command_index", F.lit(0))})


def list_files(spark: SparkSession, path: str, name: str = r"(\d+)\.jsonl") -> DataFrame:
    """(path, id) of files whose name fits, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path")
    return files.withColumn("id", F.regexp_extract("path", name, 1)).filter("id <> ''").withColumn("id", F.col("id").cast("long"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet chunks whose columns differ, by name; missing columns are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of another warehouse, or an empty one of the schema where it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def tech_tree(items: DataFrame) -> DataFrame:
    """(pbgid, age, flags, total_resources, costs) from an array column ``data`` of catalogue items."""
    rows = items.select(F.explode("data").alias("i")).select("i.*")
    has = lambda *words: F.exists(F.coalesce("classes", F.array()), lambda c: F.lower(c).isin(*words))
    up = has("age_up", "ageup", "landmark", "age_up_upgrade")
    total = sum((F.coalesce(F.col(f"costs.{x}"), F.lit(0.0)) for x in ("food", "wood", "gold", "stone", "vizier", "olive_oil")), F.lit(0.0))
    known = rows.withColumns({"total_resources": total, "is_villager": has("worker", "villager"), "is_age_up_building": has("building", "landmark") & up, "is_age_up_tech": ~has("building", "landmark") & up, "ageup_to_tier": F.when(up, F.col("age") + 1)})
    return known.dropDuplicates(["pbgid"])


@F.pandas_udf(T.StringType())
def inflate(data: pd.Series) -> pd.Series:
    """zlib-compressed text (no built-in function does that)."""
    return data.map(lambda x: None if x is None else zlib.decompress(x).decode("utf-8", "replace"))


def decode_options(encoded: Column, schema: str) -> Column:
    """base64, zlib, JSON."""
    return F.from_json(inflate(F.unbase64(encoded)), schema)


def positional(raw: Column, fields: dict[str, tuple[int, str]]) -> Column:
    """A struct from a JSON array by position; what is missing or of another type is null."""
    items = F.from_json(raw, "array<string>")
    return F.struct(*[F.try_element_at(items, F.lit(k + 1)).try_cast(kind).alias(name) for name, (k, kind) in fields.items()])
