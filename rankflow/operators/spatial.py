"""Heatmaps of replay events in a frame common to both players: channels, time-gated deduplication, mirrored cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import grid_cell, keyword_class

CELLS = 64
GAP_S = 10.0
#: Channels by keywords of a name, in order of priority (fixed values).
CHANNELS = [("defence", ["tower", "wall", "gate", "keep", "outpost"]), ("military", ["barracks", "archery", "stable", "siege"]), ("economy", ["house", "farm", "mill", "lumber", "mining", "market", "town"]), ("religion", ["monastery", "mosque", "prayer"])]


def base_points(events: DataFrame) -> DataFrame:
    """(replay_id): each slot's mean position over its first building events."""
    first = events.filter("intent.position_x IS NOT NULL AND intent.position_y IS NOT NULL AND time_s <= 120 AND player_slot IN (1, 2)")
    mean = lambda s, c: F.avg(F.when(F.col("player_slot") == s, F.col(f"intent.position_{c}")))
    return first.groupBy("replay_id").agg(*[mean(s, c).alias(f"base{s}_{c}") for s in (1, 2) for c in ("x", "y")])


def cells(events: DataFrame, names: DataFrame | None = None, size: int = CELLS) -> DataFrame:
    """(replay_id, player_slot, time_s, channel, row, col): events with a place, in the acting player's frame."""
    placed = events.filter("intent.position_x IS NOT NULL AND intent.position_y IS NOT NULL AND player_slot IN (1, 2)").join(base_points(events), "replay_id")
    own = lambda c: F.when(F.col("player_slot") == 1, F.col(f"base1_{c}")).otherwise(F.col(f"base2_{c}"))
    other = lambda c: F.when(F.col("player_slot") == 1, F.col(f"base2_{c}")).otherwise(F.col(f"base1_{c}"))
    row, col = grid_cell(F.col("intent.position_x"), F.col("intent.position_y"), (own("x"), own("y")), (other("x"), other("y")), size)
    if names is not None:
        placed = placed.join(names.select(F.col("pbgid").cast("string").alias("_p"), "name"), F.col("intent.pbgid") == F.col("_p"), "left")
        channel = keyword_class("name", CHANNELS)
    else:
        channel = keyword_class("intent_category", CHANNELS)
    return placed.select("replay_id", "player_slot", F.coalesce("time_s", F.lit(0.0)).alias("time_s"), F.coalesce("command_index", F.lit(0)).alias("command_index"), channel.alias("channel"), row.alias("row"), col.alias("col"))


def gate_by_last_kept(rows: DataFrame, keys: list[str], gap: float = GAP_S) -> DataFrame:
    """Rows of each key at least ``gap`` seconds after the last row that was kept (not merely the last row)."""
    item = F.struct("time_s", "command_index")
    ordered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    start = F.struct(F.lit(-1e18).alias("last"), F.expr("cast(array() AS array<double>)").alias("kept"))
    step = lambda acc, x: F.when(x["time_s"] - acc["last"] >= gap, F.struct(x["time_s"].alias("last"), F.array_append(acc["kept"], x["time_s"]).alias("kept"))).otherwise(acc)
    kept = F.aggregate("all", start, step, lambda acc: acc["kept"])
    return ordered.select(*keys, F.explode(kept).alias("time_s"))


def heatmap(rows: DataFrame, size: int = CELLS, gap: float = GAP_S) -> DataFrame:
    """(replay_id, player_slot, channel, row, col, value): log(1 + events kept); the second player's map is mirrored."""
    kept = gate_by_last_kept(rows, ["replay_id", "player_slot", "channel", "row", "col"], gap)
    counts = kept.groupBy("replay_id", "player_slot", "channel", "row", "col").agg(F.log1p(F.count("*").cast("double")).alias("value"))
    return counts.withColumn("col", F.when(F.col("player_slot") == 2, size - 1 - F.col("col")).otherwise(F.col("col")))


def dense(rows: DataFrame, channels: list[str], size: int = CELLS) -> DataFrame:
    """One row for each replay with a flat float array (2 slots x channels x size x size); a replay is a bounded group."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((2, len(channels), size, size), dtype=np.float32)
        known = frame[frame["channel"].isin(channels)]
        place = known["channel"].map({x: k for k, x in enumerate(channels)}).to_numpy(dtype=np.int64)
        out[known["player_slot"].to_numpy() - 1, place, known["row"].to_numpy(), known["col"].to_numpy()] = known["value"]
        return pd.DataFrame({"replay_id": [frame["replay_id"].iloc[0]], "grid": [out.ravel()]})

    return rows.groupBy("replay_id").applyInPandas(one, "replay_id long, grid array<float>")
