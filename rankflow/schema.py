"""Schemas of the base tables, and views that give the driver's tables the same roles.

``games`` and ``participants`` have one row for each match and for each player
of a match.  The views build them from ``orders`` and ``lineitem`` (two
suppliers of an order meet), ``team_participants`` from all suppliers of an
order, and ``player_game`` from ``events``.  ``VIEWS_SQL`` holds the same views
as SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAMES = (
    "game_id long, started_at timestamp_ntz, finished_at timestamp_ntz, duration int, map_id long, map string, kind string, server string, patch string, season int, source_file string"
)
PARTICIPANTS = (
    "game_id long, profile_id long, result boolean, civilization string, civilization_randomized boolean, rating int, rating_diff int, mmr int, mmr_diff int, input_type string"
)
TEAM_PARTICIPANTS = PARTICIPANTS + ", team_id int"


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [x.split()[0] for x in ddl.split(",")]


PLAYER = "struct<profile_id:long,result:string,civilization:string,civilization_randomized:boolean,rating:int,rating_diff:int,mmr:int,mmr_diff:int,input_type:string>"
DUMP = (
    f"game_id long, started_at string, finished_at string, duration int, map_id long, map string, kind string, server string, patch string, teams array<array<{PLAYER}>>"
)
EVENTS = (
    "time_s double, command_index int, player_slot int, intent_category string, intent struct<is_queued:boolean,unit_pbgid:string,pbgid:string,technology_pbgid:string,"
    "producer_building_link_status:string,action_kind:string,resource_kind:string,selected_unit_count:double,cancel_kind:string,canceled_item_kind:string,canceled_pbgid:string,position_x:double,position_y:double>"
)
MAP_METADATA = (
    "map_id long, map string, map_type_primary string, map_geography_subtype string, has_water int, water_importance string, openness string, chokepoint_level string, trade_viability string, resource_scarcity string, map_metadata_confidence string, map_metadata_missing int"
)
PATCH_METADATA = ("patch string, patch_start_at date, patch_name string, season int, is_major_patch int, is_balance_patch int, is_map_pool_patch int, is_hotfix int, source_url string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Both engines evaluate these expressions.
_GAME = {
    "game_id": "o_orderkey",
    "started_at": "o_orderdate + INTERVAL 3 HOUR * (o_orderkey % 5)",
    "duration": "cast(300 + o_orderkey * 37 % 2400 AS INT)",
    "map_id": "o_orderkey % 7",
    "map": "concat('m', o_orderkey % 7)",
    "kind": "CASE WHEN o_orderkey % 10 = 0 THEN 'rm_solo' WHEN o_orderkey % 10 = 1 THEN 'qm_1v1' ELSE 'rm_1v1' END",
    "server": "concat('s', o_orderkey % 3)",
    "patch": "concat('p', year(o_orderdate) * 10 + (CASE WHEN month(o_orderdate) > 6 THEN 2 ELSE 1 END))",
    "season": "cast(year(o_orderdate) - 1994 AS INT)",
}
_PLAYER = {
    "game_id": "game_id",
    "profile_id": "profile_id",
    "result": "CASE WHEN game_id % 97 = 0 THEN NULL WHEN game_id % 2 = 0 THEN lo ELSE NOT lo END",
    "civilization": "concat('c', (game_id * 7 + profile_id * 3) % 6)",
    "civilization_randomized": "(game_id + profile_id) % 9 = 0",
    "rating": "cast(CASE WHEN (game_id + profile_id) % 13 = 0 THEN NULL ELSE 900 + (game_id * 17 + profile_id * 31) % 700 END AS INT)",
    "rating_diff": "cast(CASE WHEN game_id % 19 = 0 THEN NULL WHEN (game_id % 2 = 0) = lo THEN 5 + game_id % 20 ELSE -5 - game_id % 20 END AS INT)",
    "mmr": "cast(CASE WHEN (game_id + profile_id) % 11 = 0 THEN NULL ELSE 900 + (game_id * 13 + profile_id * 29) % 600 END AS INT)",
    "mmr_diff": "cast(CASE WHEN (game_id % 2 = 0) = lo THEN 7 ELSE -7 END AS INT)",
}
_TEAM = {
    "game_id": "game_id",
    "profile_id": "profile_id",
    "team_id": "team_id",
    "result": "CASE WHEN game_id % 2 = 0 THEN team_id = 0 ELSE team_id = 1 END",
    "civilization": "concat('c', (game_id * 7 + profile_id * 3) % 6)",
    "civilization_randomized": "(game_id + profile_id) % 9 = 0",
    "rating": "cast(CASE WHEN (game_id + profile_id) % 13 = 0 THEN NULL ELSE 500 + (game_id * 17 + profile_id * 31) % 900 END AS INT)",
    "mmr": "cast(CASE WHEN (game_id + profile_id) % 11 = 0 THEN NULL ELSE 500 + (game_id * 13 + profile_id * 29) % 900 END AS INT)",
}
_EVENT = {
    "game_id": "event_id",
    "profile_id": "user_id",
    "started_at": "ts",
    "civ": "event_type",
    "mmr": "value",
    "result": "cast(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INT)",
    "map": "concat('m', event_id % 4)",
    "season": "cast(weekofyear(ts) AS INT)",
    "duration": "cast(600 + event_id % 1800 AS INT)",
}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


VIEWS_SQL = {
    "games": f"SELECT {_listed(_GAME)} FROM orders",
    "duel": "SELECT game_id, unnest([lo_id, hi_id]) AS profile_id, unnest([true, false]) AS lo FROM "
    "(SELECT l_orderkey AS game_id, min(l_suppkey) AS lo_id, max(l_suppkey) AS hi_id FROM lineitem GROUP BY l_orderkey) WHERE lo_id < hi_id",
    "participants": f"SELECT {_listed(_PLAYER)} FROM duel",
    "member": "SELECT l_orderkey AS game_id, l_suppkey AS profile_id, cast(min(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS INT) AS team_id FROM lineitem GROUP BY ALL",
    "team_participants": f"SELECT {_listed(_TEAM)} FROM member WHERE game_id IN (SELECT game_id FROM member GROUP BY game_id HAVING count(DISTINCT team_id) = 2)",
    "player_game": f"SELECT {_listed(_EVENT)} FROM events",
}
_NEEDS = {"participants": ["duel"], "team_participants": ["member"]}


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{x} AS {name}" for name, x in _GAME.items()])


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.min("l_suppkey").alias("lo_id"), F.max("l_suppkey").alias("hi_id")).filter("lo_id < hi_id")
    two = F.explode(F.array(F.struct(F.col("lo_id").alias("profile_id"), F.lit(True).alias("lo")), F.struct(F.col("hi_id").alias("profile_id"), F.lit(False).alias("lo"))))
    return ends.select("game_id", two.alias("p")).select("game_id", "p.*").selectExpr(*[f"{x} AS {name}" for name, x in _PLAYER.items()])


def team_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = F.min(F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).cast("int").alias("team_id")
    member = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("profile_id")).agg(team)
    both = member.groupBy("game_id").agg(F.count_distinct("team_id").alias("n")).filter("n = 2")
    return member.join(both, "game_id", "left_semi").selectExpr(*[f"{x} AS {name}" for name, x in _TEAM.items()])


def player_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {name}" for name, x in _EVENT.items()])


def with_views(names: str, *ctes: str, recursive: bool = False) -> str:
    """``WITH`` and the views named (with what they need), then further CTEs."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in [*_NEEDS.get(name, []), name] if x not in wanted]
    parts = [f"{x} AS ({VIEWS_SQL[x]})" for x in wanted] + [x for x in ctes if x]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
