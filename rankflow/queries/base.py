"""The registry and the pieces that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.exprs import ONE_V_ONE_KINDS
from ..operators import pregame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits: engines add them up in different orders.  A tiny shift settles ties; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(x) + F.lit(1e-10), digits) + F.lit(0.0)).alias(x) if kind == "double" else F.col(x) for x, kind in df.dtypes])


def six(x: str) -> str:
    """The SQL of ``rounded``."""
    return f"round(({x})::DOUBLE + 1e-10::DOUBLE, 6) + 0.0::DOUBLE"


def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pregame.player_games(schema.games(spark, sf_dir), schema.participants(spark, sf_dir))


#: Columns of a decided duel's row that keep their names, and those that are made.
_KEPT = ["game_id", "profile_id", "civilization_randomized", *[f"{x}{y}" for x in ("rating", "mmr") for y in ("", "_diff")], "started_at", "duration", "map_id", "map", "patch", "season"]
_MADE = {"result": "CAST(result AS INT)", "civ": "civilization"}
PG = f"pg AS (FROM games JOIN participants USING (game_id) SELECT {', '.join(_KEPT)}, {', '.join(f'{x} AS {name}' for name, x in _MADE.items())} WHERE result IS NOT NULL AND list_contains({ONE_V_ONE_KINDS}, kind))"


def pg_sql(*ctes: str, views: str = "games participants", recursive: bool = False) -> str:
    return schema.with_views(views, PG, *ctes, recursive=recursive)


def over(keys: str, frame: str = "", order: str = "started_at, game_id") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {order} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def last_n(n: int) -> str:
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def days(n: int) -> str:
    return f"RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def total(x: str, keys: str, frame: str = BEFORE, order: str = "started_at, game_id") -> str:
    return f"coalesce(sum({x}) {over(keys, frame, order)}, 0)::BIGINT"


def number(keys: str) -> str:
    return f"row_number() {over(keys)} - 1"


def since_last(keys: str) -> str:
    return f"date_diff('day', (lag(started_at) {over(keys)})::DATE, started_at::DATE)"


#: SQL of the columns of player_stats and player_stats_ext.
STATS_SQL = {
    "games_lifetime_before": number("profile_id"),
    "wins_lifetime_before": total("result", "profile_id"),
    "games_season_before": f"count(*) {over('profile_id, season', 'RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING', 'started_at::DATE')}",
    "wins_season_before": total("result", "profile_id, season", "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING", "started_at::DATE"),
    "days_since_last_game": since_last("profile_id"),
} | {f"{c}_{n}_before": number(f"profile_id, {c}") if n == "games" else total("result", f"profile_id, {c}") for c in ("civ", "map") for n in ("games", "wins")}

EXT_SQL = {}
for _n in (7, 30, 60):
    EXT_SQL[f"civ_games_{_n}d"] = f"count(*) {over('profile_id, civ', days(_n), 'started_at')}"
    EXT_SQL[f"civ_wins_{_n}d"] = total("result", "profile_id, civ", days(_n), "started_at")
EXT_SQL["days_since_civ"] = since_last("profile_id, civ")
for _n in (7, 14, 30, 60):
    EXT_SQL[f"act_games_{_n}d"] = f"count(*) {over('profile_id', days(_n), 'started_at')}"
for _n in (3, 5, 10, 20):
    EXT_SQL[f"mmr_lag{_n}"] = f"lag(mmr, {_n}) {over('profile_id')}"
for _n in (10, 20):
    EXT_SQL[f"mmr_std_{_n}"] = six(f"stddev_samp(mmr) {over('profile_id', last_n(_n))}")
for _n in (5, 10, 20):
    EXT_SQL[f"recent_n_{_n}"] = f"count(*) {over('profile_id', last_n(_n))}"
    EXT_SQL[f"recent_w_{_n}"] = total("result", "profile_id", last_n(_n))
EXT_SQL["avg_dur_life"] = six(f"avg(duration) {over('profile_id', BEFORE)}")
EXT_SQL["avg_dur_20"] = six(f"avg(duration) {over('profile_id', last_n(20))}")
for _name, _test in (("short", "duration <= 900"), ("long", "duration > 1800")):
    EXT_SQL[f"{_name}_games"] = total(f"CASE WHEN {_test} THEN 1 ELSE 0 END", "profile_id")
    EXT_SQL[f"{_name}_wins"] = total(f"CASE WHEN {_test} THEN result ELSE 0 END", "profile_id")
EXT_SQL["civ_avg_dur"] = six(f"avg(duration) {over('profile_id, civ', BEFORE)}")

#: Full-precision forms, for further SQL to build on.
RAW_EXT_SQL = {k: v.replace("round((", "((").replace(")::DOUBLE + 1e-10::DOUBLE, 6) + 0.0::DOUBLE", ")::DOUBLE)") for k, v in EXT_SQL.items()}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


PS = f"ps AS (SELECT *, {listed(STATS_SQL)} FROM pg)"
PX = f"px AS (SELECT *, {listed(RAW_EXT_SQL)} FROM pg)"
#: A match's two rows as structs, the lower id first.
_DUO = "duo AS (SELECT game_id, first(ps ORDER BY profile_id) AS a, last(ps ORDER BY profile_id) AS b FROM ps GROUP BY game_id HAVING count(*) = 2)"
_EARLIER = lambda x: f"CAST(sum({x}) {over('civ_a, civ_b', BEFORE, 'season')} AS BIGINT) AS prior_{x}"
PRIORS = f"{_DUO}, by_season AS (SELECT a.civ AS civ_a, b.civ AS civ_b, a.season AS season, count(*) AS games, sum(a.result) AS wins FROM duo GROUP BY ALL), priors AS (FROM by_season SELECT civ_a, civ_b, season, {', '.join(map(_EARLIER, ('games', 'wins')))})"
_SHARED = ["started_at", "map", "patch", "season"]
_SIDES = {f"{name}_{s}": f"{s}.{x}" for s in ("a", "b") for name, x in {"profile_id": "profile_id", **pregame.BASE}.items()}
_PAIR = {"game_id": "game_id", "target": "a.result", **{x: f"a.{x}" for x in _SHARED}, **_SIDES}
TF = f"paired AS (SELECT {listed(_PAIR)} FROM duo), tf AS (FROM paired LEFT JOIN priors USING (civ_a, civ_b, season) SELECT paired.*, prior_games AS prior_matchup_games, prior_wins AS prior_matchup_wins)"
WIDE = "wide AS (SELECT tf.*, " + ", ".join(f"x{s}.{c} AS {c}_{s}" for s in ("a", "b") for c in EXT_SQL) + " FROM tf " + " ".join(f"LEFT JOIN px AS x{s} ON x{s}.game_id = tf.game_id AND x{s}.profile_id = tf.profile_id_{s}" for s in ("a", "b")) + ")"


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pregame.player_stats(player_rows(spark, sf_dir))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pregame.training_features(stats(spark, sf_dir))


def smooth_sql(w: str, n: str, s: float = 10.0, p: float = 0.5) -> str:
    return f"((coalesce({w}, 0) + {s * p}::DOUBLE) / (coalesce({n}, 0) + {s}::DOUBLE))"
