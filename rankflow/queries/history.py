"""Queries of pregame features, capped histories, careers and rating deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from ..operators import history, joins, pregame, rating
from .base import (
    BEFORE, EXT_SQL, PRIORS, PS, PX, STATS_SQL, TF, WIDE, add, days, last_n, listed, number, over, pg_sql, player_rows, since_last, six, smooth_sql, stats, total, training,
)

KEY = ["game_id", "profile_id"]


def _stats(columns):
    return lambda s, d: stats(s, d).select(*KEY, *columns)


def _ext(columns):
    return lambda s, d: pregame.player_stats_ext(player_rows(s, d)).select(*KEY, *columns)


for _name, _columns in {
    "w1_prior_games": ["games_lifetime_before", "civ_games_before", "map_games_before"],
    "w2_prior_wins": ["wins_lifetime_before", "civ_wins_before", "map_wins_before"],
    "w3_day_cutoff": ["games_season_before", "wins_season_before"],
    "w6_days_since": ["days_since_last_game"],
}.items():
    add(_name, _stats(_columns), pg_sql() + f"SELECT game_id, profile_id, {listed({c: STATS_SQL[c] for c in _columns})} FROM pg")
for _name, _columns in {
    "w4_time_range": [c for c in EXT_SQL if c.startswith(("civ_games_", "civ_wins_", "act_games_"))],
    "w7_lag_mmr": [c for c in EXT_SQL if c.startswith("mmr_lag")],
    "w8_mmr_std": ["mmr_std_10", "mmr_std_20"],
    "w9_recent_form": [c for c in EXT_SQL if c.startswith("recent_")],
    "w11_avg_duration": ["avg_dur_life", "avg_dur_20", "civ_avg_dur"],
    "w12_conditional_cumulative": ["short_games", "short_wins", "long_games", "long_wins"],
}.items():
    add(_name, _ext(_columns), pg_sql() + f"SELECT game_id, profile_id, {listed({c: EXT_SQL[c] for c in _columns})} FROM pg")

add("e1_base_predicate", lambda s, d: player_rows(s, d).select(*KEY, "result", "civ", "season"), pg_sql() + "SELECT game_id, profile_id, result, civ, season FROM pg")
add(
    "w5_daily_range",
    lambda s, d: player_rows(s, d).groupBy("profile_id", X.day_number("started_at").alias("day")).agg(F.count("*").alias("games"), F.sum("result").alias("wins")).withColumns(
        {f"{x}_{n}d": F.coalesce(F.sum(x).over(_by_day(n)), F.lit(0)) for n in (7, 30) for x in ("games", "wins")}
    ),
    pg_sql("daily AS (SELECT profile_id, started_at::DATE AS d, date_diff('day', DATE '1970-01-01', started_at::DATE)::INT AS day, count(*) AS games, sum(result)::BIGINT AS wins FROM pg GROUP BY ALL)")
    + "SELECT profile_id, day, games, wins, " + ", ".join(f"{total(x, 'profile_id', f'RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING', 'd')} AS {x}_{n}d" for n in (7, 30) for x in ("games", "wins")) + " FROM daily",
)


def _by_day(n):
    from pyspark.sql import Window

    return Window.partitionBy("profile_id").orderBy("day").rangeBetween(-n, -1)


add("a1_matchup_by_season", lambda s, d: joins.pair_up(stats(s, d), ["civ", "result"], shared=["season"]).groupBy("civ_a", "civ_b", "season").agg(F.count("*").alias("games"), F.sum("result_a").alias("wins")), pg_sql(PS, PRIORS) + "SELECT civ_a, civ_b, season, games, wins::BIGINT AS wins FROM by_season")
add("w14_matchup_priors", lambda s, d: pregame.matchup_priors(stats(s, d)), pg_sql(PS, PRIORS) + "SELECT * FROM priors")
add("j1_game_players", lambda s, d: schema.participants(s, d).join(schema.games(s, d), "game_id").select(*KEY, "map", "kind"), schema.with_views("games participants") + "SELECT game_id, profile_id, map, kind FROM participants JOIN games USING (game_id)")
add("j2_ordered_pairs", lambda s, d: joins.pair_up(player_rows(s, d), ["civ", "mmr"]), pg_sql() + "SELECT a.game_id, a.profile_id AS profile_id_a, a.civ AS civ_a, a.mmr AS mmr_a, b.profile_id AS profile_id_b, b.civ AS civ_b, b.mmr AS mmr_b FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id")
add("j3_opponents", lambda s, d: joins.with_opponents(player_rows(s, d).select(*KEY, "mmr"), ["mmr"]), pg_sql() + "SELECT a.game_id, a.profile_id, a.mmr, b.profile_id AS opponent_profile_id, b.mmr AS opponent_mmr FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id <> b.profile_id")

_TF_COLUMNS = ["game_id", "target", "profile_id_a", "profile_id_b", "civ_a", "civ_b", *[f"{x}_{s}" for s in ("a", "b") for x in pregame.BASE if x not in ("civ", "civ_rand")], "prior_matchup_games", "prior_matchup_wins"]
add("c1_pair_features", lambda s, d: training(s, d).select(*_TF_COLUMNS), pg_sql(PS, PRIORS, TF) + f"SELECT {', '.join(_TF_COLUMNS)} FROM tf")
add("j5_matchup_join", lambda s, d: training(s, d).select("game_id", "civ_a", "civ_b", "season", "prior_matchup_games"), pg_sql(PS, PRIORS, TF) + "SELECT game_id, civ_a, civ_b, season, prior_matchup_games FROM tf")

_F = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
_BASE_DERIVED = {f"{x}_wr_{s}": six(smooth_sql(f"{w}_wins_{s}" if w else f"wins_{x2}_{s}", f"{w}_games_{s}" if w else f"games_{x2}_{s}")) for s in ("a", "b") for x, x2, w in (("overall", "lifetime", ""), ("season", "season", ""), ("civ", "", "civ"), ("map", "", "map"))}
_BASE_DERIVED |= {
    "prior_matchup_wr_a": six(smooth_sql("prior_matchup_wins", "prior_matchup_games")),
    "wr_diff": six(f"{smooth_sql('wins_lifetime_a', 'games_lifetime_a')} - {smooth_sql('wins_lifetime_b', 'games_lifetime_b')}"),
    "games_diff": "games_lifetime_a - games_lifetime_b",
    **{f"{x}_diff": f"{x}_a - {x}_b" for x in ("mmr", "rating")},
    "skill_diff": "coalesce(mmr_a, rating_a) - coalesce(mmr_b, rating_b)",
    **{f"skill_{s}": f"coalesce(mmr_{s}, rating_{s})" for s in ("a", "b")},
    **{f"missing_{x}_{s}": _F(f"{x}_{s} IS NULL") for x in ("mmr", "rating") for s in ("a", "b")},
    **{f"missing_skill_{s}": _F(f"coalesce(mmr_{s}, rating_{s}) IS NULL") for s in ("a", "b")},
    **{f"is_new_player_{s}": _F(f"games_lifetime_{s} < 10") for s in ("a", "b")},
    "civs_known": _F("civ_a IS NOT NULL AND civ_b IS NOT NULL"), "map_known": _F("map IS NOT NULL"), "full_context_known": _F("civ_a IS NOT NULL AND civ_b IS NOT NULL AND map IS NOT NULL"),
}
for _name, _columns in {
    "e11_smoothed_rates": [c for c in _BASE_DERIVED if "_wr_" in c],
    "e12_skill": ["skill_a", "skill_b"],
    "e13_missing_flags": [c for c in _BASE_DERIVED if c.startswith("missing")],
    "e14_diffs": [c for c in _BASE_DERIVED if c.endswith("_diff")],
    "e15_context_flags": [c for c in _BASE_DERIVED if "known" in c or c.startswith("is_new")],
}.items():
    add(_name, lambda s, d, c=_columns: pregame.base_derived(training(s, d)).select("game_id", *c), pg_sql(PS, PRIORS, TF) + f"SELECT game_id, {listed({c: _BASE_DERIVED[c] for c in _columns})} FROM tf")


def _extended(*families):
    def run(s, d):
        rows = player_rows(s, d)
        return pregame.extend_features(training(s, d), families, pregame.player_stats_ext(rows), pregame.h2h_priors(rows))

    return run


def _both(make, names):
    out = {}
    for s in ("a", "b"):
        out |= make(s)
    return out | {f"{x}_diff": f"{out[f'{x}_a']} - {out[f'{x}_b']}" for x in names}


_zero = lambda x: f"coalesce({x}, 0)"
_P1 = _both(lambda s: {f"civ_wr_{n}d_{s}": smooth_sql(f"civ_wins_{n}d_{s}", f"civ_games_{n}d_{s}") for n in (7, 30, 60)} | {f"civ_frac_{n}d_{s}": f"({_zero(f'civ_games_{n}d_{s}')}::DOUBLE / greatest({_zero(f'act_games_{n}d_{s}')}, 1))" for n in (30, 60)}, ["civ_wr_30d", "civ_wr_60d", "civ_frac_30d", "civ_frac_60d"])
_P2 = _both(lambda s: {f"mmr_change_{n}_{s}": f"(mmr_{s} - mmr_lag{n}_{s})" for n in (3, 5, 10, 20)} | {f"mmr_slope_{n}_{s}": f"((mmr_{s} - mmr_lag{n}_{s})::DOUBLE / {n})" for n in (10, 20)} | {f"mmr_std_{n}_{s}": f"mmr_std_{n}_{s}" for n in (10, 20)}, ["mmr_change_10", "mmr_change_20", "mmr_slope_10", "mmr_std_10", "mmr_std_20"])
_P2 |= {f"mmr_rising_10_{s}": _F(f"coalesce(mmr_{s} - mmr_lag10_{s}, 0) > 0") for s in ("a", "b")}
_P3 = _both(lambda s: {f"recent_wr_{n}_{s}": smooth_sql(f"recent_w_{n}_{s}", f"recent_n_{n}_{s}") for n in (5, 10, 20)}, [f"recent_wr_{n}" for n in (5, 10, 20)])
_P4 = _both(lambda s: {f"{x}_wr_{s}": smooth_sql(f"{x}_wins_{s}", f"{x}_games_{s}") for x in ("short", "long")} | {f"{x}_share_{s}": f"({_zero(f'{x}_games_{s}')}::DOUBLE / greatest(games_lifetime_{s}, 1))" for x in ("short", "long")}, ["short_wr", "long_wr", "short_share", "long_share"])
_P4 |= {f"{x}_diff": f"{_zero(f'{x}_a')} - {_zero(f'{x}_b')}" for x in ("avg_dur_life", "avg_dur_20", "civ_avg_dur")}
_P9 = {f"inactive_{n}d_{s}": _F(f"{_zero(f'act_games_{n}d_{s}')} = 0") for n in (30, 7) for s in ("a", "b")} | {f"act_games_{n}d_diff": f"{_zero(f'act_games_{n}d_a')} - {_zero(f'act_games_{n}d_b')}" for n in (7, 14, 30)}
_INTEGER = ("mmr_change", "mmr_rising", "inactive", "act_games")
for _name, _family, _columns in (("e16_p1_civ_recency", "civ_recency", _P1), ("e17_p2_mmr_trend", "mmr_trend", _P2), ("e18_p3_recent_form", "adjusted_form", _P3), ("e19_p4_durations", "duration_profile", _P4), ("e23_p9_activity", "activity_session", _P9)):
    add(_name, lambda s, d, f=_family, c=list(_columns): _extended(f)(s, d).select("game_id", *c), pg_sql(PS, PRIORS, TF, PX, WIDE) + f"SELECT game_id, {listed({k: v if k.startswith(_INTEGER) else six(v) for k, v in _columns.items()})} FROM wide")

_H2H = f"h2h AS (SELECT a.game_id, a.profile_id AS pid_lo, b.profile_id AS pid_hi, a.started_at, a.result AS lo_wins FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id), h2p AS (SELECT game_id, pid_lo, pid_hi, {number('pid_lo, pid_hi')} AS h2h_games_before, {total('lo_wins', 'pid_lo, pid_hi')} AS h2h_wins_lo_before FROM h2h)"
add("w13_head_to_head", lambda s, d: pregame.h2h_priors(player_rows(s, d)), pg_sql(_H2H) + "SELECT * FROM h2p")
add("e20_p5_head_to_head", lambda s, d: _extended("head_to_head")(s, d).select("game_id", "h2h_games", "h2h_wins_a", "h2h_wr_a", "h2h_has_data"), pg_sql(_H2H) + f"SELECT game_id, h2h_games_before AS h2h_games, h2h_wins_lo_before AS h2h_wins_a, {six(smooth_sql('h2h_wins_lo_before', 'h2h_games_before', 5.0))} AS h2h_wr_a, {_F('h2h_games_before >= 3')} AS h2h_has_data FROM h2p")
_P8 = {"both_mmr_missing": _F("mmr_a IS NULL AND mmr_b IS NULL"), "a_mmr_missing_only": _F("mmr_a IS NULL AND mmr_b IS NOT NULL"), "b_mmr_missing_only": _F("mmr_a IS NOT NULL AND mmr_b IS NULL")}
_P8 |= {f"{s}_low_lt{n}": _F(f"games_lifetime_{s} < {n}") for s in ("a", "b") for n in (5, 10, 20)} | {f"is_first10_season_{s}": _F(f"games_season_{s} < 10") for s in ("a", "b")}
_P8 |= {"one_low_one_est": _F("(games_lifetime_a < 20) <> (games_lifetime_b < 20)"), "both_low": _F("games_lifetime_a < 20 AND games_lifetime_b < 20")}
add("c2_p8_low_history", lambda s, d: pregame.p8_derived(pregame.base_derived(training(s, d))).select("game_id", *_P8), pg_sql(PS, PRIORS, TF) + f"SELECT game_id, {listed(_P8)} FROM tf")

_MAPS_SQL = "maps AS (SELECT DISTINCT map_id, 't' || (map_id % 3) AS map_type_primary, 'o' || (map_id % 2) AS openness, 'c' || (map_id % 2) AS chokepoint_level FROM games)"


def _maps(s, d):
    name = lambda p, n: F.concat(F.lit(p), F.col("map_id") % n)
    return schema.games(s, d).select("map_id").distinct().select("map_id", name("t", 3).alias("map_type_primary"), name("o", 2).alias("openness"), name("c", 2).alias("chokepoint_level"))


_ARCH = {f"{n}_{k}_before": number(f"profile_id, {c}") if k == "games" else total("result", f"profile_id, {c}") for n, c in (("map_type", "map_type_primary"), ("openness", "openness")) for k in ("games", "wins")}
add("j6_map_archetypes", lambda s, d: pregame.map_archetype_stats(player_rows(s, d), _maps(s, d)).select(*KEY, "map_type_primary", *_ARCH), pg_sql(_MAPS_SQL) + f"SELECT game_id, profile_id, map_type_primary, {listed(_ARCH)} FROM pg LEFT JOIN maps USING (map_id)")


def _p6(s, d):
    sides = {"map_type_games": "map_type_games_before", "map_type_wins": "map_type_wins_before", "openness_games": "openness_games_before", "openness_wins": "openness_wins_before"}
    arch = pregame.map_archetype_stats(player_rows(s, d), _maps(s, d)).select(*KEY, *[F.col(v).alias(k) for k, v in sides.items()])
    return pregame.p6_derived(joins.join_roles(training(s, d).select("game_id", "profile_id_a", "profile_id_b"), arch, list(sides))).select("game_id", "map_type_wr_a", "map_type_wr_b", "openness_wr_a", "map_type_wr_diff", "openness_wr_diff")


_w6 = lambda n, s: smooth_sql(f"{s}.{n}_wins_before", f"{s}.{n}_games_before")
add("e21_p6_map_rates", _p6, pg_sql(_MAPS_SQL, f"arch AS (SELECT game_id, profile_id, {listed(_ARCH)} FROM pg LEFT JOIN maps USING (map_id))") + f"SELECT a.game_id, {six(_w6('map_type', 'a'))} AS map_type_wr_a, {six(_w6('map_type', 'b'))} AS map_type_wr_b, {six(_w6('openness', 'a'))} AS openness_wr_a, {six(_w6('map_type', 'a') + ' - ' + _w6('map_type', 'b'))} AS map_type_wr_diff, {six(_w6('openness', 'a') + ' - ' + _w6('openness', 'b'))} AS openness_wr_diff FROM arch AS a JOIN arch AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id")
_MPP = (
    "starts AS (SELECT patch, min(started_at) AS patch_start_at FROM games GROUP BY patch), bp AS (SELECT map_id, patch, patch_start_at, count(*) AS games, sum(duration) AS dur, sum(CASE WHEN duration <= 900 THEN 1 ELSE 0 END) AS sh, sum(CASE WHEN duration >= 1800 THEN 1 ELSE 0 END) AS lo "
    "FROM games JOIN starts USING (patch) WHERE kind = 'rm_1v1' AND map_id IS NOT NULL GROUP BY ALL), "
    f"mpp AS (SELECT map_id, patch, patch_start_at, (sum(games) {over('map_id', BEFORE, 'patch_start_at')})::BIGINT AS prior_map_games, " + ", ".join(f"(sum({c}) {over('map_id', BEFORE, 'patch_start_at')})::DOUBLE / (sum(games) {over('map_id', BEFORE, 'patch_start_at')}) AS {n}" for n, c in (("prior_avg_duration", "dur"), ("prior_short_game_share", "sh"), ("prior_long_game_share", "lo"))) + " FROM bp)"
)
add("w14_map_patch_priors", lambda s, d: pregame.map_patch_priors(schema.games(s, d)), schema.with_views("games", _MPP) + "SELECT map_id, patch, patch_start_at, prior_map_games, " + ", ".join(f"{six(c)} AS {c}" for c in ("prior_avg_duration", "prior_short_game_share", "prior_long_game_share")) + " FROM mpp")
add("e22_p7_map_priors", lambda s, d: pregame.p7_derived(schema.games(s, d).select("game_id", "map_id", "patch").join(pregame.map_patch_priors(schema.games(s, d)), ["map_id", "patch"], "left")).select("game_id", "prior_map_games", "log_prior_map_games"), schema.with_views("games", _MPP) + f"SELECT game_id, coalesce(prior_map_games, 0) AS prior_map_games, {six('ln(coalesce(prior_map_games, 0) + 1)')} AS log_prior_map_games FROM games LEFT JOIN mpp USING (map_id, patch)")
add("e7_log1p", lambda s, d: player_rows(s, d).select(*KEY, F.log1p(F.col("duration").cast("double")).alias("l"), F.ln(F.col("duration").cast("double")).alias("n")), pg_sql() + f"SELECT game_id, profile_id, {six('ln(duration + 1)')} AS l, {six('ln(duration)')} AS n FROM pg")
add("w20_civ_patch_games", lambda s, d: pregame.civ_extra(player_rows(s, d)).select(*KEY, "days_since_civ", "civ_games_patch"), pg_sql() + f"SELECT game_id, profile_id, {since_last('profile_id, civ')} AS days_since_civ, {total('1', 'profile_id, civ, patch')} AS civ_games_patch FROM pg")
add("w26_sequence", lambda s, d: history.visible_games(player_rows(s, d), 5).select(*KEY, "seq"), pg_sql() + f"SELECT game_id, profile_id, row_number() {over('profile_id')} AS seq FROM pg")
add("j4_role_joins", lambda s, d: joins.join_roles(training(s, d).select("game_id", "profile_id_a", "profile_id_b"), player_rows(s, d).select(*KEY, "mmr"), ["mmr"]), pg_sql(PS, PRIORS, TF) + "SELECT game_id, profile_id_a, profile_id_b, mmr_a, mmr_b FROM tf")
add("j7_semi_prefilter", lambda s, d: player_rows(s, d).join(schema.games(s, d).filter("season = 3").select("game_id"), "game_id", "left_semi").select(*KEY), pg_sql() + "SELECT game_id, profile_id FROM pg WHERE game_id IN (SELECT game_id FROM games WHERE season = 3)")

# Capped histories: the oracle joins ranges, the operator doesn't.
_CAP = 30
_ORD = f"ord AS (SELECT *, row_number() {over('profile_id')} AS seq, {since_last('profile_id')} AS gap FROM pg)"
_SAME, _DAYS = "p.civ = c.civ", lambda n: f"p.started_at >= c.started_at - INTERVAL {n} DAYS"
_count = lambda c="true": f"count(p.game_id) FILTER ({c})"
_sum = lambda c="true": f"coalesce(sum(p.result) FILTER ({c}), 0)::BIGINT"
_CAPPED = {
    "visible_games": _count(), "avg_dur_life": six("avg(p.duration)"), "civ_avg_dur": six(f"avg(p.duration) FILTER ({_SAME})"), "avg_dur_20": six("avg(p.duration) FILTER (p.seq >= c.seq - 20)"),
    **{f"civ_{k}_{n}d": f(f"{_SAME} AND {_DAYS(n)}") for n in (7, 30, 60) for k, f in (("games", _count), ("wins", _sum))},
    "days_since_civ": f"date_diff('day', (max(p.started_at) FILTER ({_SAME}))::DATE, c.started_at::DATE)", **{f"act_games_{n}d": _count(_DAYS(n)) for n in (30, 60)},
    **{f"{x}_{k}": f(t) for x, t in (("short", "p.duration <= 900"), ("long", "p.duration > 1800")) for k, f in (("games", _count), ("wins", _sum))},
}
_CAPPED_BASE = {"games_lifetime": _count(), "wins_lifetime": _sum(), "games_season": _count("p.season = c.season"), "wins_season": _sum("p.season = c.season"), "civ_games": _count(_SAME), "civ_wins": _sum(_SAME), "map_games": _count("p.map = c.map"), "map_wins": _sum("p.map = c.map")}
_FROM = f"FROM ord AS c LEFT JOIN ord AS p ON p.profile_id = c.profile_id AND p.seq BETWEEN c.seq - {_CAP} AND c.seq - 1 GROUP BY c.game_id, c.profile_id, c.started_at, c.civ, c.seq, c.season, c.map"
_sided = lambda columns, name: f"{name} AS (SELECT a.game_id, " + ", ".join(f"{s}.{x} AS {x}_{s}" for s in ("a", "b") for x in columns) + " FROM side AS a JOIN side AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id)"


def _training_keys(s, d):
    return joins.pair_up(player_rows(s, d), [])


add("j10_bounded_range", lambda s, d: history.capped_stats(player_rows(s, d), _CAP).select(*KEY, "visible_games", "avg_dur_life", "act_games_30d"), pg_sql(_ORD) + f"SELECT c.game_id, c.profile_id, {listed({k: _CAPPED[k] for k in ('visible_games', 'avg_dur_life', 'act_games_30d')})} {_FROM}")
_SEEN = f"seen AS (SELECT c.game_id, c.profile_id, p.game_id AS past, p.result FROM ord AS c JOIN ord AS p ON p.profile_id = c.profile_id AND p.seq BETWEEN c.seq - {_CAP} AND c.seq - 1)"
_MEET = "meet AS (SELECT t.game_id, count(y.past) AS h2h_games, coalesce(sum(x.result) FILTER (y.past IS NOT NULL), 0)::BIGINT AS h2h_wins_a FROM (SELECT a.game_id, a.profile_id AS pa, b.profile_id AS pb FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id) AS t LEFT JOIN seen AS x ON x.game_id = t.game_id AND x.profile_id = t.pa LEFT JOIN seen AS y ON y.game_id = t.game_id AND y.profile_id = t.pb AND y.past = x.past GROUP BY t.game_id)"
add("j11_mutual_visibility", lambda s, d: history.capped_overrides(_training_keys(s, d), player_rows(s, d), _CAP).select("game_id", "h2h_games", "h2h_wins_a"), pg_sql(_ORD, _SEEN, _MEET) + "SELECT game_id, h2h_games, h2h_wins_a FROM meet")
add("c3_capped_overrides", lambda s, d: history.capped_overrides(_training_keys(s, d), player_rows(s, d), _CAP), pg_sql(_ORD, f"side AS (SELECT c.game_id, c.profile_id, {listed(_CAPPED)} {_FROM})", _SEEN, _MEET, _sided(_CAPPED, "both_sides")) + "SELECT b.*, h2h_games, h2h_wins_a FROM both_sides AS b JOIN meet USING (game_id)")
add("c4_capped_base", lambda s, d: history.capped_base_overrides(_training_keys(s, d), player_rows(s, d), _CAP), pg_sql(_ORD, f"side AS (SELECT c.game_id, c.profile_id, {listed(_CAPPED_BASE)} {_FROM})", _sided(_CAPPED_BASE, "both_sides")) + "SELECT * FROM both_sides")
_CAREER = f"career AS (SELECT *, max(mmr) {over('profile_id', BEFORE)} AS peak_mmr, avg(mmr) {over('profile_id', BEFORE)} AS career_avg_mmr FROM ps)"
add("w16_career_windows", lambda s, d: history.career(stats(s, d)), pg_sql(PS, _CAREER) + f"SELECT game_id, profile_id, games_lifetime_before AS career_games, wins_lifetime_before AS career_wins, civ_games_before AS career_civ_games, civ_wins_before AS career_civ_wins, peak_mmr, {six('career_avg_mmr')} AS career_avg_mmr FROM career")
_cw = {s: smooth_sql(f"{s}.wins_lifetime_before", f"{s}.games_lifetime_before") for s in ("a", "b")}
add(
    "c5_career_block",
    lambda s, d: history.apply_career(training(s, d), history.career(stats(s, d))).select("game_id", "career_wr_a", "career_wr_b", "career_civ_wr_a", "mmr_vs_peak_a", "mmr_vs_career_avg_b", "career_wr_diff", "career_games_diff", "peak_mmr_diff", "career_avg_mmr_diff"),
    pg_sql(PS, _CAREER) + f"SELECT a.game_id, {six(_cw['a'])} AS career_wr_a, {six(_cw['b'])} AS career_wr_b, {six(smooth_sql('a.civ_wins_before', 'a.civ_games_before'))} AS career_civ_wr_a, a.mmr - a.peak_mmr AS mmr_vs_peak_a, {six('b.mmr - b.career_avg_mmr')} AS mmr_vs_career_avg_b, {six(_cw['a'] + ' - ' + _cw['b'])} AS career_wr_diff, a.games_lifetime_before - b.games_lifetime_before AS career_games_diff, a.peak_mmr - b.peak_mmr AS peak_mmr_diff, {six('a.career_avg_mmr - b.career_avg_mmr')} AS career_avg_mmr_diff FROM career AS a JOIN career AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id",
)
_TEMP = {"window_span_days": "date_diff('day', min(p.started_at)::DATE, c.started_at::DATE)", "gap_mean_window": six("avg(p.gap)"), "gap_max_window": "max(p.gap)", "wt_act_7d": _count(_DAYS(7)), "wt_act_30d": _count(_DAYS(30)), "wt_visible": _count()}
_dens = {s: f"(wt_visible_{s}::DOUBLE / (greatest(coalesce(window_span_days_{s}, 0), 0) + 1))" for s in ("a", "b")}
add(
    "c6_window_temporal",
    lambda s, d: history.apply_temporal(_training_keys(s, d), player_rows(s, d), _CAP).drop("profile_id_a", "profile_id_b"),
    pg_sql(_ORD, f"side AS (SELECT c.game_id, c.profile_id, {listed(_TEMP)} {_FROM})", _sided(_TEMP, "both_sides")) + f"SELECT * EXCLUDE (wt_visible_a, wt_visible_b), {six(_dens['a'])} AS games_per_day_window_a, {six(_dens['b'])} AS games_per_day_window_b, {six(_dens['a'] + ' - ' + _dens['b'])} AS games_per_day_window_diff, " + ", ".join(f"{_zero(f'{x}_a')} - {_zero(f'{x}_b')} AS {x}_diff" for x in ("window_span_days", "gap_max_window", "wt_act_30d")) + " FROM both_sides",
)

# Rating deltas.
_RATE = lambda n: f"(coalesce(sum(result) {over('profile_id', last_n(n))}, 0)::DOUBLE / nullif(least(row_number() {over('profile_id')} - 1, {n}), 0))"
_RUNS = f"brk AS (SELECT *, CASE WHEN result = lag(result) {over('profile_id')} THEN 0 ELSE 1 END AS b FROM pg), grp AS (SELECT *, sum(b) {over('profile_id', 'ROWS UNBOUNDED PRECEDING')} AS g FROM brk), run AS (SELECT *, row_number() {over('profile_id, g')} AS run_len FROM grp)"
_STREAK = f"coalesce(lag((CASE WHEN result = 1 THEN 1 ELSE -1 END) * run_len) {over('profile_id')}, 0)"
_HIST = f"hist AS (SELECT *, {number('profile_id')} AS games_lifetime_before, {number('profile_id, season')} AS games_this_season_before, {since_last('profile_id')} AS days_since_last_game, {_STREAK} AS current_streak, {_RATE(10)} AS recent_wr_10, {_RATE(20)} AS recent_wr_20 FROM run)"
_FRAME = (
    "frame AS (SELECT m.game_id, m.started_at, m.season, m.patch, m.map, m.profile_id, o.profile_id AS opponent_profile_id, m.rating AS player_rating_before, o.rating AS opponent_rating_before, m.rating - o.rating AS visible_rating_gap, m.mmr AS player_mmr_before, o.mmr AS opponent_mmr_before, m.mmr - o.mmr AS hidden_mmr_gap, "
    "m.result, m.rating_diff AS observed_rating_delta, m.mmr_diff AS observed_hidden_mmr_delta, m.games_lifetime_before, m.games_this_season_before, o.games_this_season_before AS opponent_games_this_season_before, m.days_since_last_game, m.current_streak, m.recent_wr_10, m.recent_wr_20, "
    f"{_F('m.rating IS NULL')} AS missing_player_rating, {_F('o.rating IS NULL')} AS missing_opponent_rating, {_F('m.mmr IS NULL')} AS missing_player_mmr, {_F('o.mmr IS NULL')} AS missing_opponent_mmr FROM hist AS m JOIN hist AS o ON m.game_id = o.game_id AND m.profile_id <> o.profile_id WHERE m.rating_diff IS NOT NULL)"
)
RATING_SQL = pg_sql(_RUNS, _HIST, _FRAME)


def rating_frame(s, d):
    return rating.rating_frame(schema.games(s, d), schema.participants(s, d))


add("w10_recent_rate", lambda s, d: rating.history(player_rows(s, d)).select(*KEY, "recent_wr_10", "recent_wr_20"), pg_sql() + f"SELECT game_id, profile_id, {six(_RATE(10))} AS recent_wr_10, {six(_RATE(20))} AS recent_wr_20 FROM pg")
add("w18_streaks", lambda s, d: rating.history(player_rows(s, d)).select(*KEY, "current_streak"), pg_sql(_RUNS) + f"SELECT game_id, profile_id, {_STREAK} AS current_streak FROM run")
add("c27_rating_frame", rating_frame, RATING_SQL + f"SELECT * REPLACE ({six('recent_wr_10')} AS recent_wr_10, {six('recent_wr_20')} AS recent_wr_20) FROM frame")
add(
    "c29_validation",
    lambda s, d: rating.validate(rating_frame(s, d)),
    RATING_SQL + "SELECT *, CASE WHEN winner_positive < 0.8 THEN 1 ELSE 0 END AS fatal, CASE WHEN winner_positive < 0.95 THEN 1 ELSE 0 END AS warning FROM (SELECT count(*) AS rows, "
    + six("(count(*) FILTER (result = 1 AND observed_rating_delta > 0))::DOUBLE / nullif(count(*) FILTER (result = 1), 0)") + " AS winner_positive, " + six("(count(*) FILTER (result = 0 AND observed_rating_delta < 0))::DOUBLE / nullif(count(*) FILTER (result = 0), 0)") + " AS loser_negative, "
    + ", ".join(f"{six(f'quantile_cont(observed_rating_delta, {q / 100})')} AS delta_p{q:02d}" for q in (5, 25, 50, 75, 95)) + " FROM frame)",
)
_STATE = "rk AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, game_id DESC) AS rn FROM pg), nw AS (SELECT profile_id, result AS newest FROM rk WHERE rn = 1)"
add(
    "c33_live_state",
    lambda s, d: rating.player_state(player_rows(s, d)),
    pg_sql(_STATE) + "SELECT profile_id, games, rating, mmr, recent_wr_10, recent_wr_20, CASE WHEN newest = 1 THEN r ELSE -r END AS streak FROM (SELECT profile_id, any_value(newest) AS newest, count(*) AS games, arg_min(rating + coalesce(rating_diff, 0), rn) FILTER (rating IS NOT NULL) AS rating, arg_min(mmr + coalesce(mmr_diff, 0), rn) FILTER (mmr IS NOT NULL) AS mmr, "
    f"coalesce(min(rn) FILTER (result <> newest) - 1, count(*)) AS r, {six('avg(result) FILTER (rn <= 10)')} AS recent_wr_10, {six('avg(result) FILTER (rn <= 20)')} AS recent_wr_20 FROM rk JOIN nw USING (profile_id) GROUP BY profile_id)",
)
_DELTA = "32.0::DOUBLE * (r - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (other - own) / 400.0::DOUBLE)))"
add(
    "c34_conditional_deltas",
    lambda s, d: rating.conditional_deltas(joins.pair_up(player_rows(s, d), ["rating"])),
    pg_sql("four AS (SELECT a.game_id, x.side, r.r, CASE WHEN x.side = 'a' THEN a.rating ELSE b.rating END AS own, CASE WHEN x.side = 'a' THEN b.rating ELSE a.rating END AS other FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id, (SELECT unnest(['a', 'b']) AS side) AS x, (SELECT unnest([0, 1]) AS r) AS r)")
    + f"SELECT game_id, side, r AS result, {six(_DELTA)} AS delta, round({_DELTA})::BIGINT AS delta_rounded, floor({_DELTA})::BIGINT AS delta_floor, concat_ws(',', CASE WHEN own IS NULL THEN 'no_rating' END, CASE WHEN other IS NULL THEN 'no_opponent_rating' END) AS warnings FROM four",
)
_COLD = {"skill_a": "coalesce(a, round(b - 250), 1000)::DOUBLE", "skill_b": "coalesce(b, round(a - 250), 1000)::DOUBLE"}
add(
    "e25_cold_start",
    lambda s, d: X.cold_start(joins.pair_up(player_rows(s, d), ["mmr", "rating"])).select("game_id", "skill_a", "skill_b", "imputed", "impute_method"),
    pg_sql("two AS (SELECT a.game_id, coalesce(a.mmr, a.rating) AS a, coalesce(b.mmr, b.rating) AS b FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id)")
    + f"SELECT game_id, {_COLD['skill_a']} AS skill_a, {_COLD['skill_b']} AS skill_b, {_F('a IS NULL')} + {_F('b IS NULL')} AS imputed, CASE WHEN a IS NULL AND b IS NULL THEN 'global_baseline' WHEN a IS NULL OR b IS NULL THEN 'opponent_aware' END AS impute_method FROM two",
)
_EVENT_ROWS = lambda s, d: schema.player_game(s, d)
add(
    "w4_event_time_range",
    lambda s, d: _EVENT_ROWS(s, d).select(*KEY, F.count("*").over(_W.within_days(7, "profile_id")).alias("act_7d"), _W.sum_over("result", _W.within_days(7, "profile_id", "civ")).alias("civ_wins_7d")),
    schema.with_views("player_game") + f"SELECT game_id, profile_id, count(*) {over('profile_id', days(7), 'started_at')} AS act_7d, {total('result', 'profile_id, civ', days(7), 'started_at')} AS civ_wins_7d FROM player_game",
)

from ..functions import windows as _W  # noqa: E402
