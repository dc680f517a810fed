"""Queries of the civilisation choice, its anonymous variant and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from ..operators import civ_choice as C
from ..operators import clustering as K
from ..operators import joins, metrics
from .base import add, over, pg_sql, player_rows, six, total

_RAW = (
    "base AS (SELECT * REPLACE (CASE WHEN civilization_randomized THEN 'random_civ' ELSE civ END AS civ) FROM pg), mk AS (SELECT *, CASE WHEN civ = lag(civ) " + over("profile_id") + " THEN 0 ELSE 1 END AS b FROM base), "
    "gr AS (SELECT *, sum(b) " + over("profile_id", "ROWS UNBOUNDED PRECEDING") + " AS g FROM mk), rl AS (SELECT *, row_number() " + over("profile_id, g") + " AS l FROM gr), "
    "raw AS (SELECT * EXCLUDE (b, g, l), lag(civ) " + over("profile_id") + " AS prev_civ, coalesce(lag(l) " + over("profile_id") + ", 0) AS prev_civ_streak_len FROM rl)"
)
_FIRST = "fs AS (SELECT CASE WHEN civilization_randomized THEN 'random_civ' ELSE civilization END AS civ, min(started_at) AS first_seen_at FROM participants JOIN games USING (game_id) WHERE civilization IS NOT NULL GROUP BY 1)"
_CAND = "cr AS (SELECT raw.* EXCLUDE (civ), raw.civ AS chosen_civ, fs.civ AS candidate_civ, CASE WHEN raw.civ = fs.civ THEN 1 ELSE 0 END AS target FROM raw JOIN fs ON fs.first_seen_at <= raw.started_at)"
KEY = ["game_id", "profile_id", "candidate_civ"]


def _raw(s, d):
    return C.raw_games(schema.games(s, d), schema.participants(s, d))


def _seen(s, d):
    return C.first_seen(schema.games(s, d), schema.participants(s, d))


def _matrix(s, d, *families):
    return C.training_matrix(_raw(s, d), _seen(s, d), families=families or C.FAMILIES)


add("w17_civ_runs", lambda s, d: _raw(s, d).select("game_id", "profile_id", "civ", "prev_civ", "prev_civ_streak_len"), pg_sql(_RAW) + "SELECT game_id, profile_id, civ, prev_civ, prev_civ_streak_len FROM raw")
add("w15_inclusive_cumulative", lambda s, d: C.civ_games(_raw(s, d)).select("game_id", "profile_id", "civ_game_num", "civ_wins_cumul"), pg_sql(_RAW) + f"SELECT game_id, profile_id, row_number() {over('profile_id, civ')} AS civ_game_num, {total('result', 'profile_id, civ', 'ROWS UNBOUNDED PRECEDING')} AS civ_wins_cumul FROM raw")
add("e3_civ_option", lambda s, d: player_rows(s, d).select("game_id", "profile_id", X.civ_option("civ").alias("civ"), X.tier("mmr").alias("mmr_bucket")), pg_sql() + "SELECT game_id, profile_id, CASE WHEN civilization_randomized THEN 'random_civ' ELSE civ END AS civ, CASE WHEN mmr IS NULL THEN 'unknown' WHEN mmr < 1000 THEN 'low' WHEN mmr < 1400 THEN 'mid' ELSE 'high' END AS mmr_bucket FROM pg")
add("c16_candidates", lambda s, d: C.candidates(_raw(s, d), _seen(s, d)).groupBy("candidate_civ").agg(F.count("*").alias("n"), F.sum("target").alias("chosen")), pg_sql(_RAW, _FIRST) + "SELECT fs.civ AS candidate_civ, count(*) AS n, sum(CASE WHEN raw.civ = fs.civ THEN 1 ELSE 0 END)::BIGINT AS chosen FROM raw JOIN fs ON fs.first_seen_at <= raw.started_at GROUP BY 1")
add("j8_theta_join", lambda s, d: C.candidates(_raw(s, d), _seen(s, d)).select(*KEY, "target"), pg_sql(_RAW, _FIRST, _CAND) + "SELECT game_id, profile_id, candidate_civ, target FROM cr")
_RATES = lambda by: f"SELECT {by}, civ, n::DOUBLE / sum(n) OVER (PARTITION BY {by}) AS pick_rate FROM (SELECT {by}, civ, count(*) AS n FROM raw GROUP BY ALL)"
for _by in ("season", "patch"):
    add(f"a10_pick_rates_{_by}", lambda s, d, by=_by: C.pick_rates(_raw(s, d), by), pg_sql(_RAW) + f"SELECT {_by}, civ, {six('pick_rate')} AS pick_rate FROM ({_RATES(_by)})")

_PAST = "FROM cr LEFT JOIN raw AS h ON h.profile_id = cr.profile_id AND h.started_at < cr.started_at"
_OWN = "h.civ = cr.candidate_civ"
_hc = lambda c: f"count(h.game_id) FILTER ({c})"
_hs = lambda c: f"coalesce(sum(h.result) FILTER ({c}), 0)::BIGINT"
_MONTH = "h.started_at >= cr.started_at - INTERVAL 30 DAYS"
_LIFE = {
    "cand_games_lifetime": _hc(_OWN), "cand_wins_lifetime": _hs(_OWN), "days_since_cand_civ": f"date_diff('day', (max(h.started_at) FILTER ({_OWN}))::DATE, any_value(cr.started_at)::DATE)",
    "cand_games_30d": _hc(f"{_OWN} AND {_MONTH}"), "cand_wins_30d": _hs(f"{_OWN} AND {_MONTH}"), "cand_games_this_patch": _hc(f"{_OWN} AND h.patch = cr.patch"), "cand_wins_this_patch": _hs(f"{_OWN} AND h.patch = cr.patch"),
    "cand_games_this_map": _hc(f"{_OWN} AND h.map = cr.map"), "cand_wins_this_map": _hs(f"{_OWN} AND h.map = cr.map"), "player_games_lifetime": _hc("true"), "player_games_30d": _hc(_MONTH), "player_games_this_patch": _hc("h.patch = cr.patch"), "player_games_this_map": _hc("h.map = cr.map"),
}
_GROUP = "GROUP BY cr.game_id, cr.profile_id, cr.candidate_civ"
_LIFE_SQL = "life AS (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, " + ", ".join(f"{v} AS {k}" for k, v in _LIFE.items()) + f" {_PAST} {_GROUP})"
for _name, _columns in {"j13_latest_own": ["cand_games_lifetime", "cand_wins_lifetime", "days_since_cand_civ"], "j14_bounded_aggregates": [c for c in _LIFE if c.endswith(("30d", "this_patch", "this_map"))]}.items():
    add(_name, lambda s, d, c=_columns: _matrix(s, d, "own").select(*KEY, *c), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL) + f"SELECT game_id, profile_id, candidate_civ, {', '.join(_columns)} FROM life")
_RECENT = (
    "rec AS (SELECT * FROM (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, cr.map AS here, h.civ, h.map, row_number() OVER (PARTITION BY cr.game_id, cr.profile_id, cr.candidate_civ ORDER BY h.started_at DESC, h.game_id DESC) AS rn "
    "FROM cr JOIN raw AS h ON h.profile_id = cr.profile_id AND h.started_at < cr.started_at) WHERE rn <= 20), "
    "rp AS (SELECT *, lag(civ) OVER (PARTITION BY game_id, profile_id, candidate_civ ORDER BY rn) AS pv FROM rec), "
    "en AS (SELECT game_id, profile_id, candidate_civ, -sum(p * ln(p)) AS e FROM (SELECT game_id, profile_id, candidate_civ, civ, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY game_id, profile_id, candidate_civ) AS p FROM rec WHERE rn <= 10 GROUP BY game_id, profile_id, candidate_civ, civ) GROUP BY ALL), "
    "seq AS (SELECT game_id, profile_id, candidate_civ, " + ", ".join(f"count(*) FILTER (rn <= {n} AND civ = candidate_civ) AS cand_games_last_{n}_games" for n in (1, 2, 3, 5, 10, 20)) + ", coalesce(min(rn) FILTER (civ = candidate_civ), 21) AS candidate_last_played_position, "
    "count(*) FILTER (rn <= 10 AND pv IS NOT NULL AND civ <> pv) AS recent_civ_switch_count_last_10_games, count(DISTINCT civ) FILTER (rn <= 10) AS recent_unique_civs_last_10_games, "
    "count(*) FILTER (map = here AND civ = candidate_civ) AS cand_games_last_20_same_map, count(*) FILTER (map = here) AS player_games_last_20_same_map FROM rp GROUP BY ALL)"
)
_SEQ = [*[f"cand_games_last_{n}_games" for n in (1, 2, 3, 5, 10, 20)], "recent_civ_switch_count_last_10_games", "recent_unique_civs_last_10_games", "cand_games_last_20_same_map", "player_games_last_20_same_map"]
_SEQ_SQL = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _SEQ) + ", coalesce(candidate_last_played_position, 21) AS candidate_last_played_position"
add("j15_last_20", lambda s, d: _matrix(s, d, "recent").select(*KEY, "cand_games_last_20_games"), pg_sql(_RAW, _FIRST, _CAND, _RECENT) + "SELECT game_id, profile_id, candidate_civ, coalesce(cand_games_last_20_games, 0) AS cand_games_last_20_games FROM cr LEFT JOIN seq USING (game_id, profile_id, candidate_civ)")
add("j16_recent_sequence", lambda s, d: _matrix(s, d, "recent").select(*KEY, *_SEQ, "candidate_last_played_position", "recent_entropy_last_10_games"), pg_sql(_RAW, _FIRST, _CAND, _RECENT) + f"SELECT game_id, profile_id, candidate_civ, {_SEQ_SQL}, {six('coalesce(e, 0)')} AS recent_entropy_last_10_games FROM cr LEFT JOIN seq USING (game_id, profile_id, candidate_civ) LEFT JOIN en USING (game_id, profile_id, candidate_civ)")
_STREAK = "fc AS (SELECT game_id, profile_id, candidate_civ, arg_min(civ, rn) AS newest FROM rec GROUP BY ALL), sk AS (SELECT game_id, profile_id, candidate_civ, newest, coalesce(min(rn) FILTER (civ <> newest) - 1, count(*)) AS streak FROM rec JOIN fc USING (game_id, profile_id, candidate_civ) GROUP BY ALL)"
add(
    "c28_sequence_backfill",
    lambda s, d: C.backfill_sequences(C.candidates(_raw(s, d), _seen(s, d)).select(*KEY, "started_at", "map"), _raw(s, d)).select(*KEY, *C.SEQUENCE, "cand_global_pr_map_patch"),
    pg_sql(_RAW, _FIRST, _CAND, _RECENT, _STREAK) + f"SELECT game_id, profile_id, candidate_civ, {_SEQ_SQL}, coalesce(streak, 0) AS player_current_streak_len, CASE WHEN candidate_civ = newest THEN streak ELSE 0 END AS candidate_current_streak_len, {six('coalesce(e, 0)')} AS recent_entropy_last_10_games, {six('1.0::DOUBLE / 19')} AS cand_global_pr_map_patch "
    "FROM cr LEFT JOIN seq USING (game_id, profile_id, candidate_civ) LEFT JOIN en USING (game_id, profile_id, candidate_civ) LEFT JOIN sk USING (game_id, profile_id, candidate_civ)",
)
add("a11_entropy", lambda s, d: player_rows(s, d).groupBy("profile_id", "civ").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(_of("profile_id"))).groupBy("profile_id").agg(F.sum(-F.col("p") * F.ln("p")).alias("entropy")), pg_sql() + f"SELECT profile_id, {six('-sum(p * ln(p))')} AS entropy FROM (SELECT profile_id, civ, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY profile_id) AS p FROM pg GROUP BY profile_id, civ) GROUP BY 1")


def _of(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


_TIER = lambda x: f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < 1000 THEN 'low' WHEN {x} < 1400 THEN 'mid' ELSE 'high' END"
_U = "1.0::DOUBLE / 19"
_GLOBAL = (
    f"rs AS ({_RATES('season')}), rpt AS ({_RATES('patch')}), "
    f"pmb AS (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, (count(h.game_id) FILTER ({_OWN}))::DOUBLE / nullif(count(h.game_id), 0) AS v FROM cr LEFT JOIN raw AS h ON h.patch = cr.patch AND h.started_at < cr.started_at AND ({_TIER('h.mmr')}) = ({_TIER('cr.mmr')}) {_GROUP}), "
    f"mpr AS (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, (count(h.game_id) FILTER ({_OWN}))::DOUBLE / nullif(count(h.game_id), 0) AS v FROM cr LEFT JOIN raw AS h ON h.patch = cr.patch AND h.map = cr.map AND h.started_at < cr.started_at {_GROUP}), "
    "pp AS (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, arg_max(rpt.pick_rate, rpt.patch) AS v FROM cr JOIN rpt ON rpt.civ = cr.candidate_civ AND rpt.patch < cr.patch GROUP BY ALL)"
)
add(
    "j17_global_rates",
    lambda s, d: _matrix(s, d, "global").select(*KEY, *[f"cand_global_pr_{x}" for x in ("prev_season", "prev_patch", "patch_mmr_bucket", "map_patch")]),
    pg_sql(_RAW, _FIRST, _CAND, _GLOBAL) + f"SELECT cr.game_id, cr.profile_id, cr.candidate_civ, {six(f'coalesce(rs.pick_rate, {_U})')} AS cand_global_pr_prev_season, {six(f'coalesce(pp.v, {_U})')} AS cand_global_pr_prev_patch, {six(f'coalesce(pmb.v, {_U})')} AS cand_global_pr_patch_mmr_bucket, {six(f'coalesce(mpr.v, {_U})')} AS cand_global_pr_map_patch "
    "FROM cr LEFT JOIN rs ON rs.season = cr.season - 1 AND rs.civ = cr.candidate_civ LEFT JOIN pp USING (game_id, profile_id, candidate_civ) LEFT JOIN pmb USING (game_id, profile_id, candidate_civ) LEFT JOIN mpr USING (game_id, profile_id, candidate_civ)",
)
_SHARE = lambda c, t: f"((cand_games_{c} + 5.0::DOUBLE / 19) / (player_games_{t} + 5.0::DOUBLE))"
add("e29_choice_flags", lambda s, d: C.derived(_matrix(s, d, "own", "recent")).select(*KEY, "candidate_is_last_civ", "candidate_is_in_pool_lifetime", "candidate_breaks_current_streak"), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL) + "SELECT cr.game_id, cr.profile_id, cr.candidate_civ, CASE WHEN cr.candidate_civ = cr.prev_civ THEN 1 ELSE 0 END AS candidate_is_last_civ, CASE WHEN cand_games_lifetime > 0 THEN 1 ELSE 0 END AS candidate_is_in_pool_lifetime, CASE WHEN prev_civ_streak_len > 0 AND cr.candidate_civ <> coalesce(cr.prev_civ, '') THEN 1 ELSE 0 END AS candidate_breaks_current_streak FROM cr JOIN life USING (game_id, profile_id, candidate_civ)")
add("w22_dense_ranks", lambda s, d: C.derived(_matrix(s, d, "own", "recent")).select(*KEY, "candidate_civ_rank_lifetime", "candidate_civ_rank_30d", "candidate_is_lifetime_main"), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL) + "SELECT *, CASE WHEN candidate_civ_rank_lifetime = 1 THEN 1 ELSE 0 END AS candidate_is_lifetime_main FROM (SELECT game_id, profile_id, candidate_civ, " + ", ".join(f"(dense_rank() OVER (PARTITION BY game_id, profile_id ORDER BY cand_games_{x} DESC))::INT AS candidate_civ_rank_{x}" for x in ("lifetime", "30d")) + " FROM life)")
add("w23_group_shares", lambda s, d: C.derived(_matrix(s, d, "own", "recent")).select(*KEY, "cand_pick_share_lifetime", "main_civ_share_lifetime", "num_civs_played_30d", "civ_pool_entropy_lifetime"), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL, f"sh AS (SELECT *, {_SHARE('lifetime', 'lifetime')} AS sl FROM life), pr AS (SELECT *, sl / sum(sl) OVER (PARTITION BY game_id, profile_id) AS p FROM sh)") + f"SELECT game_id, profile_id, candidate_civ, {six('sl')} AS cand_pick_share_lifetime, {six('max(sl) OVER w')} AS main_civ_share_lifetime, (sum(CASE WHEN cand_games_30d > 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS num_civs_played_30d, {six('sum(-p * ln(p)) OVER w')} AS civ_pool_entropy_lifetime FROM pr WINDOW w AS (PARTITION BY game_id, profile_id)")
add("a2_filtered_aggregates", lambda s, d: player_rows(s, d).groupBy("profile_id").agg(F.count(F.when(F.col("mmr") > 1200, 1)).alias("strong"), F.count_distinct(F.when(F.col("result") == 1, F.col("civ"))).alias("civs_won"), F.sum(F.when(F.col("duration") <= 900, F.col("result"))).alias("short_wins")), pg_sql() + "SELECT profile_id, count(*) FILTER (mmr > 1200) AS strong, count(DISTINCT civ) FILTER (result = 1) AS civs_won, (sum(result) FILTER (duration <= 900))::BIGINT AS short_wins FROM pg GROUP BY 1")

# Anonymous.
_AG = f"ag AS (SELECT game_id, profile_id, civ, result, mmr, rating, {_TIER('mmr')} AS mmr_bucket, {_TIER('rating')} AS rating_bucket, started_at, season, patch, map, started_at::DATE AS day FROM pg WHERE NOT civilization_randomized)"
_AF = "af AS (SELECT civilization AS civ, min(started_at) AS first_seen_at FROM participants JOIN games USING (game_id) WHERE NOT civilization_randomized GROUP BY 1)"
_AC = "ac AS (SELECT ag.* EXCLUDE (civ), ag.civ AS chosen_civ, af.civ AS candidate_civ FROM ag JOIN af ON af.first_seen_at <= ag.started_at WHERE ag.season = 5)"


def _anonymous(s, d):
    return C.anonymous_games(schema.games(s, d), schema.participants(s, d))


def _anonymous_seen(s, d):
    return schema.participants(s, d).filter("NOT civilization_randomized").join(schema.games(s, d), "game_id").groupBy(F.col("civilization").alias("civ")).agg(F.min("started_at").alias("first_seen_at"))


def _anonymous_matrix(s, d):
    return C.anonymous_matrix(_anonymous(s, d), _anonymous_seen(s, d), [5])


def _before_day(name, keys, civ):
    by = [*keys, *(["civ"] if civ else [])]
    probe = ", ".join(["day", *keys, *(["candidate_civ AS civ"] if civ else [])])
    on = " AND ".join([f"h.{k} = q.{k}" for k in by] + ["h.day < q.day"])
    return f"{name} AS (SELECT q.*, count(h.game_id) AS n FROM (SELECT DISTINCT {probe} FROM ac) AS q LEFT JOIN ag AS h ON {on} GROUP BY ALL)"


_DIMS = {k: v for k, v in C.DIMENSIONS.items()}
_ACTES = ", ".join(_before_day(f"c_{n}", k, True) + ", " + _before_day(f"t_{n}", k, False) for n, k in _DIMS.items())
_AJOIN = " ".join(f"JOIN c_{n} ON c_{n}.day = ac.day AND c_{n}.civ = ac.candidate_civ" + "".join(f" AND c_{n}.{x} = ac.{x}" for x in k) + f" JOIN t_{n} ON t_{n}.day = ac.day" + "".join(f" AND t_{n}.{x} = ac.{x}" for x in k) for n, k in _DIMS.items())
_ACOLS = ", ".join(f"c_{n}.n AS cand_{n}_count, t_{n}.n AS {n}_total" for n in _DIMS)
add("c17_anonymous_counts", lambda s, d: _anonymous_matrix(s, d).select(*KEY, *[x for n in _DIMS for x in (f"cand_{n}_count", f"{n}_total")]), pg_sql(_AG, _AF, _AC, _ACTES) + f"SELECT ac.game_id, ac.profile_id, ac.candidate_civ, {_ACOLS} FROM ac {_AJOIN}")
_sm = lambda n, p: f"((cand_{n}_count + 10.0::DOUBLE * {p}) / ({n}_total + 10.0::DOUBLE))"
_PRIOR = f"(CASE WHEN global_total > 0 THEN cand_global_count::DOUBLE / global_total ELSE {_U} END)"
add(
    "e30_anonymous_shares",
    lambda s, d: C.anonymous_derived(_anonymous_matrix(s, d)).select(*KEY, "cand_global_pr_prior", "cand_global_pr_mmr_bucket", "cand_global_pr_map", "cand_global_pr_map_patch"),
    pg_sql(_AG, _AF, _AC, _ACTES, f"am AS (SELECT ac.game_id, ac.profile_id, ac.candidate_civ, {_ACOLS} FROM ac {_AJOIN})") + f"SELECT game_id, profile_id, candidate_civ, {six(_PRIOR)} AS cand_global_pr_prior, {six(_sm('mmr_bucket', _PRIOR))} AS cand_global_pr_mmr_bucket, {six(_sm('map', _PRIOR))} AS cand_global_pr_map, {six(_sm('map_patch', _sm('map', _PRIOR)))} AS cand_global_pr_map_patch FROM am",
)
add("j9_day_grid", lambda s, d: C.counts_before_day(_anonymous(s, d), ["map"], _anonymous(s, d).select("day").distinct())[1].select(F.col("day"), "map", "total_count"), pg_sql(_AG) + "SELECT d.day, m.map, count(h.game_id) AS total_count FROM (SELECT DISTINCT day FROM ag) AS d CROSS JOIN (SELECT DISTINCT map FROM ag) AS m LEFT JOIN ag AS h ON h.map = m.map AND h.day < d.day GROUP BY ALL")
add("w21_daily_cumulative", lambda s, d: C.counts_before_day(_anonymous(s, d), [], _anonymous(s, d).select("day").distinct())[1], pg_sql(_AG) + "SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_count FROM (SELECT day, count(*) AS n FROM ag GROUP BY 1)")
USER = 7
_UR = f"uo AS (SELECT u.game_id, o.civ AS opponent_civ, o.map, row_number() OVER (ORDER BY u.started_at, u.game_id) AS num FROM ag AS u JOIN ag AS o ON o.game_id = u.game_id AND o.profile_id <> u.profile_id WHERE u.profile_id = {USER})"
_uc = lambda n, *c: "count(h.num) FILTER (" + " AND ".join([f"h.num >= t.num - {n}", *c]) + ")"
_UCOLS = {f"cand_count_{n}": _uc(n, "h.opponent_civ = ac.candidate_civ") for n in (10, 30, 50)} | {f"total_{n}": _uc(n) for n in (10, 30, 50)} | {"cand_same_map_30": _uc(30, "h.map = ac.map", "h.opponent_civ = ac.candidate_civ"), "total_same_map_30": _uc(30, "h.map = ac.map")}


def _user(s, d):
    rows = _anonymous(s, d)
    return C.user_recent(rows, joins.expand_candidates(rows.withColumnRenamed("civ", "chosen_civ"), _anonymous_seen(s, d), "chosen_civ").filter("season = 5"), USER)


add("c18_user_recent", _user, pg_sql(_AG, _AF, _AC, _UR) + "SELECT ac.game_id, ac.profile_id, ac.candidate_civ, " + ", ".join(f"{v} AS {k}" for k, v in _UCOLS.items()) + " FROM ac JOIN uo AS t ON t.game_id = ac.game_id LEFT JOIN uo AS h ON h.num < t.num AND h.num >= t.num - 50 GROUP BY ac.game_id, ac.profile_id, ac.candidate_civ")
add("j18_rank_window_join", lambda s, d: _user(s, d).select(*KEY, "total_10", "total_50"), pg_sql(_AG, _AF, _AC, _UR) + f"SELECT ac.game_id, ac.profile_id, ac.candidate_civ, {_UCOLS['total_10']} AS total_10, {_UCOLS['total_50']} AS total_50 FROM ac JOIN uo AS t ON t.game_id = ac.game_id LEFT JOIN uo AS h ON h.num < t.num AND h.num >= t.num - 50 GROUP BY ac.game_id, ac.profile_id, ac.candidate_civ")

# Choice metrics on a plain score.
_SCORE = "(cand_games_lifetime + 1)::DOUBLE"


def _scored(s, d):
    return _matrix(s, d, "own").select(*KEY, "target", (F.col("cand_games_lifetime") + 1).cast("double").alias("score"))


_SC = f"sc AS (SELECT cr.game_id, cr.profile_id, cr.candidate_civ, cr.target, {_SCORE} AS score FROM cr JOIN life USING (game_id, profile_id, candidate_civ)), pr AS (SELECT *, score / sum(score) OVER w AS prob, ln(score) AS ls FROM sc WINDOW w AS (PARTITION BY game_id, profile_id))"
add("m8_normalize", lambda s, d: metrics.normalize(metrics.normalize(_scored(s, d), KEY[:2], "score").withColumnsRenamed({"prob": "renorm"}).withColumn("ls", F.ln("score")), KEY[:2], "ls", "temperature", 2.0).select(*KEY, "renorm", F.col("prob").alias("tempered")), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL, _SC) + f"SELECT game_id, profile_id, candidate_civ, {six('prob')} AS renorm, {six('exp(ls / 2) / sum(exp(ls / 2)) OVER (PARTITION BY game_id, profile_id)')} AS tempered FROM pr")
add(
    "m7_group_metrics",
    lambda s, d: metrics.group_metrics(metrics.normalize(_scored(s, d), KEY[:2], "score"), KEY[:2]),
    pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL, _SC, "rk AS (SELECT *, row_number() OVER (PARTITION BY game_id, profile_id ORDER BY prob DESC, candidate_civ) AS r FROM pr), one AS (SELECT game_id, profile_id, sum(target) AS c, max(r) FILTER (target = 1) AS r, max(prob) FILTER (target = 1) AS q, sum(pow(prob - target, 2)) AS b FROM rk GROUP BY ALL)")
    + "SELECT count(*) AS n, " + ", ".join(f"{six(f'avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END)')} AS top{k}_acc" for k in (1, 3, 5)) + f", {six('avg(-ln(q))')} AS log_loss, {six('avg(b)')} AS brier, {six('avg(q)')} AS mean_chosen_prob FROM one WHERE c = 1",
)
add("m11_choice_baselines", lambda s, d: _matrix(s, d, "own", "global").select(*KEY, F.col("cand_global_pr_prev_patch").alias("global"), X.smooth_share("cand_games_lifetime", "player_games_lifetime", C.UNIFORM, 5.0).alias("lifetime"), X.smooth_share("cand_games_this_map", "player_games_this_map", C.UNIFORM, 5.0).alias("map"), X.flag(F.col("candidate_civ") == F.col("prev_civ")).alias("last_civ")), pg_sql(_RAW, _FIRST, _CAND, _LIFE_SQL, _GLOBAL) + f"SELECT cr.game_id, cr.profile_id, cr.candidate_civ, {six(f'coalesce(pp.v, {_U})')} AS global, {six(_SHARE('lifetime', 'lifetime'))} AS lifetime, {six(_SHARE('this_map', 'this_map'))} AS map, CASE WHEN cr.candidate_civ = cr.prev_civ THEN 1 ELSE 0 END AS last_civ FROM cr JOIN life USING (game_id, profile_id, candidate_civ) LEFT JOIN pp USING (game_id, profile_id, candidate_civ)")

# Clustering.
_KB = "ks AS (SELECT profile_id, count(*) AS n_games, avg(civilization_randomized::INT) AS random_civ_rate, count(*) FILTER (NOT civilization_randomized) AS n_nonrandom_games FROM pg GROUP BY 1 HAVING count(*) FILTER (NOT civilization_randomized) >= 50), kb AS (SELECT * FROM pg WHERE profile_id IN (SELECT profile_id FROM ks)), kc AS (SELECT * FROM kb WHERE NOT civilization_randomized), ke AS (SELECT * FROM pg WHERE NOT civilization_randomized)"
_PRI = lambda name, of: f"{name} AS (SELECT civ, count(*)::DOUBLE / sum(count(*)) OVER () AS prior FROM {of} GROUP BY civ)"
_SHR = "shr AS (SELECT g.profile_id, g.civ, coalesce(n, 0)::DOUBLE / t AS raw, (coalesce(n, 0) + 10 * prior) / (t + 10) AS share FROM (SELECT profile_id, count(*) AS t, NULL AS z FROM kc GROUP BY 1) AS p CROSS JOIN kp JOIN (SELECT DISTINCT a.profile_id, b.civ FROM kc AS a, kp AS b) AS g ON g.profile_id = p.profile_id AND g.civ = kp.civ LEFT JOIN (SELECT profile_id, civ, count(*) AS n FROM kc GROUP BY ALL) AS c ON c.profile_id = g.profile_id AND c.civ = g.civ)"
_H = lambda x, y: f"sqrt(0.5 * sum(pow(sqrt({x}) - sqrt({y}), 2)))"
add("a16_normalised_counts", lambda s, d: K.civ_prior(K.picks(player_rows(s, d))), pg_sql(_KB, _PRI("kp", "ke")) + f"SELECT civ, {six('prior')} AS prior FROM kp")


def _shares(s, d):
    rows = player_rows(s, d)
    base = rows.join(K.eligible(rows).select("profile_id"), "profile_id", "left_semi")
    chosen = K.picks(base)
    return rows, base, chosen, K.smoothed_shares(chosen, K.civ_prior(chosen))


add("c19_smoothed_shares", lambda s, d: _shares(s, d)[3].select("profile_id", "civ", "share"), pg_sql(_KB, _PRI("kp", "kc"), _SHR) + f"SELECT profile_id, civ, {six('share')} AS share FROM shr")
add("c19_diagnostics", lambda s, d: K.diagnostics(_shares(s, d)[3]), pg_sql(_KB, _PRI("kp", "kc"), _SHR, "dg AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY raw DESC, civ) AS r, greatest(raw, 1e-12) AS p FROM shr)") + f"SELECT profile_id, max(civ) FILTER (r = 1) AS top_civ, {six('max(raw)')} AS top_civ_share, {six('sum(raw) FILTER (r <= 3)')} AS top_3_civ_share, {six('sum(-p * ln(p)) / ln(count(*))')} AS civ_entropy, {six('exp(sum(-p * ln(p)))')} AS effective_civ_pool_size FROM dg GROUP BY 1")
add(
    "c20_map_dependence",
    lambda s, d: K.map_dependence(_shares(s, d)[2], _shares(s, d)[3]),
    pg_sql(_KB, _PRI("kp", "kc"), _SHR, "em AS (SELECT *, count(*) OVER (PARTITION BY profile_id) AS maps FROM (SELECT profile_id, map, count(*) AS n_map FROM kc GROUP BY ALL HAVING count(*) >= 10)), lg AS (SELECT em.profile_id, em.map, n_map, share, (coalesce(c, 0) + 5 * share) / (n_map + 5) AS om FROM em JOIN shr USING (profile_id) LEFT JOIN (SELECT profile_id, map, civ, count(*) AS c FROM kc GROUP BY ALL) AS k ON k.profile_id = em.profile_id AND k.map = em.map AND k.civ = shr.civ WHERE maps >= 2)")
    + f"SELECT profile_id, {six('sum(h * n_map) / sum(n_map)')} AS map_dependence_score FROM (SELECT profile_id, map, n_map, {_H('om', 'share')} AS h FROM lg GROUP BY ALL) GROUP BY 1",
)
add(
    "c21_off_meta",
    lambda s, d: K.off_meta(K.picks(_shares(s, d)[0]), _shares(s, d)[1], _shares(s, d)[3], K.civ_prior(K.picks(_shares(s, d)[0]))),
    pg_sql(_KB, _PRI("kp", "kc"), _PRI("kg", "ke"), _SHR, "tt AS (SELECT map, season, count(*) AS t FROM ke GROUP BY ALL), me AS (SELECT tt.map, tt.season, kg.civ, (coalesce(c, 0) + 10 * prior) / (t + 10) AS m FROM tt CROSS JOIN kg LEFT JOIN (SELECT map, season, civ, count(*) AS c FROM ke GROUP BY ALL) AS k ON k.map = tt.map AND k.season = tt.season AND k.civ = kg.civ), wt AS (SELECT profile_id, map, season, n::DOUBLE / sum(n) OVER (PARTITION BY profile_id) AS w FROM (SELECT profile_id, map, season, count(*) AS n FROM kb GROUP BY ALL) JOIN tt USING (map, season)), ex AS (SELECT profile_id, civ, sum(w * m) AS e FROM wt JOIN me USING (map, season) GROUP BY ALL)")
    + f"SELECT profile_id, {six(_H('share', 'e'))} AS off_meta_score FROM ex JOIN shr USING (profile_id, civ) GROUP BY 1",
)
add("a21_season_profile", lambda s, d: K.season_profile(player_rows(s, d)), pg_sql() + "SELECT profile_id, min(a) AS first_game_date, max(b) AS last_game_date, count(*) AS n_seasons, min(season) AS first_season, max(season) AS last_season, max(season) - min(season) AS season_span, arg_max(season, n * 100 - season) AS dominant_season FROM (SELECT profile_id, season, count(*) AS n, min(started_at) AS a, max(started_at) AS b FROM pg GROUP BY ALL) GROUP BY 1")
add("a22_latest_value", lambda s, d: K.latest_value(player_rows(s, d)), pg_sql() + "SELECT profile_id, arg_min(mmr, r) AS latest_mmr FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, game_id DESC) AS r FROM pg WHERE mmr IS NOT NULL) GROUP BY 1")
add(
    "c19_profile",
    lambda s, d: K.player_features(player_rows(s, d)).select("profile_id", "n_games", "random_civ_rate", "n_nonrandom_games", "mean_mmr", "n_mmr_obs", "mmr_missing_rate", "latest_mmr", "n_seasons", "first_season"),
    pg_sql(_KB, "lt AS (SELECT profile_id, last(mmr ORDER BY started_at, game_id) FILTER (mmr IS NOT NULL) AS latest_mmr FROM kb GROUP BY 1), ss AS (SELECT profile_id, count(DISTINCT season) AS n_seasons, min(season) AS first_season, avg(mmr) AS m, count(mmr) AS n, avg(CASE WHEN mmr IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS r FROM kb GROUP BY 1)")
    + f"SELECT profile_id, n_games, {six('random_civ_rate')} AS random_civ_rate, n_nonrandom_games, {six('m')} AS mean_mmr, n AS n_mmr_obs, {six('r')} AS mmr_missing_rate, latest_mmr, n_seasons, first_season FROM ks JOIN ss USING (profile_id) LEFT JOIN lt USING (profile_id)",
)
add("c19_player_features", lambda s, d: K.player_features(player_rows(s, d)))
