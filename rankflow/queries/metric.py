"""Queries of metrics, baselines and rating formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from ..operators import metrics as M
from ..operators import splits
from ..plans import models
from .base import PRIORS, PS, TF, add, pg_sql, player_rows, six, stats, training
from .history import RATING_SQL, rating_frame

# labels as truth, a fixed expression as score; it has ties and all of [0, 1).
_Y = "ys AS (SELECT doc_id, quality AS y, (doc_id * 37 % 100) / 100.0::DOUBLE AS p, toxic FROM labels)"


def _scored(s, d):
    return schema.table(s, d, "labels").select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("p"), "toxic")


def _auc(of, by=""):
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}(sum(r) FILTER (y = 1) - (count(*) FILTER (y = 1)) * ((count(*) FILTER (y = 1)) + 1) / 2.0::DOUBLE) / nullif((count(*) FILTER (y = 1)) * (count(*) FILTER (y = 0)), 0)::DOUBLE AS auc FROM (SELECT *, rank() OVER ({part}ORDER BY p) + (count(*) OVER (PARTITION BY {keys}p) - 1) / 2.0::DOUBLE AS r FROM {of})" + (f" GROUP BY {by}" if by else "")


_Q = "least(greatest(p, 1e-7), 1 - 1e-7)"
_PART = f"count(*) AS n, {six(f'avg(-(y * ln({_Q}) + (1 - y) * ln(1 - {_Q})))')} AS log_loss, {six('avg(pow(p - y, 2))')} AS brier, {six('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy"
add("m1_binary_metrics", lambda s, d: M.binary_metrics(_scored(s, d)), f"WITH {_Y} SELECT {_PART}, (SELECT {six('auc')} FROM ({_auc('ys')})) AS auc FROM ys")
_CAL = "ct AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS frac_pos FROM ys GROUP BY 1)"
add("m2_calibration", lambda s, d: M.calibration(_scored(s, d)), f"WITH {_Y}, {_CAL} SELECT bin, n, {six('mean_pred')} AS mean_pred, {six('frac_pos')} AS frac_pos FROM ct")
add("m3_ece", lambda s, d: M.ece(_scored(s, d)), f"WITH {_Y}, {_CAL} SELECT {six('sum(abs(mean_pred - frac_pos) * n) / sum(n)')} AS ece FROM ct")
add(
    "m4_subgroups",
    lambda s, d: M.subgroups(_scored(s, d), {"toxic": F.col("toxic"), "third": F.col("doc_id") % 3}, least=20),
    f"WITH {_Y}, lb AS (SELECT y, p, 'toxic' AS family, toxic::VARCHAR AS label FROM ys UNION ALL SELECT y, p, 'third', (doc_id % 3)::VARCHAR FROM ys) SELECT family, label, {_PART}, any_value({six('auc')}) AS auc FROM lb JOIN ({_auc('lb', 'family, label')}) USING (family, label) GROUP BY ALL HAVING count(*) >= 20",
)
add("m26_auc_by_group", lambda s, d: M.auc(_scored(s, d).withColumn("third", F.col("doc_id") % 3), by=["third"]), f"WITH {_Y}, th AS (SELECT *, doc_id % 3 AS third FROM ys) SELECT third, {six('auc')} AS auc FROM ({_auc('th', 'third')})")


def _quintiles(s, d):
    rows = player_rows(s, d).filter("rating IS NOT NULL")
    edges = M.quantile_edges(rows.filter("season <= 5"), "rating")
    return rows.groupBy(M.by_edges("rating", edges).alias("bucket")).agg(F.count("*").alias("n"), F.avg("result").alias("wr"))


_EDGES = "eg AS (SELECT unnest(quantile_cont(rating, [0.2, 0.4, 0.6, 0.8])) AS e FROM pg WHERE rating IS NOT NULL AND season <= 5)"
add("m5_quintiles", _quintiles, pg_sql(_EDGES) + f"SELECT bucket::INT AS bucket, count(*) AS n, {six('avg(result)')} AS wr FROM (SELECT result, (SELECT count(*) FROM eg WHERE rating > e) AS bucket FROM pg WHERE rating IS NOT NULL) GROUP BY 1")
_PRED = "pd AS (SELECT *, 32.0::DOUBLE * (result - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (opponent_rating_before - player_rating_before) / 400.0::DOUBLE))) AS p FROM frame WHERE player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL)"


def _predicted(s, d):
    rows = rating_frame(s, d).filter("player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL")
    return models.predict_elo(rows, 32.0, 400.0).withColumnRenamed("pred", "p")


_Z = "observed_rating_delta"
_REG = f"count(*) AS n, {six(f'avg(abs(p - {_Z}))')} AS mae, {six(f'sqrt(avg(pow(p - {_Z}, 2)))')} AS rmse, {six(f'1 - sum(pow(p - {_Z}, 2)) / nullif(sum({_Z} * {_Z}) - sum({_Z}) * sum({_Z})::DOUBLE / count(*), 0)')} AS r2, {six(f'avg(p - {_Z})')} AS bias, {six(f'median(abs(p - {_Z}))')} AS median_ae"
add("e27_elo", lambda s, d: _predicted(s, d).select("game_id", "profile_id", X.elo_expected("player_rating_before", "opponent_rating_before").alias("expected"), F.col("p").alias("delta")), RATING_SQL.rstrip() + f", {_PRED} SELECT game_id, profile_id, {six('1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (opponent_rating_before - player_rating_before) / 400.0::DOUBLE))')} AS expected, {six('p')} AS delta FROM pd")
add("m6_regression_metrics", lambda s, d: M.regression_metrics(_predicted(s, d), _Z), RATING_SQL.rstrip() + f", {_PRED} SELECT {_REG} FROM pd")
add("m29_error_by_bucket", lambda s, d: M.regression_metrics(_predicted(s, d).withColumn("bucket", X.cut("games_lifetime_before", [0, 10, 50, 100, 1e9], ["new", "some", "many", "settled"])), _Z, by=["bucket"]), RATING_SQL.rstrip() + f", {_PRED} SELECT CASE WHEN games_lifetime_before < 10 THEN 'new' WHEN games_lifetime_before < 50 THEN 'some' WHEN games_lifetime_before < 100 THEN 'many' ELSE 'settled' END AS bucket, {_REG} FROM pd GROUP BY 1")
add("e24_cut", lambda s, d: player_rows(s, d).select("game_id", "profile_id", X.cut("rating", [0, 900, 1100, 1300, 100000], ["a", "b", "c", "d"]).alias("left_closed"), X.cut("rating", [900, 1100, 1300, 1600], ["a", "b", "c"], right=True).alias("right_closed")), pg_sql() + "SELECT game_id, profile_id, CASE WHEN rating >= 0 AND rating < 900 THEN 'a' WHEN rating >= 900 AND rating < 1100 THEN 'b' WHEN rating >= 1100 AND rating < 1300 THEN 'c' WHEN rating >= 1300 AND rating < 100000 THEN 'd' END AS left_closed, CASE WHEN rating >= 900 AND rating <= 1100 THEN 'a' WHEN rating > 1100 AND rating <= 1300 THEN 'b' WHEN rating > 1300 AND rating <= 1600 THEN 'c' END AS right_closed FROM pg")
_GRIDX = "SELECT k, spread, count(*) AS n, avg(abs(observed_rating_delta - k * (result - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (opponent_rating_before - player_rating_before) / spread))))) AS mae FROM frame, (SELECT unnest([16.0, 32.0, 48.0])::DOUBLE AS k), (SELECT unnest([200.0, 400.0])::DOUBLE AS spread) WHERE player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL"
add("m14_elo_grid", lambda s, d: models.elo_grid(rating_frame(s, d), [16, 32, 48], [200, 400]), RATING_SQL + f"SELECT k, spread, n, {six('mae')} AS mae FROM ({_GRIDX} GROUP BY ALL)")
_seg = lambda: X.cut("games_this_season_before", [0, 10, 30, 1e9], ["early", "mid", "late"])
add("m15_k_segments", lambda s, d: models.elo_grid(rating_frame(s, d).withColumn("segment", _seg()), [16, 32, 48], [200, 400], by=["segment"]), RATING_SQL + f"SELECT segment, k, spread, n, {six('mae')} AS mae FROM ({_GRIDX.replace('SELECT k,', 'SELECT CASE WHEN games_this_season_before < 10 THEN ' + chr(39) + 'early' + chr(39) + ' WHEN games_this_season_before < 30 THEN ' + chr(39) + 'mid' + chr(39) + ' ELSE ' + chr(39) + 'late' + chr(39) + ' END AS segment, k,')} GROUP BY ALL)")
add("a19_determinism", lambda s, d: models.determinism(rating_frame(s, d)), RATING_SQL + f"SELECT count(*) AS tuples, count(*) FILTER (d <= 1) AS deterministic, {six('avg(d)')} AS mean_deltas FROM (SELECT count(DISTINCT observed_rating_delta) AS d FROM frame GROUP BY player_rating_before, opponent_rating_before, result HAVING count(*) > 1)")
_RES = "(observed_rating_delta - p)"
add("m27_residual_summary", lambda s, d: M.residual_summary(_predicted(s, d).withColumn("res", F.col(_Z) - F.col("p")), "res", ["visible_rating_gap", "games_lifetime_before"], ["season"]), RATING_SQL.rstrip() + f", {_PRED} SELECT season, count(*) AS n, {six(f'avg({_RES})')} AS mean, {six(f'stddev_samp({_RES})')} AS std, {six(f'median({_RES})')} AS median, {six(f'corr({_RES}, visible_rating_gap)')} AS corr_visible_rating_gap, {six(f'corr({_RES}, games_lifetime_before)')} AS corr_games_lifetime_before FROM pd GROUP BY 1")
add("a20_correlation", lambda s, d: rating_frame(s, d).agg(F.corr("visible_rating_gap", "observed_rating_delta").alias("r"), F.corr("hidden_mmr_gap", "observed_rating_delta").alias("h")), RATING_SQL + f"SELECT {six('corr(visible_rating_gap, observed_rating_delta)')} AS r, {six('corr(hidden_mmr_gap, observed_rating_delta)')} AS h FROM frame")
add("a29_residual_curve", lambda s, d: M.residual_curve(_predicted(s, d).withColumn("res", F.col(_Z) - F.col("p")), "visible_rating_gap", "res", 10).select("bin", "n", "x_mean", "mean_residual", "se"), RATING_SQL.rstrip() + f", {_PRED}, eg AS (SELECT DISTINCT unnest(quantile_cont(visible_rating_gap, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM pd) SELECT bin::INT AS bin, count(*) AS n, {six('avg(visible_rating_gap)')} AS x_mean, {six(f'avg({_RES})')} AS mean_residual, {six(f'stddev_samp({_RES}) / sqrt(count(*))')} AS se FROM (SELECT *, (SELECT count(*) FROM eg WHERE visible_rating_gap > e) AS bin FROM pd) GROUP BY 1 HAVING count(*) >= 20")
add("a31_residual_by_games", lambda s, d: _predicted(s, d).groupBy("games_lifetime_before").agg(F.avg(F.col(_Z) - F.col("p")).alias("mean"), F.count("*").alias("n"), F.sqrt(F.count("*").cast("double")).alias("w")), RATING_SQL.rstrip() + f", {_PRED} SELECT games_lifetime_before, {six(f'avg({_RES})')} AS mean, count(*) AS n, {six('sqrt(count(*))')} AS w FROM pd GROUP BY 1")
add("a18_pair_sums", lambda s, d: rating_frame(s, d).groupBy("game_id").agg(F.count("*").alias("n"), F.sum("observed_rating_delta").alias("pair_sum")).filter("n = 2"), RATING_SQL + "SELECT game_id, count(*) AS n, sum(observed_rating_delta)::BIGINT AS pair_sum FROM frame GROUP BY 1 HAVING count(*) = 2")
add("e28_piecewise", lambda s, d: rating_frame(s, d).select("game_id", "profile_id", X.piecewise_intercept("games_this_season_before", 10, 30, 8.0, 2.0, 0.5).alias("linear"), X.piecewise_intercept("games_this_season_before", 10, 30, 8.0, 2.0, 0.5, rate=0.3).alias("exponential")), RATING_SQL + f"SELECT game_id, profile_id, {six('CASE WHEN n < 10 THEN 8 - 6 * n / 10.0 WHEN n < 30 THEN 2 ELSE 0.5 END')} AS linear, {six('CASE WHEN n < 10 THEN 2 + 6 * exp(-n * 0.3) WHEN n < 30 THEN 2 ELSE 0.5 END')} AS exponential FROM (SELECT *, games_this_season_before::DOUBLE AS n FROM frame)")
add("e26_rounding", lambda s, d: _predicted(s, d).select("game_id", "profile_id", X.round_half_away("p").alias("rounded"), F.floor("p").alias("floored")), RATING_SQL.rstrip() + f", {_PRED} SELECT game_id, profile_id, round(p)::BIGINT AS rounded, floor(p)::BIGINT AS floored FROM pd")


def _coefficients(s, d):
    rows = rating_frame(s, d).filter("player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL")
    found = models.fit_least_squares(rows, _Z, [("one", F.lit(1.0)), ("result", F.col("result").cast("double"))], ridge=0.0)
    return s.createDataFrame([(found["one"], found["result"])], "intercept double, slope double")


add("m16_least_squares", _coefficients, RATING_SQL + f"SELECT {six('regr_intercept(observed_rating_delta, result)')} AS intercept, {six('regr_slope(observed_rating_delta, result)')} AS slope FROM frame WHERE player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL")


def _nested(s, d):
    found = models.fit_nested(rating_frame(s, d), ("P0", "P1", "P2", "P3", "P3b", "P4"))
    return s.createDataFrame([(level, name, value) for level, terms in found.items() for name, value in terms.items()], "level string, term string, value double")


add("m16_nested_formulas", _nested)


def _fallback(s, d):
    rows = training(s, d).select("game_id", "season", "civ_a", "civ_b", "map", "target")
    tables = models.fallback_rates(rows.filter("season <= 4"), [["civ_a", "civ_b", "map"], ["civ_a", "civ_b"], ["civ_a"]], least=20)
    return models.predict_fallback(rows.filter("season > 4"), tables, 0.5).select("game_id", "pred")


_LV = [("civ_a", "civ_b", "map"), ("civ_a", "civ_b"), ("civ_a",)]
add(
    "m10_bucket_fallback",
    _fallback,
    pg_sql(PS, PRIORS, TF, *[f"l{k} AS (SELECT {', '.join(c)}, avg(target) AS r FROM tf WHERE season <= 4 GROUP BY ALL HAVING count(*) >= 20)" for k, c in enumerate(_LV)]) + f"SELECT game_id, {six('coalesce(l0.r, l1.r, l2.r, 0.5)')} AS pred FROM tf " + " ".join(f"LEFT JOIN l{k} USING ({', '.join(c)})" for k, c in enumerate(_LV)) + " WHERE season > 4",
)
add("a15_group_lookup", lambda s, d: models.fallback_rates(training(s, d), [["civ_a", "map"]], least=20)[0][1], pg_sql(PS, PRIORS, TF) + f"SELECT civ_a, map, {six('avg(target)')} AS rate, count(*) AS n FROM tf GROUP BY ALL HAVING count(*) >= 20")
add("a17_conditional_rates", lambda s, d: player_rows(s, d).groupBy("map", "civ").agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / F.sum("n").over(_by("map"))), pg_sql() + f"SELECT map, civ, count(*) AS n, {six('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY map)')} AS rate FROM pg GROUP BY map, civ")


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


add("m13_result_mean", lambda s, d: rating_frame(s, d).groupBy("result").agg(F.avg(_Z).alias("mean_delta"), F.count("*").alias("n")), RATING_SQL + f"SELECT result, {six('avg(observed_rating_delta)')} AS mean_delta, count(*) AS n FROM frame GROUP BY 1")
add("m13_gap_buckets", lambda s, d: rating_frame(s, d).groupBy(X.cut("visible_rating_gap", [-1e9, -200, -50, 50, 200, 1e9], ["far_below", "below", "even", "above", "far_above"]).alias("gap"), "result").agg(F.avg(_Z).alias("mean_delta"), F.count("*").alias("n")), RATING_SQL + f"SELECT CASE WHEN visible_rating_gap < -200 THEN 'far_below' WHEN visible_rating_gap < -50 THEN 'below' WHEN visible_rating_gap < 50 THEN 'even' WHEN visible_rating_gap < 200 THEN 'above' WHEN visible_rating_gap >= 200 THEN 'far_above' END AS gap, result, {six('avg(observed_rating_delta)')} AS mean_delta, count(*) AS n FROM frame GROUP BY ALL")
add("m19_adjusted_rand", lambda s, d: M.adjusted_rand(player_rows(s, d).select((F.col("profile_id") % 3).alias("a"), F.substring("civ", 2, 1).alias("b")), "a", "b"), pg_sql("cx AS (SELECT profile_id % 3 AS a, substr(civ, 2, 1) AS b, count(*)::DOUBLE AS n FROM pg GROUP BY ALL), ag AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM cx), sa AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT a, sum(n) AS n FROM cx GROUP BY 1)), sb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT b, sum(n) AS n FROM cx GROUP BY 1))") + f"SELECT {six('(ag.s - sa.s * sb.s / (t * (t - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (t * (t - 1) / 2))')} AS ari FROM ag, sa, sb")
add("m20_cluster_summary", lambda s, d: models.cluster_summary(player_rows(s, d).withColumn("cluster", (F.col("profile_id") % 4).cast("int")), ["mmr", "duration"]), pg_sql() + f"SELECT (profile_id % 4)::INT AS cluster, count(*) AS n, {six('avg(mmr)')} AS mean_mmr, {six('avg(duration)')} AS mean_duration FROM pg GROUP BY 1")


def _logistic(s, d):
    rows = splits.temporal_split(training(s, d).select("game_id", "started_at", "mmr_a", "mmr_b", "games_lifetime_a", "games_lifetime_b", "target"))
    model = models.fit_logistic(rows.filter("split = 'train'"), ["mmr_a", "mmr_b", "games_lifetime_a", "games_lifetime_b"], l1=0.001)
    from pyspark.ml.functions import vector_to_array

    test = model.transform(rows.filter("split = 'test'")).select("game_id", vector_to_array("probability")[1].alias("p"), F.col("target").alias("y"))
    return M.binary_metrics(test)


add("m10_logistic", _logistic)


def _trees(s, d):
    from pyspark.ml.functions import vector_to_array

    rows = splits.temporal_split(training(s, d).select("game_id", "started_at", "mmr_a", "mmr_b", "civ_a", "target")).withColumn("is_valid", F.col("split") == "valid")
    model = models.fit_trees(rows.filter("split <> 'test'"), ["mmr_a", "mmr_b"], ["civ_a"], valid="is_valid", trees=5, depth=3)
    return M.binary_metrics(model.transform(rows.filter("split = 'test'")).select(vector_to_array("probability")[1].alias("p"), F.col("target").alias("y")))


add("m17_boosted_trees", _trees)


def _clusters(s, d):
    from ..operators import clustering as K

    rows = player_rows(s, d)
    shares = K.smoothed_shares(K.picks(rows), K.civ_prior(K.picks(rows))).groupBy("profile_id").pivot("civ", [f"c{k}" for k in range(6)]).agg(F.first(F.sqrt("share")))
    frame = shares.join(K.eligible(rows).select("profile_id", "random_civ_rate"), "profile_id")
    return models.fit_clusters(frame, [f"c{k}" for k in range(6)], ["random_civ_rate"], k=3, components=3).transform(frame).groupBy("cluster").agg(F.count("*").alias("n"))


add("m19_clusters", _clusters)
add("m9_temperature", lambda s, d: s.createDataFrame([(M.fit_temperature(_choice_scores(s, d), ["game_id", "profile_id"], "score"),)], "temperature double"))


def _choice_scores(s, d):
    from .choice import _matrix

    return _matrix(s, d).select("game_id", "profile_id", "target", F.ln(F.col("cand_games_lifetime") + 1.0).alias("score"))


add(
    "l6_temporal_split",
    lambda s, d: splits.temporal_split(player_rows(s, d).select("game_id", "profile_id", "started_at"), ["started_at", "game_id", "profile_id"]).select("game_id", "profile_id", "split"),
    pg_sql("po AS (SELECT *, row_number() OVER (ORDER BY started_at, game_id, profile_id) - 1 AS pos, count(*) OVER () AS t FROM pg)") + "SELECT game_id, profile_id, CASE WHEN pos >= t - floor(t * 0.15) THEN 'test' WHEN pos >= t - floor(t * 0.15) - floor(t * 0.15) THEN 'valid' ELSE 'train' END AS split FROM po",
)
add(
    "l7_group_split",
    lambda s, d: splits.group_split(player_rows(s, d).select("game_id", "profile_id", "started_at"), ["game_id"]).select("game_id", "profile_id", "split"),
    pg_sql("gg AS (SELECT game_id, min(started_at) AS t0 FROM pg GROUP BY 1), po AS (SELECT *, row_number() OVER (ORDER BY t0, game_id) - 1 AS pos, count(*) OVER () AS t FROM gg)") + "SELECT game_id, profile_id, CASE WHEN pos >= t - floor(t * 0.15) THEN 'test' WHEN pos >= t - floor(t * 0.15) - floor(t * 0.15) THEN 'valid' ELSE 'train' END AS split FROM pg JOIN po USING (game_id)",
)
add(
    "l8_season_holdout",
    lambda s, d: splits.season_holdout(player_rows(s, d).select("game_id", "profile_id", "started_at", "season"), [7]).groupBy("season", "split").agg(F.count("*").alias("n")),
    pg_sql("po AS (SELECT *, row_number() OVER (ORDER BY started_at, game_id) - 1 AS pos, count(*) OVER () AS t FROM pg WHERE season <> 7)") + "SELECT season, split, count(*) AS n FROM (SELECT season, CASE WHEN pos >= t - floor(t * 0.15) THEN 'valid' ELSE 'train' END AS split FROM po UNION ALL SELECT season, 'test' FROM pg WHERE season = 7) GROUP BY ALL",
)
add("l9_evenly_spaced", lambda s, d: splits.evenly_spaced(schema.games(s, d).select("game_id"), 50, "game_id"), schema.with_views("games", "po AS (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS pos, count(*) OVER () AS t FROM games)") + "SELECT game_id FROM po WHERE pos IN (SELECT floor(i * (t - 1) / 49.0 + 0.5) FROM (SELECT unnest(range(50)) AS i), (SELECT any_value(t) AS t FROM po))")
add("w25_stride", lambda s, d: splits.stride_sample(schema.games(s, d).select("game_id"), 7, ["game_id"]), schema.with_views("games") + "SELECT game_id FROM (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS pos FROM games) WHERE pos % 7 = 0")
_SW = "game_id, 1 - target AS target, civ_b AS civ_a, civ_a AS civ_b, games_lifetime_b AS games_lifetime_a, games_lifetime_a AS games_lifetime_b, prior_matchup_games, prior_matchup_games - prior_matchup_wins AS prior_matchup_wins, mmr_b - mmr_a AS mmr_diff"
_SC = ["game_id", "target", "civ_a", "civ_b", "games_lifetime_a", "games_lifetime_b", "prior_matchup_games", "prior_matchup_wins", "mmr_diff"]


def _swappable(s, d):
    return training(s, d).withColumn("mmr_diff", F.col("mmr_a") - F.col("mmr_b")).select(*_SC)


add("c7_slot_swap", lambda s, d: splits.swapped(_swappable(s, d)), pg_sql(PS, PRIORS, TF) + f"SELECT {_SW} FROM tf")
add("l5_augmented", lambda s, d: splits.augmented(_swappable(s, d)), pg_sql(PS, PRIORS, TF) + f"SELECT {_SW} FROM tf UNION ALL SELECT {', '.join('mmr_a - mmr_b AS mmr_diff' if c == 'mmr_diff' else c for c in _SC)} FROM tf")
_COIN = "('0x' || md5('swap:' || game_id)[:12])::BIGINT % 2 = 1"
add("c8_half_swapped", lambda s, d: splits.half_swapped(_swappable(s, d)), pg_sql(PS, PRIORS, TF) + f"SELECT {_SW} FROM tf WHERE {_COIN} UNION ALL SELECT {', '.join('mmr_a - mmr_b AS mmr_diff' if c == 'mmr_diff' else c for c in _SC)} FROM tf WHERE NOT ({_COIN})")
add("c24_leakage_audit", lambda s, d: stats(s, d).agg(*[F.sum(X.flag(F.col(w) > F.col(g))).alias(name) for name, w, g in (("lifetime", "wins_lifetime_before", "games_lifetime_before"), ("civ", "civ_wins_before", "civ_games_before"), ("season", "wins_season_before", "games_season_before"))], F.avg(X.flag(F.col("games_lifetime_before") > 0)).alias("coverage")), pg_sql(PS) + f"SELECT count(*) FILTER (wins_lifetime_before > games_lifetime_before) AS lifetime, count(*) FILTER (civ_wins_before > civ_games_before) AS civ, count(*) FILTER (wins_season_before > games_season_before) AS season, {six('avg(CASE WHEN games_lifetime_before > 0 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM ps")
