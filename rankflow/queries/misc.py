"""Queries of data quality, sources, events, serving and plain relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from ..operators import joins, pregame, snapshots, spatial, splits
from ..plans import serving
from .base import PRIORS, PS, TF, add, over, pg_sql, player_rows, six, stats, training

P = schema.participants
G = schema.games
VP = "games participants"

add("a3_count_distinct", lambda s, d: player_rows(s, d).groupBy("season").agg(F.count_distinct("profile_id").alias("players"), F.count_distinct(F.when(F.col("result") == 1, F.col("civ"))).alias("civs")), pg_sql() + "SELECT season, count(DISTINCT profile_id) AS players, count(DISTINCT civ) FILTER (result = 1) AS civs FROM pg GROUP BY 1")
add("a4_having", lambda s, d: P(s, d).groupBy("game_id").agg(F.count("*").alias("n"), F.sum(F.col("result").cast("int")).alias("wins")).filter("n = 2 AND wins <> 1"), schema.with_views(VP) + "SELECT game_id, count(*) AS n, sum(result::INT)::BIGINT AS wins FROM participants GROUP BY 1 HAVING count(*) = 2 AND sum(result::INT) <> 1")
_FL = "fl AS (SELECT profile_id, season, arg_min(mmr, r) AS first_mmr, arg_max(mmr, r) AS last_mmr FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, season ORDER BY started_at, game_id) AS r FROM pg WHERE mmr IS NOT NULL) GROUP BY ALL)"


def _first_last(s, d):
    order = F.struct("started_at", "game_id")
    return player_rows(s, d).filter("mmr IS NOT NULL").groupBy("profile_id", "season").agg(F.min_by("mmr", order).alias("first_mmr"), F.max_by("mmr", order).alias("last_mmr"))


def _adjacent(s, d):
    now = _first_last(s, d)
    later = now.select("profile_id", (F.col("season") - 1).alias("season"), F.col("first_mmr").alias("next_first"))
    return now.join(later, ["profile_id", "season"]).select("profile_id", "season", "last_mmr", "next_first")


add("a5_first_last", _first_last, pg_sql(_FL) + "SELECT * FROM fl")
add("j22_season_adjacent", _adjacent, pg_sql(_FL) + "SELECT a.profile_id, a.season, a.last_mmr, b.first_mmr AS next_first FROM fl AS a JOIN fl AS b ON a.profile_id = b.profile_id AND b.season = a.season + 1")
add("a6_percentiles", lambda s, d: player_rows(s, d).groupBy("season").agg(F.median("mmr").alias("med"), F.percentile("mmr", F.lit(0.9)).alias("p90")), pg_sql() + f"SELECT season, {six('median(mmr)')} AS med, {six('quantile_cont(mmr, 0.9)')} AS p90 FROM pg GROUP BY 1")
_AD = "ad AS (SELECT a.season, b.first_mmr - a.last_mmr AS gap FROM fl AS a JOIN fl AS b ON a.profile_id = b.profile_id AND b.season = a.season + 1)"
add("a32_mmr_continuity", lambda s, d: _adjacent(s, d).withColumn("gap", F.col("next_first") - F.col("last_mmr")).groupBy("season").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.percentile(F.abs("gap"), F.lit(0.9)).alias("p90_abs")), pg_sql(_FL, _AD) + f"SELECT season, count(*) AS n, {six('avg(gap)')} AS mean_gap, {six('median(gap)')} AS median_gap, {six('quantile_cont(abs(gap), 0.9)')} AS p90_abs FROM ad GROUP BY 1")
add("a7_missingness", lambda s, d: P(s, d).join(G(s, d).select("game_id", "season"), "game_id").groupBy("season").agg(*[F.sum(F.col(x).isNull().cast("long")).alias(f"no_{x}") for x in ("result", "rating", "mmr")]), schema.with_views(VP) + "SELECT season, " + ", ".join(f"count(*) FILTER ({x} IS NULL) AS no_{x}" for x in ("result", "rating", "mmr")) + " FROM participants JOIN games USING (game_id) GROUP BY 1")
add("a25_crosstab", lambda s, d: player_rows(s, d).groupBy("map").pivot("civ", [f"c{k}" for k in range(6)]).agg(F.count("civ")).na.fill(0), pg_sql() + "SELECT map, " + ", ".join(f"count(*) FILTER (civ = 'c{k}') AS c{k}" for k in range(6)) + " FROM pg GROUP BY 1")
add("a26_quantiles", lambda s, d: player_rows(s, d).agg(*[F.percentile("duration", F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)]), pg_sql() + "SELECT " + ", ".join(f"{six(f'quantile_cont(duration, {q / 100})')} AS p{q}" for q in (10, 50, 90)) + " FROM pg")
add("a28_distinct", lambda s, d: player_rows(s, d).select("map", "civ").distinct(), pg_sql() + "SELECT DISTINCT map, civ FROM pg")
add("a30_mode_check", lambda s, d: P(s, d).agg(F.count("*").alias("n"), F.count(F.when(F.col("mmr").isNull(), 1)).alias("n_null"), F.min("mmr").alias("lo"), F.max("mmr").alias("hi")), schema.with_views(VP) + "SELECT count(*) AS n, count(*) FILTER (mmr IS NULL) AS n_null, min(mmr) AS lo, max(mmr) AS hi FROM participants")
add("e2_bool_int", lambda s, d: P(s, d).select("game_id", "profile_id", F.col("result").cast("int").alias("r")), schema.with_views(VP) + "SELECT game_id, profile_id, result::INT AS r FROM participants")
add("e4_null_functions", lambda s, d: P(s, d).select("game_id", "profile_id", F.coalesce("mmr", "rating").alias("a"), F.nullif("rating", F.lit(1000)).alias("b"), F.least("mmr", "rating").alias("c")), schema.with_views(VP) + "SELECT game_id, profile_id, coalesce(mmr, rating) AS a, nullif(rating, 1000) AS b, least(mmr, rating) AS c FROM participants")
add("e5_day_difference", lambda s, d: schema.player_game(s, d).withColumn("prev", F.lag("started_at").over(Window.partitionBy("profile_id").orderBy("started_at", "game_id"))).select("game_id", X.days_between("prev", "started_at").alias("days")), schema.with_views("player_game") + f"SELECT game_id, date_diff('day', (lag(started_at) {over('profile_id')})::DATE, started_at::DATE) AS days FROM player_game")
add("e6_date_truncation", lambda s, d: schema.player_game(s, d).groupBy(F.to_date("started_at").alias("day"), F.to_date(F.date_trunc("week", "started_at")).alias("wk")).agg(F.count("*").alias("n")), schema.with_views("player_game") + "SELECT started_at::DATE AS day, date_trunc('week', started_at)::DATE AS wk, count(*) AS n FROM player_game GROUP BY ALL")
add("e8_safe_ratio", lambda s, d: stats(s, d).select("game_id", "profile_id", X.ratio("wins_lifetime_before", "games_lifetime_before").alias("r")), pg_sql(PS) + f"SELECT game_id, profile_id, {six('wins_lifetime_before::DOUBLE / nullif(games_lifetime_before, 0)')} AS r FROM ps")
add("e9_hash_sample", lambda s, d: splits.hash_sample(G(s, d).select("game_id"), "game_id"), schema.with_views("games") + "SELECT game_id FROM games WHERE ('0x' || md5(game_id::VARCHAR)[:12])::BIGINT % 10 < 2")
add("e10_star_except", lambda s, d: G(s, d).drop("started_at", "duration", "map", "kind", "server"), schema.with_views("games") + "SELECT * EXCLUDE (started_at, duration, map, kind, server) FROM games")
add("e31_column_guard", lambda s, d: X.forbid_columns(G(s, d).select("game_id", "map"), ["target"]), schema.with_views("games") + "SELECT game_id, map FROM games")
add("e32_tokens", lambda s, d: s_orders(s, d).select("o_orderkey", X.token("o_orderpriority").alias("t")), "SELECT o_orderkey, CASE WHEN coalesce(o_orderpriority, '') = '' THEN 'unknown' ELSE regexp_replace(lower(o_orderpriority), '[ /]', '_', 'g') END AS t FROM orders")


def s_orders(s, d):
    return schema.table(s, d, "orders")


_KW = [("metal", ["steel", "copper", "brass"]), ("finish", ["polished", "brushed", "plated"])]
add("e33_keyword_class", lambda s, d: schema.table(s, d, "part").select("p_partkey", X.keyword_class("p_type", _KW).alias("kind")), "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%copper%' OR lower(p_type) LIKE '%brass%' THEN 'metal' WHEN lower(p_type) LIKE '%polished%' OR lower(p_type) LIKE '%brushed%' OR lower(p_type) LIKE '%plated%' THEN 'finish' ELSE 'other' END AS kind FROM part")
_U = "((x - 10) * cos(a) + (y - 20) * sin(a)) / h"
_V = "(-(x - 10) * sin(a) + (y - 20) * cos(a)) / h"


def _cells(s, d):
    rows = schema.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 3).alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y")).distinct()
    r, c = X.grid_cell(F.col("x"), F.col("y"), (F.lit(10.0), F.lit(20.0)), (F.lit(110.0), F.lit(80.0)), 64)
    return rows.groupBy(r.alias("row"), c.alias("col")).agg(F.count("*").alias("n"))


_cell = lambda z: f"least(greatest(floor(({z}) * 64), 0), 63)::INT"
add("e34_grid_cells", _cells, f"SELECT {_cell(f'({_U} + 0.5) / 2')} AS row, {_cell(f'({_V} + 1) / 2')} AS col, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity * 3 AS x, (l_partkey % 100)::DOUBLE AS y, atan2(60.0, 100.0) AS a, sqrt(13600.0::DOUBLE) AS h FROM lineitem) GROUP BY ALL")
add("j19_not_exists", lambda s, d: joins.insert_new(P(s, d).filter("game_id % 2 = 0").select("game_id", "profile_id"), P(s, d).select("game_id", "profile_id", "mmr"), ["game_id", "profile_id"]), schema.with_views(VP) + "SELECT game_id, profile_id, mmr FROM participants WHERE game_id % 2 <> 0")
_RK = "rk AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, game_id DESC) AS rn FROM pg)"


def _ranked(s, d):
    w = Window.partitionBy("profile_id").orderBy(F.desc("started_at"), F.desc("game_id"))
    return player_rows(s, d).withColumns({"rn": F.row_number().over(w), "newest": F.first("civ").over(w)})


add("j20_current_streak", lambda s, d: _ranked(s, d).groupBy("profile_id").agg(F.coalesce(F.min(F.when(F.col("civ") != F.col("newest"), F.col("rn"))) - 1, F.count("*")).cast("long").alias("streak")), pg_sql(_RK) + "SELECT r.profile_id, count(*) AS streak FROM rk AS r WHERE NOT EXISTS (SELECT 1 FROM rk AS q WHERE q.profile_id = r.profile_id AND q.rn <= r.rn AND q.civ <> (SELECT civ FROM rk AS f WHERE f.profile_id = r.profile_id AND f.rn = 1)) GROUP BY 1")
add("j21_scalar_lookups", lambda s, d: _ranked(s, d).groupBy("profile_id").agg(F.count("*").alias("games"), F.sum(X.flag((F.col("rn") <= 20) & (F.col("civ") == "c1"))).alias("c1_last20"), F.max(F.when(F.col("civ") == "c1", F.col("started_at"))).alias("c1_last"), F.sum(F.when(F.col("map") == "m2", F.col("result")).otherwise(0)).alias("m2_wins")), pg_sql(_RK) + "SELECT profile_id, count(*) AS games, count(*) FILTER (rn <= 20 AND civ = 'c1') AS c1_last20, max(started_at) FILTER (civ = 'c1') AS c1_last, coalesce(sum(result) FILTER (map = 'm2'), 0)::BIGINT AS m2_wins FROM rk GROUP BY 1")
add("c35_civ_candidate_state", lambda s, d: _ranked(s, d).groupBy("profile_id", "civ").agg(F.count("*").alias("games"), F.sum("result").alias("wins"), F.min("rn").cast("long").alias("last_position")), pg_sql(_RK) + "SELECT profile_id, civ, count(*) AS games, sum(result)::BIGINT AS wins, min(rn) AS last_position FROM rk GROUP BY ALL")
add("j24_override", lambda s, d: joins.override(P(s, d).select("game_id", "profile_id", "mmr"), P(s, d).filter("game_id % 3 = 0").select("game_id", "profile_id", F.col("rating").alias("mmr")), ["game_id", "profile_id"], ["mmr"]), schema.with_views(VP) + "SELECT game_id, profile_id, CASE WHEN game_id % 3 = 0 THEN rating ELSE mmr END AS mmr FROM participants")
add("j28_external_ids", lambda s, d: training(s, d).join(G(s, d).filter("map_id = 3").select("game_id"), "game_id").select("game_id", "target"), pg_sql(PS, PRIORS, TF) + "SELECT game_id, target FROM tf WHERE game_id IN (SELECT game_id FROM games WHERE map_id = 3)")


def _daily(s, d):
    return player_rows(s, d).groupBy("profile_id", F.to_date("started_at").alias("day")).agg(F.count("*").alias("games"))


add("j27_day_features", lambda s, d: player_rows(s, d).withColumn("day", F.to_date("started_at")).select("game_id", "profile_id", "day").join(_daily(s, d), ["profile_id", "day"], "left"), pg_sql("dl AS (SELECT profile_id, started_at::DATE AS day, count(*) AS games FROM pg GROUP BY ALL)") + "SELECT game_id, profile_id, day, games FROM (SELECT *, started_at::DATE AS day FROM pg) LEFT JOIN dl USING (profile_id, day)")
add("j26_swap_exchange", lambda s, d: training(s, d).select("game_id", F.when(F.col("game_id") % 4 == 0, F.col("mmr_b")).otherwise(F.col("mmr_a")).alias("first"), F.when(F.col("game_id") % 4 == 0, F.col("mmr_a")).otherwise(F.col("mmr_b")).alias("second")), pg_sql(PS, PRIORS, TF) + "SELECT game_id, CASE WHEN game_id % 4 = 0 THEN mmr_b ELSE mmr_a END AS first, CASE WHEN game_id % 4 = 0 THEN mmr_a ELSE mmr_b END AS second FROM tf")
add("l1_latest_rows", lambda s, d: splits.top_n(player_rows(s, d).select("game_id", "profile_id", "started_at"), 20, F.desc("started_at"), F.desc("game_id"), "profile_id"), pg_sql() + "SELECT game_id, profile_id, started_at FROM pg ORDER BY started_at DESC, game_id DESC, profile_id LIMIT 20")
add("l3_top_or_other", lambda s, d: splits.top_or_other(player_rows(s, d), "map", 3).groupBy("map").agg(F.count("*").alias("n")), pg_sql("tm AS (SELECT map FROM pg GROUP BY map ORDER BY count(*) DESC, map LIMIT 3)") + "SELECT CASE WHEN map IN (SELECT map FROM tm) THEN map ELSE 'other' END AS map, count(*) AS n FROM pg GROUP BY 1")
add("l10_chronological_split", lambda s, d: splits.temporal_split(G(s, d).select("game_id"), ["game_id"]).groupBy("split").agg(F.min("game_id").alias("lo"), F.max("game_id").alias("hi"), F.count("*").alias("n")), schema.with_views("games", "po AS (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS pos, count(*) OVER () AS t FROM games)") + "SELECT CASE WHEN pos >= t - floor(t * 0.15) THEN 'test' WHEN pos >= t - floor(t * 0.15) - floor(t * 0.15) THEN 'valid' ELSE 'train' END AS split, min(game_id) AS lo, max(game_id) AS hi, count(*) AS n FROM po GROUP BY 1")
add("l11_random_sample", lambda s, d: splits.seeded_sample(G(s, d).select("game_id"), "game_id", 0.1, 7), schema.with_views("games") + f"SELECT game_id FROM games WHERE ('0x' || md5('7:' || game_id)[:12])::BIGINT < {int(0.1 * 2**48)}")
add("l12_drop_duplicates", lambda s, d: splits.first_in_group(schema.table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), ["l_orderkey", "l_suppkey"], "l_partkey"), "SELECT l_orderkey, l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
add("l13_intersection", lambda s, d: G(s, d).select("game_id").intersect(P(s, d).select("game_id")), schema.with_views(VP) + "SELECT game_id FROM games INTERSECT SELECT game_id FROM participants")
add("s5_idempotent_insert", lambda s, d: joins.replace_rows(P(s, d).filter("game_id % 2 = 0").select("game_id", "profile_id", "mmr"), P(s, d).select("game_id", "profile_id", "mmr"), ["game_id", "profile_id"], ignore=True), schema.with_views(VP) + "SELECT game_id, profile_id, mmr FROM participants")
add("s15_upsert", lambda s, d: joins.upsert(P(s, d).filter("game_id % 3 <> 1").select("game_id", "profile_id", "mmr", "rating"), P(s, d).filter("game_id % 3 <> 0").select("game_id", "profile_id", F.col("rating").alias("mmr"), F.lit(None).cast("int").alias("rating")), ["game_id", "profile_id"]), schema.with_views(VP) + "SELECT game_id, profile_id, CASE WHEN game_id % 3 = 0 THEN mmr WHEN game_id % 3 = 1 THEN rating ELSE coalesce(rating, mmr) END AS mmr, CASE WHEN game_id % 3 <> 1 THEN rating END AS rating FROM participants")
add("s16_insert_or_replace", lambda s, d: joins.replace_rows(P(s, d).filter("game_id % 2 = 0").select("game_id", "profile_id", "mmr"), P(s, d).filter("game_id % 3 = 0").select("game_id", "profile_id", F.lit(1).cast("int").alias("mmr")), ["game_id", "profile_id"]), schema.with_views(VP) + "SELECT game_id, profile_id, CASE WHEN game_id % 3 = 0 THEN 1 ELSE mmr END::INT AS mmr FROM participants WHERE game_id % 2 = 0 OR game_id % 3 = 0")
add("s2_name_patterns", lambda s, d: G(s, d).select("game_id", F.regexp_extract(F.concat(F.lit("dump_s"), F.col("season"), F.lit(".json")), r"_s(\d+)\.json", 1).cast("int").alias("season")), schema.with_views("games") + "SELECT game_id, season FROM games")
add("s3_results", lambda s, d: s_orders(s, d).select("o_orderkey", _result(F.when(F.col("o_orderstatus") == "F", "Win").when(F.col("o_orderstatus") == "O", "loss")).alias("r")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS r FROM orders")
add("s9_patch_fallback", lambda s, d: _patches(s, d), schema.with_views("games") + "SELECT patch, min(started_at)::DATE AS patch_start_at, max(season) AS season FROM games GROUP BY 1")
add("s18_json_fields", lambda s, d: schema.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")


def _result(x):
    from ..sources.readers import result_of

    return result_of(x)


def _patches(s, d):
    from ..sources.readers import read_patches

    return read_patches(s, None, G(s, d))


# Replay events made of the event table: a replay is 200 events in a row, a slot is the parity of the user.
_RE = "re AS (SELECT event_id // 200 AS replay_id, (event_id % 200 * 11)::DOUBLE AS time_s, (user_id % 2 + 1)::INT AS player_slot, event_type AS kind, value FROM events)"


def _replay(s, d):
    e = schema.table(s, d, "events")
    return e.select(F.expr("event_id DIV 200").alias("replay_id"), (F.col("event_id") % 200 * 11).cast("double").alias("time_s"), (F.col("user_id") % 2 + 1).cast("int").alias("player_slot"), F.col("event_type").alias("key"), F.col("value"))


def _cumulated(s, d):
    return snapshots.cumulative(_replay(s, d), snapshots.checkpoints(_replay(s, d)))


_CP = "cp AS (SELECT replay_id, unnest(range(5, floor(max(time_s) / 60)::INT + 1, 5))::INT AS minute FROM re GROUP BY 1)"
_CU = "cu AS (SELECT cp.replay_id, minute, player_slot, kind, coalesce(sum(value) FILTER (time_s <= minute * 60), 0) AS v, count(*) FILTER (time_s <= minute * 60) AS n FROM cp JOIN re USING (replay_id) GROUP BY ALL)"
add("a23_checkpoint_counters", lambda s, d: _cumulated(s, d).select("replay_id", "minute", "player_slot", "key", "value"), f"WITH {_RE}, {_CP}, {_CU} SELECT replay_id, minute, player_slot, kind AS key, {six('v')} AS value FROM cu")
add("w27_checkpoint_deltas", lambda s, d: _cumulated(s, d).select("replay_id", "minute", "player_slot", "key", "delta"), f"WITH {_RE}, {_CP}, {_CU} SELECT replay_id, minute, player_slot, kind AS key, {six('greatest(v - coalesce(lag(v) OVER (PARTITION BY replay_id, player_slot, kind ORDER BY minute), 0), 0)')} AS delta FROM cu")
_VIEW = "vw AS (SELECT replay_id, minute, coalesce(sum(v) FILTER (player_slot = 1 AND kind = 'view'), 0) AS a, coalesce(sum(v) FILTER (player_slot = 2 AND kind = 'view'), 0) AS b FROM cu GROUP BY ALL)"


def _views(s, d):
    return snapshots.slot_views(_cumulated(s, d), ["view"])


add("c11_slot_views", _views, f"WITH {_RE}, {_CP}, {_CU}, {_VIEW} SELECT replay_id, minute, {six('a')} AS slot1_view, {six('b')} AS slot2_view, {six('a + b')} AS sum_view, {six('a - b')} AS diff_view, {six('a / nullif(a + b, 0)')} AS share_slot1_view FROM vw")
add("c10_snapshot_swap", lambda s, d: snapshots.swap_slots(_views(s, d)), f"WITH {_RE}, {_CP}, {_CU}, {_VIEW} SELECT replay_id, minute, {six('b')} AS slot1_view, {six('a')} AS slot2_view, {six('a + b')} AS sum_view, {six('b - a')} AS diff_view, {six('1 - a / nullif(a + b, 0)')} AS share_slot1_view FROM vw")
add("w28_latest_before", lambda s, d: snapshots.latest_before(_views(s, d).select("replay_id", "minute", "sum_view"), 22), f"WITH {_RE}, {_CP}, {_CU}, {_VIEW} SELECT replay_id, max(minute) AS minute, {six('arg_max(a + b, minute)')} AS sum_view FROM vw WHERE minute <= 22 GROUP BY 1")
add("w29_row_weights", lambda s, d: snapshots.row_weights(_views(s, d)).select("replay_id", "minute", "row_weight", snapshots.phase().alias("phase")), f"WITH {_RE}, {_CP} SELECT replay_id, minute, {six('1.0::DOUBLE / count(*) OVER (PARTITION BY replay_id)')} AS row_weight, CASE WHEN minute <= 10 THEN 'early' WHEN minute <= 20 THEN 'mid' ELSE 'late' END AS phase FROM cp")
add("a24_first_times", lambda s, d: _replay(s, d).groupBy("replay_id", "player_slot").agg(*[F.min(F.when(F.col("key") == k, F.col("time_s"))).alias(f"first_{k}") for k in ("view", "purchase")]), f"WITH {_RE} SELECT replay_id, player_slot, min(time_s) FILTER (kind = 'view') AS first_view, min(time_s) FILTER (kind = 'purchase') AS first_purchase FROM re GROUP BY ALL")


def _intents(s, d):
    e = schema.table(s, d, "events")
    category = F.when(F.col("event_type") == "view", "unit_production").when(F.col("event_type") == "click", "building").when(F.col("event_type") == "purchase", "technology_research").when(F.col("event_type") == "error", "cancel").otherwise("villager_action")
    pbgid = (F.col("event_id") % 23).cast("string")
    none = F.lit(None).cast("string")
    when = lambda c, x: F.when(category == c, x)
    intent = F.struct(
        (F.col("event_id") % 5 == 0).alias("is_queued"), when("unit_production", pbgid).alias("unit_pbgid"), when("building", pbgid).alias("pbgid"), when("technology_research", pbgid).alias("technology_pbgid"), none.alias("producer_building_link_status"), none.alias("action_kind"), none.alias("resource_kind"),
        F.col("value").alias("selected_unit_count"), none.alias("cancel_kind"), when("cancel", F.lit("unit_production")).alias("canceled_item_kind"), none.alias("canceled_pbgid"), (F.col("value") % 300).alias("position_x"), (F.col("event_id") % 311).cast("double").alias("position_y"),
    )
    return e.select(F.expr("event_id DIV 200").alias("replay_id"), (F.col("event_id") % 200 * 11).cast("double").alias("time_s"), (F.col("event_id") % 200).cast("int").alias("command_index"), (F.col("user_id") % 2 + 1).cast("int").alias("player_slot"), category.alias("intent_category"), intent.alias("intent"))


def _catalogue(s):
    rows = s.range(20)
    costs = F.struct(*[(F.col("id") * k % 50).cast("double").alias(r) for k, r in zip((3, 5, 7, 11), snapshots.RESOURCES, strict=True)])
    return rows.select(F.col("id").alias("pbgid"), (F.col("id") % 4 + 1).cast("int").alias("age"), costs.alias("costs"), (F.col("id") == 7).alias("is_age_up_building"), (F.col("id") == 9).alias("is_age_up_tech"), F.when(F.col("id") == 7, 2).alias("ageup_to_tier"))


_CAT = "CASE event_type WHEN 'view' THEN 'unit' WHEN 'click' THEN 'building' WHEN 'purchase' THEN 'technology' END"
_EV = f"ev AS (SELECT event_id // 200 AS replay_id, (event_id % 200 * 11)::DOUBLE AS time_s, (user_id % 2 + 1)::INT AS player_slot, {_CAT} AS c, event_id % 23 AS id FROM events)"


def _costs(s, d):
    return snapshots.event_metrics(_intents(s, d), _catalogue(s)).filter("key RLIKE 'known_metadata_count$|known_cost_food$'").groupBy("player_slot", "key").agg(F.sum("value").alias("value"))


add("c12_event_metrics", _costs, f"WITH {_EV} SELECT player_slot, c || '_unknown_metadata_count' AS key, count(*)::DOUBLE AS value FROM ev WHERE c IS NOT NULL AND id >= 20 GROUP BY ALL UNION ALL SELECT player_slot, c || '_known_metadata_count', count(*)::DOUBLE FROM ev WHERE c IS NOT NULL AND id < 20 GROUP BY ALL UNION ALL SELECT player_slot, c || '_known_cost_food', sum(id * 3 % 50)::DOUBLE FROM ev WHERE c IS NOT NULL AND id < 20 GROUP BY ALL")
add("s20_catalogue_join", lambda s, d: _intents(s, d).filter("intent.unit_pbgid IS NOT NULL").join(_catalogue(s).select(F.col("pbgid").cast("string").alias("unit"), "age"), F.col("intent.unit_pbgid") == F.col("unit")).groupBy("age").agg(F.count("*").alias("n")), f"WITH {_EV} SELECT (id % 4 + 1)::INT AS age, count(*) AS n FROM ev WHERE c = 'unit' AND id < 20 GROUP BY 1")
_UNITS = ["unit_known_cost_total_resources", *[f"unit_known_cost_{r}" for r in snapshots.RESOURCES]]


def _fractions(s, d):
    m = snapshots.event_metrics(_intents(s, d), _catalogue(s))
    rows = snapshots.slot_views(snapshots.cumulative(m, snapshots.checkpoints(_intents(s, d)), _UNITS), _UNITS)
    return snapshots.with_fractions(rows).select("replay_id", "minute", "slot1_unit_food_frac", "slot2_unit_gold_frac", "diff_unit_wood_frac")


_FT = "+".join(f"id * {k} % 50" for k in (3, 5, 7, 11))
_FS = lambda s, k: f"(coalesce(sum(id * {k} % 50) FILTER (player_slot = {s} AND time_s <= minute * 60), 0)::DOUBLE / greatest(coalesce(sum({_FT}) FILTER (player_slot = {s} AND time_s <= minute * 60), 0), 1e-6))"
add("c13_fractions", _fractions, f"WITH {_RE}, {_CP}, {_EV} SELECT replay_id, minute, {six(_FS(1, 3))} AS slot1_unit_food_frac, {six(_FS(2, 7))} AS slot2_unit_gold_frac, {six(_FS(1, 5) + ' - ' + _FS(2, 5))} AS diff_unit_wood_frac FROM cp JOIN (SELECT * FROM ev WHERE c = 'unit' AND id < 20) USING (replay_id) GROUP BY ALL")
_first = lambda s, c: f"min(time_s) FILTER (player_slot = {s} AND {c})"
add(
    "c14_milestones",
    lambda s, d: snapshots.milestones(_intents(s, d), _catalogue(s)).select("replay_id", "slot1_ageup2_commit_s", "slot2_first_age3_unit_s", "diff_first_age4_tech_s", "slot1_age2_commit_to_unit_s"),
    f"WITH {_EV} SELECT replay_id, {_first(1, '((c = chr(98) || chr(117) || chr(105) || chr(108) || chr(100) || chr(105) || chr(110) || chr(103) AND id = 7) OR (c = ' + chr(39) + 'technology' + chr(39) + ' AND id = 9 AND id % 4 + 1 = 2))')} AS slot1_ageup2_commit_s, "
    f"{_first(2, 'c = ' + chr(39) + 'unit' + chr(39) + ' AND id % 4 + 1 = 3')} AS slot2_first_age3_unit_s, {_first(1, 'c = ' + chr(39) + 'technology' + chr(39) + ' AND id <> 9 AND id % 4 + 1 = 4')} - {_first(2, 'c = ' + chr(39) + 'technology' + chr(39) + ' AND id <> 9 AND id % 4 + 1 = 4')} AS diff_first_age4_tech_s, "
    f"{_first(1, 'c = ' + chr(39) + 'unit' + chr(39) + ' AND id % 4 + 1 = 2')} - {_first(1, '((c = ' + chr(39) + 'building' + chr(39) + ' AND id = 7) OR (c = ' + chr(39) + 'technology' + chr(39) + ' AND id = 9))')} AS slot1_age2_commit_to_unit_s FROM ev WHERE c IS NOT NULL AND id < 20 GROUP BY 1".replace("chr(98) || chr(117) || chr(105) || chr(108) || chr(100) || chr(105) || chr(110) || chr(103)", "'building'"),
)
add("w30_time_gate", lambda s, d: spatial.gate_by_last_kept(_replay(s, d).withColumn("command_index", F.lit(0)).select("replay_id", "player_slot", "key", "time_s", "command_index"), ["replay_id", "player_slot", "key"], 60.0), f"WITH RECURSIVE {_RE}, kept AS (SELECT replay_id, player_slot, kind, min(time_s) AS time_s FROM re GROUP BY ALL UNION ALL SELECT k.replay_id, k.player_slot, k.kind, min(re.time_s) FROM kept AS k JOIN re ON re.replay_id = k.replay_id AND re.player_slot = k.player_slot AND re.kind = k.kind AND re.time_s >= k.time_s + 60 GROUP BY k.replay_id, k.player_slot, k.kind, k.time_s) SELECT replay_id, player_slot, kind AS key, time_s FROM kept")
add("c15_heatmap", lambda s, d: spatial.heatmap(spatial.cells(_intents(s, d))))
add("c25_label_sources", lambda s, d: snapshots.resolve_labels([G(s, d).filter("game_id % 3 = 0").select(F.col("game_id").alias("replay_id"), F.lit(1).alias("target")), G(s, d).filter("game_id % 2 = 0").select(F.col("game_id").alias("replay_id"), F.lit(0).alias("target"))]), "SELECT o_orderkey AS replay_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS target, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS label_source FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")

# Serving.
_RQ = "rq AS (SELECT 1000000 + game_id AS request_id, profile_id, civ, map, season, started_at AS at FROM pg)"


def _requests(s, d):
    return player_rows(s, d).select((F.col("game_id") + 1000000).alias("request_id"), "profile_id", "civ", "map", "season", F.col("started_at").alias("at"))


_rc = lambda c: f"count(h.game_id) FILTER ({c})"
_rs = lambda c: f"coalesce(sum(h.result) FILTER ({c}), 0)::BIGINT"
_SP = {"lifetime": "true", "season": "h.season = rq.season", "civ": "h.civ = rq.civ", "map": "h.map = rq.map"}
add(
    "c30_states_as_of",
    lambda s, d: serving.states_as_of(player_rows(s, d), _requests(s, d)),
    pg_sql(_RQ) + "SELECT rq.request_id, rq.profile_id, " + ", ".join(f"{f(c)} AS {x}_{k}" for k, f in (("games", _rc), ("wins", _rs)) for x, c in _SP.items()) + ", arg_max(h.mmr, (h.started_at, h.game_id)) FILTER (h.mmr IS NOT NULL) AS latest_mmr, arg_max(h.rating, (h.started_at, h.game_id)) FILTER (h.rating IS NOT NULL) AS latest_rating FROM rq LEFT JOIN pg AS h ON h.profile_id = rq.profile_id AND h.started_at < rq.at GROUP BY rq.request_id, rq.profile_id",
)
_CP2 = "hc AS (SELECT profile_id, civ, count(*) AS n FROM pg GROUP BY ALL), cpk AS (SELECT pg.game_id, pg.profile_id, hc.civ, hc.n, n::DOUBLE / sum(n) OVER (PARTITION BY pg.game_id, pg.profile_id) AS p FROM pg JOIN hc USING (profile_id))"


def _civ_shares(s, d):
    rows = player_rows(s, d)
    counts = rows.select("game_id", "profile_id").join(rows.groupBy("profile_id", "civ").agg(F.count("*").alias("n")), "profile_id")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("game_id", "profile_id"))).withColumn("side", F.dense_rank().over(Window.partitionBy("game_id").orderBy("profile_id")))


def _marginal(s, d):
    shares = _civ_shares(s, d).withColumnRenamed("game_id", "request_id")
    win = joins.pair_up(player_rows(s, d), ["civ", "result"]).groupBy("civ_a", "civ_b").agg(F.avg("result_a").alias("p"))
    return serving.marginal_win(shares.filter("side = 1"), shares.filter("side = 2"), win)


add("c26_marginal_win", _marginal, pg_sql(_CP2, "sd AS (SELECT *, dense_rank() OVER (PARTITION BY game_id ORDER BY profile_id) AS side FROM cpk), wn AS (SELECT a.civ AS civ_a, b.civ AS civ_b, avg(a.result) AS pw FROM pg AS a JOIN pg AS b ON a.game_id = b.game_id AND a.profile_id < b.profile_id GROUP BY ALL)") + f"SELECT a.game_id AS request_id, {six('sum(a.p * b.p * coalesce(pw, 0.5)) / nullif(sum(a.p * b.p), 0)')} AS p_win FROM sd AS a JOIN sd AS b ON a.game_id = b.game_id AND a.side = 1 AND b.side = 2 LEFT JOIN wn ON wn.civ_a = a.civ AND wn.civ_b = b.civ GROUP BY 1")
add("c36_civ_distribution", lambda s, d: serving.civ_distribution(_civ_shares(s, d).withColumn("games", F.sum("n").over(Window.partitionBy("game_id", "profile_id"))).withColumn("score", F.sqrt(F.col("n").cast("double"))), ["game_id", "profile_id"], "score", "games", 300).select("game_id", "profile_id", "civ", "p"), pg_sql(_CP2) + f"SELECT game_id, profile_id, civ, {six('CASE WHEN sum(n) OVER w < 300 THEN 1.0::DOUBLE / count(*) OVER w ELSE sqrt(n) / sum(sqrt(n)) OVER w END')} AS p FROM cpk WINDOW w AS (PARTITION BY game_id, profile_id)")
add("c38_context", lambda s, d: serving.context(pregame.base_derived(training(s, d))).select("game_id", "context_level", F.array_join("warnings", "; ").alias("warnings")), pg_sql(PS, PRIORS, TF) + "SELECT game_id, CASE WHEN civ_a IS NOT NULL AND civ_b IS NOT NULL AND map IS NOT NULL THEN 'full' WHEN civ_a IS NOT NULL AND civ_b IS NOT NULL THEN 'civs' WHEN map IS NOT NULL THEN 'map' ELSE 'players' END AS context_level, concat_ws('; ', CASE WHEN map IS NULL THEN 'unknown map' END, CASE WHEN civ_a IS NULL OR civ_b IS NULL THEN 'unknown civilization' END, CASE WHEN coalesce(mmr_a, rating_a) IS NULL THEN 'no skill of player a' END, CASE WHEN coalesce(mmr_b, rating_b) IS NULL THEN 'no skill of player b' END, CASE WHEN games_lifetime_a < 10 THEN 'few games of player a' END, CASE WHEN games_lifetime_b < 10 THEN 'few games of player b' END) AS warnings FROM tf")
add("c32_mirror_matchup", lambda s, d: serving.mirror_fixed(pregame.matchup_priors(stats(s, d)).groupBy("civ_a", "civ_b").agg(F.max("prior_games").alias("games"), F.max("prior_wins").alias("wins"))), pg_sql(PS, PRIORS) + "SELECT civ_a, civ_b, games, CASE WHEN civ_a = civ_b THEN games // 2 ELSE wins END AS wins FROM (SELECT civ_a, civ_b, max(prior_games) AS games, max(prior_wins) AS wins FROM priors GROUP BY ALL)")
add("c30_latest_matchup", lambda s, d: serving.latest_matchup(training(s, d).select("game_id", "civ_a", "civ_b", "season"), pregame.matchup_priors(stats(s, d))).select("game_id", "prior_games", "prior_wins"), pg_sql(PS, PRIORS, TF) + "SELECT game_id, prior_games, prior_wins FROM (SELECT game_id, civ_a, civ_b, season FROM tf) AS t ASOF LEFT JOIN priors AS p ON p.civ_a = t.civ_a AND p.civ_b = t.civ_b AND t.season >= p.season")
