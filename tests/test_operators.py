"""Scenarios with known answers."""

from __future__ import annotations

import base64
import datetime as dt
import json
import zlib

import pytest
from pyspark.sql import functions as F

from rankflow.functions import exprs as X
from rankflow.operators import history, joins, pregame, rating, snapshots, spatial, splits
from rankflow.operators import metrics as M
from rankflow.plans import models, serving
from rankflow.sources import readers, sinks

DAY0 = dt.datetime(2026, 1, 1)
ROWS = "game_id long, profile_id long, result int, civ string, mmr int, rating int, started_at timestamp_ntz, duration int, map string, season int, patch string, civilization_randomized boolean"


def row(game, player, result, at, civ="c", mmr=None, rating=None, duration=600, map="m", season=11):
    return (game, player, result, civ, mmr, rating, at, duration, map, season, "p", False)


def cap_rows():
    """Player 1 beats 2, then each plays fifty others, then they meet again."""
    rows = [row(1, 1, 1, DAY0), row(1, 2, 0, DAY0)]
    for own, start in ((1, 2), (2, 52)):
        for g in range(start, start + 50):
            at, length = DAY0 + dt.timedelta(hours=g), 600 if g % 2 == 0 else 2400
            won = int(g % (3 if own == 1 else 4) != 0)
            rows += [row(g, own, won, at, duration=length), row(g, 1000 + g, 1 - won, at, duration=length)]
    at = DAY0 + dt.timedelta(hours=200)
    return rows + [row(102, 1, 0, at, duration=1200), row(102, 2, 1, at, duration=1200)]


def test_capped_history_forgets_the_oldest_game(spark):
    rows = spark.createDataFrame(cap_rows(), ROWS).cache()
    keys = joins.pair_up(rows, []).filter("game_id = 102")
    full = pregame.player_stats_ext(rows).filter("game_id = 102 AND profile_id = 1").first()
    capped = history.capped_overrides(keys, rows, 50).first()
    assert (full["civ_games_60d"], capped["civ_games_60d_a"], capped["civ_games_60d_b"]) == (51, 50, 50)
    assert (full["short_games"], capped["short_games_a"]) == (26, 25)
    assert (capped["h2h_games"], capped["h2h_wins_a"]) == (0, 0)
    meeting = pregame.h2h_priors(rows).filter("game_id = 102").first()
    assert (meeting["h2h_games_before"], meeting["h2h_wins_lo_before"]) == (1, 1)


def test_cap_is_respected(spark):
    rows = [row(g, 1, 1, DAY0 + dt.timedelta(hours=g)) for g in range(1, 36)] + [row(g, 500 + g, 0, DAY0 + dt.timedelta(hours=g)) for g in range(1, 36)]
    at = DAY0 + dt.timedelta(hours=99)
    df = spark.createDataFrame([*rows, row(36, 1, 1, at), row(36, 9999, 0, at)], ROWS)
    out = history.capped_overrides(joins.pair_up(df, []).filter("game_id = 36"), df, 30).first()
    assert (out["visible_games_a"], out["visible_games_b"]) == (30, 0)


def test_window_temporal(spark):
    days = [0, 1, 2, 12, 13]
    rows = [row(g, 1, 1, DAY0 + dt.timedelta(days=d)) for g, d in enumerate(days)] + [row(g, 50 + g, 0, DAY0 + dt.timedelta(days=d)) for g, d in enumerate(days)]
    at = DAY0 + dt.timedelta(days=20)
    df = spark.createDataFrame([*rows, row(9, 1, 1, at), row(9, 99, 0, at)], ROWS)
    out = history.apply_temporal(joins.pair_up(df, []).filter("game_id = 9"), df, 30).first()
    assert (out["window_span_days_a"], out["gap_max_window_a"], out["wt_act_7d_a"], out["wt_act_30d_a"], out["wt_act_30d_b"]) == (20, 10, 1, 5, 0)
    assert out["games_per_day_window_a"] == pytest.approx(5 / 21)


def test_career_leaves_the_match_itself_out(spark):
    rows = [row(g, 1, int(g <= 20), DAY0 + dt.timedelta(days=g), mmr=1400 + g) for g in range(1, 41)]
    at = DAY0 + dt.timedelta(days=60)
    df = spark.createDataFrame([*rows, row(41, 1, 1, at, mmr=1600)], ROWS)
    out = history.career(pregame.player_stats(df)).filter("game_id = 41").first()
    assert (out["career_avg_mmr"], out["peak_mmr"], out["career_games"], out["career_wins"]) == (1420.5, 1440, 40, 20)


def test_later_rows_change_nothing(spark):
    rows = cap_rows()
    late = [row(900, 1, 1, DAY0 + dt.timedelta(days=300)), row(900, 2, 0, DAY0 + dt.timedelta(days=300))]
    get = lambda r: pregame.player_stats_ext(pregame.player_stats(spark.createDataFrame(r, ROWS))).filter("game_id <= 102").orderBy("game_id", "profile_id").collect()
    assert get(rows) == get(rows + late)


def test_wins_never_exceed_games(spark):
    s = pregame.player_stats(spark.createDataFrame(cap_rows(), ROWS))
    assert s.filter("wins_lifetime_before > games_lifetime_before OR civ_wins_before > civ_games_before OR wins_season_before > games_season_before").count() == 0


def test_player_state(spark):
    schema = ROWS + ", rating_diff int, mmr_diff int"
    one = [(*row(i, 1, 1, dt.datetime(2026, 5, 1) + dt.timedelta(days=i), mmr=1300 + 12 * i, rating=1200 + 10 * i), 10, 12) for i in range(12)]
    two = [(*row(100 + i, 2, 1, dt.datetime(2026, 5, 1) + dt.timedelta(days=i), rating=1000 + i), 1, None) for i in range(3)]
    df = spark.createDataFrame(one + two, schema)
    s = {r["profile_id"]: r for r in rating.player_state(df).collect()}
    assert (s[1]["rating"], s[1]["mmr"], s[1]["streak"], s[1]["recent_wr_10"]) == (1320, 1444, 12, 1.0)
    assert (s[2]["mmr"], s[2]["streak"]) == (None, 3)
    early = rating.player_state(df, F.lit(dt.datetime(2026, 5, 3))).filter("profile_id = 1").first()
    assert (early["games"], early["rating"], early["streak"]) == (2, 1220, 2)


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (23.5, 23.49, -23.5, -23.4)], "x double")
    assert [r[0] for r in df.select(X.round_half_away("x")).collect()] == [24, 23, -24, -23]
    assert [r[0] for r in spark.createDataFrame([(23.9,), (-23.1,)], "x double").select(F.floor("x")).collect()] == [23, -24]


def test_cold_start(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1400, None, None)], "mmr_a int, mmr_b int, rating_a int, rating_b int")
    both, one = X.cold_start(df).collect()
    assert (both["skill_a"], both["skill_b"], both["imputed"], both["impute_method"]) == (1000, 1000, 2, "global_baseline")
    assert (one["skill_a"], one["skill_b"], one["impute_method"]) == (1150, 1400, "opponent_aware")


def test_conditional_deltas_warn(spark):
    df = spark.createDataFrame([(1, 1200, None)], "game_id long, rating_a int, rating_b int")
    rows = rating.conditional_deltas(df).collect()
    assert len(rows) == 4 and all(r["delta"] is None for r in rows) and {r["warnings"] for r in rows} == {"no_opponent_rating", "no_rating"}


def test_swap_twice_is_identity(spark):
    df = spark.createDataFrame([(1, 1, 1400, 1200, 200, 30, 20, 0.625)], "game_id long, target int, mmr_a int, mmr_b int, mmr_diff int, prior_matchup_games int, prior_matchup_wins int, prior_matchup_wr_a double")
    once = splits.swapped(df)
    r = once.first()
    assert (r["target"], r["mmr_a"], r["mmr_diff"], r["prior_matchup_wins"], r["prior_matchup_wr_a"]) == (0, 1200, -200, 10, 0.375)
    assert splits.swapped(once).collect() == df.collect()


def test_mirror_matchup_and_equal_times(spark):
    df = spark.createDataFrame([("x", "x", 11, 9), ("x", "y", 10, 4)], "civ_a string, civ_b string, games long, wins long")
    assert [r["wins"] for r in serving.mirror_fixed(df).collect()] == [5, 4]
    probes = spark.createDataFrame([(1, 7, 10), (2, 7, 11), (3, 8, 11)], "game_id long, k long, t long")
    past = spark.createDataFrame([(90, 7, 10, "a"), (91, 7, 10, "b"), (92, 7, 12, "c")], "game_id long, k long, t long, v string")
    strict = {r["game_id"]: r["v"] for r in joins.asof_join(probes, past, ["k"], ["v"], at="t").collect()}
    assert strict == {1: None, 2: "b", 3: None}
    inclusive = {r["game_id"]: r["v"] for r in joins.asof_join(probes, past, ["k"], ["v"], at="t", inclusive=True).collect()}
    assert inclusive == {1: "b", 2: "b", 3: None}


def test_windows_equal_self_joins(spark):
    rows = spark.createDataFrame(cap_rows(), ROWS)
    windowed = pregame.player_stats_ext(rows).select("game_id", "profile_id", "act_games_7d")
    h = rows.select(F.col("profile_id").alias("p"), X.micros("started_at").alias("t"))
    c = rows.withColumn("now", X.micros("started_at"))
    joined = c.join(h, (c.profile_id == h.p) & (h.t < c.now) & (h.t >= c.now - 7 * X.MICROS_A_DAY), "left").groupBy("game_id", "profile_id").agg(F.count("t").alias("act_games_7d"))
    assert windowed.exceptAll(joined).count() == 0 and joined.exceptAll(windowed).count() == 0


def test_pairs_of_three_players_and_empty_tables(spark):
    df = spark.createDataFrame([(1, p, 1, "c", None, None, DAY0, 1, "m", 1, "p", False) for p in (3, 1, 2)], ROWS)
    assert {(r["profile_id_a"], r["profile_id_b"]) for r in joins.pair_up(df, ["civ"]).collect()} == {(1, 2), (1, 3), (2, 3)}
    empty = spark.createDataFrame([], ROWS)
    assert pregame.training_features(pregame.player_stats(empty)).count() == 0
    assert splits.temporal_split(empty).count() == 0


def test_time_gate_looks_at_the_last_kept_row(spark):
    df = spark.createDataFrame([(1, t, 0) for t in (0.0, 6.0, 12.0, 18.0, 30.0)], "k long, time_s double, command_index int")
    assert sorted(r["time_s"] for r in spatial.gate_by_last_kept(df, ["k"], 10.0).collect()) == [0.0, 12.0, 30.0]


def test_snapshot_swap_twice(spark):
    df = spark.createDataFrame([(1, 5, 3.0, 1.0, 4.0, 2.0, 0.75, 1)], "replay_id long, minute int, slot1_x double, slot2_x double, sum_x double, diff_x double, share_slot1_x double, target int")
    once = snapshots.swap_slots(df)
    assert (once.first()["slot1_x"], once.first()["diff_x"], once.first()["target"]) == (1.0, -2.0, 0)
    assert snapshots.swap_slots(once).collect() == df.collect()


def test_probabilities_sum_to_one_and_auc(spark):
    df = spark.createDataFrame([(g, s) for g in (1, 2) for s in (0.1, 0.7, 2.0)], "g long, s double")
    for how in ("renorm", "softmax", "temperature"):
        sums = [r["t"] for r in M.normalize(df, ["g"], "s", how, 1.5).groupBy("g").agg(F.sum("prob").alias("t")).collect()]
        assert sums == pytest.approx([1.0, 1.0])
    y = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert M.auc(y).first()["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_segment_choice():
    curve = [(float(g), 10 * 2.718281828 ** (-0.3 * g) + 1, 100.0) for g in range(20)]
    assert models.segment_choice(curve)["segment"] == "exponential"


def test_dump_reader_and_idempotent_append(spark, tmp_path):
    player = lambda p, r: {"profile_id": p, "result": r, "civilization": "c", "civilization_randomized": False, "rating": 1, "rating_diff": 1}
    games = [
        {"game_id": 1, "started_at": "2026-01-01T00:00:00Z", "kind": "rm_solo", "teams": [[player(1, "win")], [player(2, "loss")]]},
        {"game_id": 2, "started_at": "2026-01-01T00:00:00Z", "kind": "rm_2v2", "teams": [[player(1, "win"), player(3, "win")], [player(2, "loss"), player(4, None)]]},
        {"game_id": 3, "started_at": None, "kind": "rm_solo", "teams": [[player(1, "win")]]},
    ]
    (tmp_path / "dump_s11.json").write_text(json.dumps(games))
    dump = readers.read_dump(spark, str(tmp_path / "dump_s11.json"))
    g, p = readers.duels_of(dump)
    assert [(r["game_id"], r["season"], str(r["started_at"])) for r in g.collect()] == [(1, 11, "2026-01-01 00:00:00")]
    assert sorted((r["profile_id"], r["result"]) for r in p.collect()) == [(1, True), (2, False)]
    _, t = readers.teams_of(dump)
    assert sorted((r["team_id"], r["profile_id"]) for r in t.collect()) == [(0, 1), (0, 3), (1, 2), (1, 4)]
    out = str(tmp_path / "games")
    assert (sinks.append_new(g, out, ["game_id"]), sinks.append_new(g, out, ["game_id"]), sinks.row_count(spark, out)) == (1, 0, 1)
    assert sinks.row_count(spark, str(tmp_path / "none")) is None


def test_events_options_and_upsert(spark, tmp_path):
    (tmp_path / "77.jsonl").write_text('{"player_slot": 1, "intent_category": "Unit Action", "intent": {"action_kind": "move"}}\n')
    e = readers.read_events(spark, str(tmp_path / "77.jsonl")).first()
    assert (e["replay_id"], e["time_s"], e["command_index"]) == (77, 0.0, 0)
    packed = base64.b64encode(zlib.compress(b'{"a": 5}')).decode()
    df = spark.createDataFrame([(packed, '["x", 3]')], "o string, r string")
    got = df.select(readers.decode_options(F.col("o"), "a int").alias("o"), readers.positional(F.col("r"), {"name": (0, "string"), "n": (1, "int"), "z": (7, "int")}).alias("r")).first()
    assert (got["o"]["a"], got["r"]["name"], got["r"]["n"], got["r"]["z"]) == (5, "x", 3, None)
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {r["k"]: r["v"] for r in joins.upsert(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "c"}


def test_forbidden_columns(spark):
    with pytest.raises(ValueError, match="forbidden"):
        X.forbid_columns(spark.range(1), ["id"])


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from rankflow.streaming import streams

    (tmp_path / "in").mkdir()
    player = lambda p, r: {"profile_id": p, "result": r, "civilization": "c", "civilization_randomized": False}
    record = [{"game_id": 5, "started_at": "2026-01-01T00:00:00Z", "kind": "rm_1v1", "teams": [[player(1, "win")], [player(2, "loss")]]}]
    for name in ("a_s1.json", "b_s1.json"):
        (tmp_path / "in" / name).write_text(json.dumps(record))
    for _ in range(2):
        streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "g"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    assert (sinks.row_count(spark, str(tmp_path / "g")), sinks.row_count(spark, str(tmp_path / "p"))) == (1, 2)
