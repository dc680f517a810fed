"""States and features as of a request, batches of probabilities, baselines: against the training path and by hand."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rankflow.operators import civ_choice, history, joins, pregame, splits
from rankflow.plans import models, requests

DAY0 = dt.datetime(2026, 1, 1)
ROWS = "game_id long, profile_id long, result int, civ string, mmr int, rating int, started_at timestamp_ntz, duration int, map string, season int, patch string, civilization_randomized boolean"


def league(games=160, players=9, seed=3):
    """Duels at distinct times; two games share a day now and then."""
    rng = random.Random(seed)
    rows, at = [], DAY0
    for g in range(1, games + 1):
        at += dt.timedelta(hours=rng.choice([1, 5, 30]))
        won = rng.random() < 0.5
        length = rng.choice([500, 900, 1200, 1800, 1801, 2500, None])
        pair = rng.sample(range(1, players + 1), 2)
        where = (length, rng.choice("xyz"), 10 + g // 60, f"p{g // 40}", False)
        for k, p in enumerate(pair):
            skill = rng.choice([None, 900 + 10 * p]), rng.choice([None, 1000 + p])
            rows.append((g, p, int(won if k == 0 else not won), rng.choice("abc"), *skill, at, *where))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(league(), ROWS).repartition(3).cache()


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))


def test_extended_states_equal_training_columns(spark, rows):
    asked = rows.select(F.col("game_id").alias("request_id"), "profile_id", "civ", F.col("started_at").alias("at"))
    got = {(r["request_id"], r["profile_id"]): r for r in requests.extended_states_as_of(rows, asked).collect()}
    want = pregame.player_stats_ext(rows).collect()
    assert len(got) == len(want)
    for r in want:
        own = got[r["game_id"], r["profile_id"]]
        for x in requests.EXTENDED:
            if x == "days_since_civ":  # full days here, midnights there
                assert (own[x] is None) == (r[x] is None) and (r[x] is None or 0 <= r[x] - own[x] <= 1)
            else:
                assert close(own[x], r[x]), (x, own[x], r[x])


def test_extended_states_of_strangers_and_later_times(spark, rows):
    asked = spark.createDataFrame([(1, 1, "a", DAY0 + dt.timedelta(days=4000)), (2, 777, "a", DAY0), (3, 1, None, DAY0 + dt.timedelta(days=4000)), (4, 1, "a", DAY0 + dt.timedelta(days=4000))], "request_id long, profile_id long, civ string, at timestamp_ntz")
    got = {r["request_id"]: r.asDict() for r in requests.extended_states_as_of(rows, asked).collect()}
    own = [r for r in league() if r[1] == 1]
    assert got[1]["act_games_60d"] == 0 and got[1]["recent_n_20"] == 20 and got[1]["short_games"] == sum(r[7] is not None and r[7] <= 900 for r in own)
    last = sorted(own, key=lambda r: (r[6], r[0]))[::-1]
    assert got[1]["mmr_lag3"] == last[2][4] and got[1]["recent_w_10"] == sum(r[2] for r in last[:10])
    assert got[1]["days_since_civ"] == (DAY0 + dt.timedelta(days=4000) - max(r[6] for r in own if r[3] == "a")).days
    assert got[2]["recent_n_5"] == 0 and got[2]["avg_dur_life"] is None and got[2]["mmr_std_20"] is None and got[2]["days_since_civ"] is None
    assert got[3]["days_since_civ"] is None and got[3]["civ_avg_dur"] is None and got[3]["civ_games_60d"] == 0 and got[3]["short_games"] == got[1]["short_games"]
    assert {k: v for k, v in got[4].items() if k != "request_id"} == {k: v for k, v in got[1].items() if k != "request_id"}
    empty = requests.extended_states_as_of(rows.limit(0), asked).collect()
    assert len(empty) == 4 and all(r["recent_n_20"] == 0 for r in empty)


def test_extended_request_features_derive_all_families(spark, rows):
    training = pregame.base_derived(pregame.training_features(pregame.player_stats(rows)))
    asked = training.withColumn("request_id", F.col("game_id")).withColumn("at", F.col("started_at"))
    got = {r["request_id"]: r for r in requests.extended_request_features(rows, asked).collect()}
    ext, h2h = pregame.player_stats_ext(rows), pregame.h2h_priors(rows)
    want = pregame.extend_features(training, [*pregame.FAMILIES, "head_to_head", "low_history"], ext, h2h)
    names = [x for x in want.columns if x not in training.columns and "days_since_civ" not in x]
    assert len(names) > 100 and got[1].asDict().keys() >= set(names)
    for r in want.collect():
        assert all(close(got[r["game_id"]][x], r[x]) for x in names), [x for x in names if not close(got[r["game_id"]][x], r[x])]


def listed(rows, most=40):
    lists = requests.recent_lists(rows, most)
    both = joins.pair_up(lists, ["civ", "games"], shared=["started_at", "map", "season", "patch"])
    return both.withColumnsRenamed({"game_id": "request_id", "started_at": "at"}).withColumns({"prior_matchup_games": F.lit(4).cast("long"), "prior_matchup_wins": F.lit(3).cast("long")})


def test_recent_lists_give_the_capped_training_features(spark):
    rows = spark.createDataFrame(league(400, 7, 5), ROWS).repartition(3).cache()
    got = {r["request_id"]: r for r in requests.recent_features(listed(rows)).collect()}
    training = pregame.training_features(pregame.player_stats(rows))
    ext, h2h = pregame.player_stats_ext(rows), pregame.h2h_priors(rows)
    wide = pregame.extend_features(training, ["civ_recency", "adjusted_form", "duration_profile", "head_to_head"], ext, h2h)
    capped = {r["game_id"]: r.asDict() | b.asDict() for r, b in zip(history.capped_overrides(training, rows, 30).orderBy("game_id").collect(), history.capped_base_overrides(training, rows, 30).orderBy("game_id").collect(), strict=True)}
    form = {r["game_id"]: r for r in wide.select("game_id", *[f"recent_{x}_{n}_{s}" for x in ("n", "w", "wr") for n in (5, 10, 20) for s in ("a", "b")]).collect()}
    assert len(got) == 400 and any(r["h2h_games"] > 2 for r in got.values()) and max(r["games_lifetime_a"] for r in got.values()) == 30
    for game, own in got.items():
        for name, value in {**capped[game], **form[game].asDict()}.items():
            if name not in ("game_id",):
                assert close(own[name], value), (game, name, own[name], value)
        assert close(own["overall_wr_a"], (own["wins_lifetime_a"] + 5) / (own["games_lifetime_a"] + 10)) and close(own["prior_matchup_wr_a"], 8 / 14)
        assert close(own["short_share_a"], own["short_games_a"] / max(own["games_lifetime_a"], 1)) and close(own["mmr_diff"], (own["mmr_a"] or 0) - (own["mmr_b"] or 0))


def exchanged(plan, nodes=("Exchange", "Sort")):
    """Schemas of what a plan sends or sorts."""
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = [plan.schema().json()] if plan.nodeName() in nodes else []
    children = plan.children()
    return found + [x for i in range(children.size()) for x in exchanged(children.apply(i), nodes)]


def test_recent_match_features_equal_those_of_lists(spark):
    more = [(g, p, r, "a", 1000, 1000, DAY0 + dt.timedelta(days=300 + g - 1000), 600, "x", 19, "p9", False) for g in range(1000, 1006) for p, r in ((1, 1), (2, 0), (3, 0))]  # of three players
    ties = [(g, p, r, "b", None, 1000, DAY0 + dt.timedelta(days=320), 2000, "y", None, "p9", False) for g in range(2000, 2004) for p, r in ((1, 0), (4, 1))]  # of one time
    rows = spark.createDataFrame(league(300, 7, 5) + more + ties, ROWS).repartition(3).cache()
    got = requests.recent_match_features(rows, 40)
    lists = listed(rows).drop("season", "patch").withColumns({f"prior_matchup_{x}": F.lit(None).cast("long") for x in ("games", "wins")})
    want = requests.recent_features(lists)
    key = lambda r: (r["request_id"], r["profile_id_a"], r["profile_id_b"])
    assert set(got.columns) == set(want.columns)
    found, names = {key(r): r for r in got.collect()}, want.columns
    for r in want.collect():
        assert all(close(found[key(r)][x], r[x]) if not isinstance(r[x], (str, dt.datetime)) else found[key(r)][x] == r[x] for x in names), [x for x in names if found[key(r)][x] != r[x]]
    assert len(found) == 300 + 18 + 4 and max(r["h2h_games"] for r in found.values()) > 2
    # Neither the query nor the lists themselves sort or send lists of games.
    for df in (requests.recent_match_features(rows, 40, sides=["mmr", "rating"]), requests.recent_lists(rows, 40)):
        sent = exchanged(df._jdf.queryExecution().executedPlan())
        assert sent and not any(re.search(r'"elementType":\{"type":"struct".*"duration"', x) for x in sent)


def test_recent_features_of_empty_and_short_lists(spark):
    game = lambda g, at, **more: {"game_id": g, "started_at": at, "duration": 600, "map": "x", "season": 3, "patch": "p9", "civ": "a", "result": 1, "rating": None, "mmr": None, "opponent_profile_id": 2} | more
    now = DAY0 + dt.timedelta(days=100)
    lists = [game(5, now - dt.timedelta(days=30), result=None), game(4, now - dt.timedelta(days=31), mmr=1200, duration=None)]
    df = spark.createDataFrame(
        [(1, 1, 2, "a", None, "x", now, lists, None, None, None), (2, 1, 2, None, None, None, now, None, [], 7, 3)],
        f"request_id long, profile_id_a long, profile_id_b long, civ_a string, civ_b string, map string, at timestamp_ntz, games_a {requests.GAME}, games_b {requests.GAME}, prior_matchup_games long, prior_matchup_wins long",
    )
    got = {r["request_id"]: r for r in requests.recent_features(df).collect()}
    one, none = got[1], got[2]
    assert (one["season"], one["patch"], one["games_season_a"], one["wins_season_a"]) == (3, "p9", 2, 1)
    assert (one["civ_games_30d_a"], one["civ_games_60d_a"], one["days_since_civ_a"], one["days_since_a"]) == (1, 2, 30, 30)
    assert (one["mmr_a"], one["missing_mmr_b"], one["skill_a"], one["skill_b"], one["avg_dur_20_a"], one["h2h_games"]) == (1200, 1, 1200.0, 950.0, 600.0, 0)
    assert (none["games_lifetime_a"], none["days_since_a"], none["skill_a"], none["impute_method"], none["overall_wr_a"]) == (0, None, 1000.0, "global_baseline", 0.5)
    with pytest.raises(ValueError, match="cap"):
        requests.recent_features(df, 10)


def test_batch_probabilities(spark, rows):
    matches = spark.createDataFrame(
        [(1, 1, 2, DAY0, True), (2, 2, 1, DAY0 + dt.timedelta(days=4000), True), (3, 1, 2, DAY0 + dt.timedelta(days=4000), None), (4, 1, 2, DAY0, False), (5, 1, None, DAY0, True), (6, 3, 3, DAY0, True)],
        "match_id long, slot1 long, slot2 long, started_at timestamp_ntz, usable boolean",
    )
    got = {r["match_id"]: r["p_win"] for r in requests.pregame_probabilities(matches, rows, requests.EloModel()).collect()}
    assert set(got) == {1, 2, 3} and got[1] == 0.5 and got[2] + got[3] == pytest.approx(1)
    both = joins.pair_up(rows, ["mmr", "result"]).withColumn("target", F.col("result_a"))
    fitted = models.fit_logistic(both, ["mmr_a", "mmr_b"])
    p = requests.pregame_probabilities(matches, rows, fitted, "probability").collect()
    assert len(p) == 3 and all(0 <= r["probability"][1] <= 1 for r in p)


def test_anonymous_baselines_fall_back(spark):
    train = spark.createDataFrame([("a", "low", "x", "p1"), ("a", "low", "x", "p1"), ("b", "low", "x", "p2"), ("b", "mid", "y", "p1")], "civ string, mmr_bucket string, map string, patch string")
    test = spark.createDataFrame([(1, "a", "low", "x", "p1", 0.0), (2, "b", "low", "x", "p9", 0.4), (3, "a", "high", "z", "p1", None), (4, "c", "low", "x", "p1", 0.0)], "i int, candidate_civ string, mmr_bucket string, map string, patch string, met double")
    got = {r["i"]: (r["p_global"], r["p_mmr_tier"], r["p_map_patch"], r["p_recent_meta"]) for r in civ_choice.anonymous_baselines(train, test, "met").collect()}
    want = {1: (0.5, 2 / 3, 1.0, 2 / 3), 2: (0.5, 1 / 3, 1 / 3, 0.4), 3: (0.5, 0.5, 0.5, 0.5), 4: (1e-6, 1e-6, 1e-6, 1e-6)}
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_recent_games_with_many_at_one_time(spark):
    rows = [(g, 1, DAY0, "a" if g < 40 else "b", "m", 1) for g in range(1, 61)] + [(100, 1, DAY0 + dt.timedelta(hours=1), "c", "m", 1), (101, 1, DAY0 + dt.timedelta(hours=1), "d", "m", 0)]
    df = spark.createDataFrame(rows, "game_id long, profile_id long, started_at timestamp_ntz, civ string, map string, result int")
    got = {r["game_id"]: [x["game_id"] for x in r["recent"]] for r in civ_choice.with_recent(df).collect()}
    assert got[1] == got[60] == [] and got[100] == got[101] == list(range(60, 40, -1))


def test_counts_as_of_equal_brute_force(spark):
    rng = random.Random(1)
    at = lambda: DAY0 + dt.timedelta(hours=rng.randrange(0, 200))
    events, probes = [(rng.choice("xy"), at(), rng.randrange(1, 4)) for _ in range(150)], [(rng.choice("xyz"), at()) for _ in range(60)]
    got = civ_choice.counts_as_of(spark.createDataFrame(events, "k string, started_at timestamp_ntz, n long"), spark.createDataFrame(probes, "k string, started_at timestamp_ntz").distinct(), ["k"], "c").collect()
    assert {(r["k"], r["started_at"]): r["c"] for r in got} == {(k, t): sum(n for e, u, n in events if e == k and u < t) for k, t in probes}


def test_candidate_rows_stay_with_their_player(spark, rows):
    raw = rows.filter("civ IS NOT NULL").withColumns({"prev_civ": F.lit("a"), "prev_civ_streak_len": F.lit(1)})
    late = DAY0 + dt.timedelta(days=30)  # of an option picked before it counts as known
    seen_at = spark.createDataFrame([("a", DAY0), ("b", late), ("c", DAY0), ("d", DAY0)], "civ string, first_seen_at timestamp_ntz")
    families = ("own", "recent")
    got = civ_choice.training_matrix(raw, seen_at, families=families)
    want = civ_choice.training_matrix(raw, seen_at, sample=F.lit(True), families=families)  # by a join with the histories
    assert got.columns == want.columns and got.filter("candidate_civ = 'b'").agg(F.min("started_at")).first()[0] >= late
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert not any('"candidate_civ"' in x and '"game_id"' in x for x in exchanged(got._jdf.queryExecution().executedPlan(), ("Exchange",)))


def test_group_split_in_place_equals_the_join(spark, rows):
    df = rows.select("game_id", "profile_id", "started_at")
    split = lambda f, **more: sorted(map(tuple, f(df, ["game_id"], **more).select("game_id", "profile_id", "split").collect()))
    for more in ({}, {"valid": 0.0}, {"valid": 0.0, "test": 0.0}, {"test": 0.5}):
        assert split(splits.group_split_in_place, **more) == split(splits.group_split, **more)


def test_counted_trees_equal_trees_of_all_rows(spark):
    rng = random.Random(4)
    made = [(float(x := rng.randrange(6)), None if rng.random() < 0.05 else float(rng.randrange(20)), int(rng.random() < (x + 1) / 8), i % 5 == 0) for i in range(3000)]
    df = spark.createDataFrame(made, "x double, y double, target int, valid boolean")
    for valid in (None, "valid"):
        one, two = (f(df, ["x", "y"], valid=valid, trees=4, depth=3).transform(df) for f in (models.fit_counted_trees, models.fit_trees))
        p = [[r["probability"][1] for r in m.orderBy("x", "y", "target", "valid").collect()] for m in (one, two)]
        assert p[0] == pytest.approx(p[1], abs=1e-9)
    many = spark.range(20000).select((F.col("id") / 7).alias("x"), F.lit(1.0).alias("y"))
    edges = models.bin_edges(many, ["x", "y"])
    assert len(edges[0]) == models.BINS + 1 and edges[1] == [-math.inf, math.inf] and abs(edges[0][16] - 10000 / 7) < 10
