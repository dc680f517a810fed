"""Team modes: players' team and 1v1 histories, team aggregates, the match matrix, premade groups and the teammate network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.durable import checkpointed
from ..functions.exprs import NEW_PLAYER_GAMES, days_between, flag, skill, smooth
from .joins import asof_join

LOW_SKILL = 600
CARRY_SPREAD = 1.0
SMURF_GAP = 200
TEAMMATE_GAMES = 5
THRESHOLDS = [1, 2, 3, 4, 5, 6, 8, 10, 15, 20]
P = "profile_id"


def team_player_stats(games: DataFrame, participants: DataFrame) -> DataFrame:
    """Each player's team history before a match."""
    rows = participants.filter("result IS NOT NULL").withColumns({"result": F.col("result").cast("int"), "skill": skill()}).withColumnRenamed("civilization", "civ")
    rows = rows.join(games.filter("started_at IS NOT NULL").select("game_id", "started_at"), "game_id").repartition(P)
    return rows.withColumns(
        {
            "games_lifetime_before": W.count_before(P), "wins_lifetime_before": W.sum_over("result", W.prior(P)),
            "wins_last10_before": W.sum_over("result", W.last(10, P)), "n_last10_before": F.count("*").over(W.last(10, P)),
            "days_since_last_game": days_between(F.lag("started_at").over(W.ordered(P)), "started_at"),
            "civ_games_before": W.count_before(P, "civ"), "civ_wins_before": W.sum_over("result", W.prior(P, "civ")),
        }
    )


def onev1_history(games: DataFrame, participants: DataFrame, relevant: DataFrame) -> DataFrame:
    """1v1 history with each row included, of relevant players only."""
    from .pregame import player_games

    rows = player_games(games, participants).join(relevant.select(P).distinct(), P, "left_semi").repartition(P)
    w, recent = W.ordered(P).rowsBetween(W.START, 0), W.ordered(P).rowsBetween(-19, 0)
    return rows.select(
        P, "started_at", "game_id", F.col("mmr").alias("onev1_mmr"), F.col("rating").alias("onev1_rating"), W.sequence(P).alias("onev1_games"), W.sum_over("result", w).alias("onev1_wins"),
        W.sum_over("result", recent).alias("onev1_recent_wins"), F.count("*").over(recent).alias("onev1_recent_n"),
    )


ONEV1 = ["onev1_mmr", "onev1_rating", "onev1_games", "onev1_wins", "onev1_recent_wins", "onev1_recent_n"]


def onev1_snapshot(probes: DataFrame, history: DataFrame | None) -> DataFrame:
    """Each team player's 1v1 state strictly before the match; all null where there is no 1v1 data."""
    if history is None:
        return probes.withColumns({x: F.lit(None).cast("long") for x in ONEV1})
    return asof_join(probes, history, [P], ONEV1)


def team_aggregates(stats: DataFrame) -> DataFrame:
    """One row for each team: skill spread, carrying, histories and the 1v1 cross-reference."""
    w = Window.partitionBy("game_id", "team_id")
    rows = stats.withColumns({"_mean": F.avg("skill").over(w), "_std": F.stddev_pop("skill").over(w)})
    count = lambda condition: F.sum(flag(condition))
    part = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    top, over = F.max("skill"), F.col("onev1_mmr") - F.col("skill")
    rest = (F.sum("skill") - top) / F.nullif(F.count("*") - 1, F.lit(0))
    wr = lambda wins, games: F.avg(F.when(F.col(games).isNotNull(), smooth(wins, games)))
    return rows.groupBy("game_id", "team_id").agg(
        F.max("result").alias("team_result"), F.min(P).alias("team_min_profile_id"), F.count("*").alias("team_n"),
        F.avg("mmr").alias("mmr_mean"), F.max("mmr").alias("mmr_max"), F.min("mmr").alias("mmr_min"), F.coalesce(F.stddev_pop("mmr"), F.lit(0.0)).alias("mmr_std"), part(F.col("mmr").isNull()).alias("missing_mmr_frac"),
        F.avg("skill").alias("skill_mean"), top.alias("skill_max"), F.min("skill").alias("skill_min"), F.coalesce(F.stddev_pop("skill"), F.lit(0.0)).alias("skill_std"),
        (top - F.min("skill")).alias("carry_spread"), (top - rest).alias("carry_gap"), (top / F.nullif(F.avg("skill"), F.lit(0.0))).alias("carry_ratio"),
        count(F.col("skill") < LOW_SKILL).alias("n_below_floor"), count(F.col("skill") < F.col("_mean") - CARRY_SPREAD * F.col("_std")).alias("n_carried"),
        F.avg("games_lifetime_before").alias("games_lifetime_mean"), wr("wins_lifetime_before", "games_lifetime_before").alias("overall_wr_mean"), wr("wins_last10_before", "n_last10_before").alias("recent_wr_mean"),
        F.avg("days_since_last_game").alias("days_since_mean"), count(F.col("games_lifetime_before") < NEW_PLAYER_GAMES).alias("n_new_players"), wr("civ_wins_before", "civ_games_before").alias("civ_wr_mean"),
        count(F.col("civilization_randomized")).alias("n_random_civ"), F.avg("onev1_mmr").alias("onev1_mmr_mean"), F.max("onev1_mmr").alias("onev1_mmr_max"), wr("onev1_wins", "onev1_games").alias("onev1_wr_mean"),
        wr("onev1_recent_wins", "onev1_recent_n").alias("onev1_recent_wr_mean"), part(F.col("onev1_mmr").isNotNull()).alias("onev1_coverage"), F.max(over).alias("onev1_max_minus_skill"), count(over > SMURF_GAP).alias("n_smurf_like"),
    )


KEYS = ("game_id", "team_id", "team_result", "team_min_profile_id", "team_n")
PREMADE = ["max_prior_coteam", "mean_prior_coteam", "n_premade_pairs", "n_premade_players", "team_is_premade", "premade_partners_mean"]
NO_DIFF = {"mmr_std", "missing_mmr_frac", "skill_std", "n_random_civ", "onev1_coverage", "team_is_premade"}


def match_matrix(teams: DataFrame, premade: DataFrame | None = None) -> DataFrame:
    """One row for each match of two teams, the one with the lower least player id first; differences of directional columns."""
    columns = [x for x in teams.columns if x not in KEYS]
    if premade is not None:
        teams = teams.join(premade, ["game_id", "team_id"], "left").na.fill(0, PREMADE)
        columns += PREMADE
    sides = teams.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("team_min_profile_id", "team_result", *columns))).alias("t")).filter(F.size("t") >= 2)
    a, b = F.col("t")[0], F.col("t")[1]
    out = [a["team_result"].alias("target"), *[side[x].alias(f"{x}_{s}") for x in columns for s, side in (("a", a), ("b", b))], *[(a[x] - b[x]).alias(f"{x}_diff") for x in columns if x not in NO_DIFF]]
    if premade is not None:
        x, y = a["team_is_premade"] > 0, b["team_is_premade"] > 0
        out += [flag(x & y).alias("both_premade"), flag(x != y).alias("premade_xor")]
    return sides.select("game_id", *out).filter("target IS NOT NULL")


def teammates(participants: DataFrame, games: DataFrame, opponents: bool = False) -> DataFrame:
    """(game_id, team_id, p1, p2, wk): pairs of one team, or with ``opponents`` of different teams, from one grouping by match."""
    who = participants.groupBy("game_id").agg(F.collect_list(F.struct(P, "team_id")).alias("m"))
    at = games.filter("started_at IS NOT NULL").select("game_id", F.to_date(F.date_trunc("week", "started_at")).alias("wk"))
    first = who.join(at, "game_id").select("game_id", "wk", "m", F.explode("m").alias("x"))
    pair = F.filter("m", lambda y: (y[P] > F.col("x")[P]) & ((y["team_id"] != F.col("x.team_id")) if opponents else (y["team_id"] == F.col("x.team_id"))))
    return first.select("game_id", F.col("x.team_id").alias("team_id"), F.col("x")[P].alias("p1"), F.explode(pair).alias("y"), "wk").select("game_id", "team_id", "p1", F.col("y")[P].alias("p2"), "wk")


def coteam_weeks(pairs: DataFrame) -> DataFrame:
    """(p1, p2, wk): games together that week, before it and with it."""
    weekly = pairs.groupBy("p1", "p2", "wk").agg(F.count("*").alias("g"))
    w = Window.partitionBy("p1", "p2").orderBy("wk")
    return weekly.withColumns({"cum_before_week": F.coalesce(F.sum("g").over(w.rowsBetween(W.START, -1)), F.lit(0)), "cum_incl": F.sum("g").over(w.rowsBetween(W.START, 0))})


def established(weeks: DataFrame, least: int = TEAMMATE_GAMES) -> DataFrame:
    """(p1, p2): the week in which the pair had played together ``least`` times."""
    return weeks.filter(F.col("cum_incl") >= least).groupBy("p1", "p2").agg(F.min("wk").alias("establish_week"))


def premade_features(participants: DataFrame, games: DataFrame, least: int = TEAMMATE_GAMES) -> DataFrame:
    """One row for each team: how well its players knew one another before the week of the match."""
    pairs = teammates(participants, games)
    weeks = coteam_weeks(pairs)
    since = established(weeks, least)
    known = pairs.join(weeks, ["p1", "p2", "wk"], "left").join(since, ["p1", "p2"], "left").withColumn("old", F.coalesce(F.col("establish_week") < F.col("wk"), F.lit(False)))
    of_pairs = known.groupBy("game_id", "team_id").agg(F.coalesce(F.max("cum_before_week"), F.lit(0)).alias("max_prior_coteam"), F.coalesce(F.avg("cum_before_week"), F.lit(0.0)).alias("mean_prior_coteam"), F.sum(flag(F.col("old"))).alias("n_premade_pairs"))
    ends = known.filter("old").select("game_id", "team_id", F.explode(F.array("p1", "p2")).alias("pid")).distinct()
    of_players = ends.groupBy("game_id", "team_id").agg(F.count("*").alias("n_premade_players"))
    gained = since.select(F.explode(F.array("p1", "p2")).alias(P), F.col("establish_week").alias("wk")).groupBy(P, "wk").agg(F.count("*").alias("new"))
    partners = gained.withColumn("partners", F.sum("new").over(Window.partitionBy(P).orderBy("wk").rowsBetween(W.START, 0)))
    probes = participants.select("game_id", "team_id", P).join(games.filter("started_at IS NOT NULL").select("game_id", F.to_date(F.date_trunc("week", "started_at")).alias("wk")), "game_id")
    node = asof_join(probes, partners, [P], ["partners"], at="wk", tie=P).groupBy("game_id", "team_id").agg(F.avg(F.coalesce("partners", F.lit(0))).alias("premade_partners_mean"))
    out = of_pairs.join(of_players, ["game_id", "team_id"], "left").join(node, ["game_id", "team_id"], "left")
    return out.select("game_id", "team_id", "max_prior_coteam", "mean_prior_coteam", "n_premade_pairs", F.coalesce("n_premade_players", F.lit(0)).alias("n_premade_players"), flag(F.col("n_premade_pairs") > 0).alias("team_is_premade"), F.coalesce("premade_partners_mean", F.lit(0.0)).alias("premade_partners_mean"))


def teammate_edges(participants: DataFrame, games: DataFrame) -> DataFrame:
    """(p1, p2): games together, and games against one another."""
    count = lambda opponents, name: teammates(participants, games, opponents).groupBy("p1", "p2").agg(F.count("*").alias(name))
    return count(False, "games_together").join(count(True, "opponent_games"), ["p1", "p2"], "left").na.fill(0, ["opponent_games"])


def threshold_sweep(edges: DataFrame, opponents: DataFrame, xs: list[int] = THRESHOLDS) -> DataFrame:
    """For each x, pairs with at least x games together and against, and their ratio: one pass over each table."""
    many = lambda df, value, name: df.agg(*[F.count(F.when(F.col(value) >= x, 1)).alias(str(x)) for x in xs]).select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(str(x)).alias(name)) for x in xs])).alias("r")).select("r.*")
    both = many(edges, "games_together", "same_team_pairs").join(many(opponents, "g", "random_opp_pairs"), "x")
    return both.withColumn("enrichment_ratio", F.col("same_team_pairs") / F.greatest(F.col("random_opp_pairs"), F.lit(1)))


def node_stats(edges: DataFrame, least: int = TEAMMATE_GAMES) -> DataFrame:
    """Degree, weighted degree, clustering and component of each player of the thresholded graph."""
    e = edges.filter(F.col("games_together") >= least).select("p1", "p2", F.col("games_together").alias("w"))
    both = e.unionByName(e.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "w"))
    degree = both.groupBy("p1").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
    # Each triangle once: edges point from the end of lower degree, so that hubs start few paths.
    ranked = both.join(degree.select("p1", F.col("degree").alias("d1")), "p1").join(degree.select(F.col("p1").alias("p2"), F.col("degree").alias("d2")), "p2")
    out = ranked.filter("d1 < d2 OR (d1 = d2 AND p1 < p2)").select("p1", "p2")
    wedge = out.join(out.select("p1", F.col("p2").alias("p3")), "p1").filter("p2 < p3")
    triangle = wedge.join(both.select(F.col("p1").alias("p2"), F.col("p2").alias("p3")), ["p2", "p3"])
    closed = triangle.select(F.explode(F.array("p1", "p2", "p3")).alias("p1")).groupBy("p1").agg(F.count("*").alias("t"))
    label = components(both.select("p1", "p2"))
    size = label.groupBy("component").agg(F.count("*").alias("component_size"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    nodes = degree.join(closed, "p1", "left").join(label, "p1").join(size, "component")
    return nodes.select(F.col("p1").alias(P), "degree", "weighted_degree", F.when(pairs > 0, 2 * F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"), F.col("component").alias("component_id"), "component_size")


def components(both: DataFrame) -> DataFrame:
    """(p1, component): the least id reached, by label propagation with label hopping until nothing changes; rounds are checkpointed."""
    both = checkpointed(both)
    label = checkpointed(both.groupBy("p1").agg(F.least(F.col("p1"), F.min("p2")).alias("component")))
    while True:
        near = both.join(label.select(F.col("p1").alias("p2"), "component"), "p2").groupBy("p1").agg(F.min("component").alias("near"))
        low = label.join(near, "p1").select("p1", F.least("component", "near").alias("low"), "component")
        hop = label.select(F.col("p1").alias("low"), F.col("component").alias("hop"))
        fresh = checkpointed(low.join(hop, "low", "left").select("p1", F.least("low", F.coalesce("hop", "low")).alias("fresh"), "component"))
        label = fresh.select("p1", F.col("fresh").alias("component"))
        if fresh.filter("fresh <> component").isEmpty():
            return label
