"""Pregame features: each player's history before a match, matchup priors, pairs and derived features.

History windows of one player share one shuffle: rows are dealt by player once,
and windows by player and civilisation or map only sort again within.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.exprs import (
    H2H_ENOUGH, H2H_STRENGTH, LONG_GAME, NEW_PLAYER_GAMES, ONE_V_ONE_KINDS, SHORT_GAME, days_between, flag, ratio, skill, smooth, zero,
)
from .joins import as_dimension, join_roles, pair_up

P = ("profile_id",)


def player_games(games: DataFrame, participants: DataFrame, kinds: list[str] = ONE_V_ONE_KINDS) -> DataFrame:
    """Players' decided matches of the given kinds, with the match's columns."""
    of_kind = games.filter(F.col("kind").isin(kinds) & F.col("started_at").isNotNull())
    decided = participants.filter("result IS NOT NULL").withColumn("result", F.col("result").cast("int"))
    return decided.withColumnRenamed("civilization", "civ").join(of_kind, "game_id")


def player_stats(rows: DataFrame) -> DataFrame:
    """Games and wins before each match: lifetime, season (earlier days), civilisation, map."""
    dealt = rows.repartition("profile_id")
    out = {
        "games_lifetime_before": W.count_before(*P),
        "wins_lifetime_before": W.sum_over("result", W.prior(*P)),
        "games_season_before": F.count("*").over(W.earlier_days("profile_id", "season")),
        "wins_season_before": W.sum_over("result", W.earlier_days("profile_id", "season")),
        "days_since_last_game": days_between(F.lag("started_at").over(W.ordered(*P)), "started_at"),
    }
    for name in ("civ", "map"):
        out[f"{name}_games_before"] = W.count_before("profile_id", name)
        out[f"{name}_wins_before"] = W.sum_over("result", W.prior("profile_id", name))
    return dealt.withColumns(out)


def player_stats_ext(rows: DataFrame) -> DataFrame:
    """Recency by civilisation, activity, mmr trend, recent form and durations before each match."""
    dealt = rows.repartition("profile_id")
    out: dict[str, Column] = {}
    for n in (7, 30, 60):
        out[f"civ_games_{n}d"] = F.count("*").over(W.within_days(n, "profile_id", "civ"))
        out[f"civ_wins_{n}d"] = W.sum_over("result", W.within_days(n, "profile_id", "civ"))
    out["days_since_civ"] = days_between(F.lag("started_at").over(W.ordered("profile_id", "civ")), "started_at")
    for n in (7, 14, 30, 60):
        out[f"act_games_{n}d"] = F.count("*").over(W.within_days(n, *P))
    for n in (3, 5, 10, 20):
        out[f"mmr_lag{n}"] = F.lag("mmr", n).over(W.ordered(*P))
    for n in (10, 20):
        out[f"mmr_std_{n}"] = F.stddev_samp("mmr").over(W.last(n, *P))
    for n in (5, 10, 20):
        out[f"recent_n_{n}"] = F.count("*").over(W.last(n, *P))
        out[f"recent_w_{n}"] = W.sum_over("result", W.last(n, *P))
    out["avg_dur_life"] = F.avg("duration").over(W.prior(*P))
    out["avg_dur_20"] = F.avg("duration").over(W.last(20, *P))
    for name, inside in (("short", F.col("duration") <= SHORT_GAME), ("long", F.col("duration") > LONG_GAME)):
        out[f"{name}_games"] = W.sum_over(F.when(inside, 1).otherwise(0), W.prior(*P))
        out[f"{name}_wins"] = W.sum_over(F.when(inside, F.col("result")).otherwise(0), W.prior(*P))
    out["civ_avg_dur"] = F.avg("duration").over(W.prior("profile_id", "civ"))
    return dealt.withColumns(out)


def pairs(stats: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Matches as pairs, the lower profile_id first."""
    return pair_up(stats, columns)


def before_in_order(df: DataFrame, keys: list[str], order: str, sums: Iterable[str]) -> DataFrame:
    """``prior_`` sums of all earlier groups in order; null in the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(W.START, -1)
    return df.withColumns({f"prior_{x}": F.sum(x).over(w).cast("long") for x in sums})


def matchup_priors(stats: DataFrame) -> DataFrame:
    """(civ_a, civ_b, season): games and wins of the pairing in earlier seasons."""
    both = pair_up(stats, ["civ", "result"], shared=["season"])
    by_season = both.groupBy("civ_a", "civ_b", "season").agg(F.count("*").alias("games"), F.sum("result_a").alias("wins"))
    return before_in_order(by_season, ["civ_a", "civ_b"], "season", ["games", "wins"]).select("civ_a", "civ_b", "season", "prior_games", "prior_wins")


BASE = {
    "civ": "civ", "civ_rand": "civilization_randomized", "mmr": "mmr", "rating": "rating", "games_lifetime": "games_lifetime_before", "wins_lifetime": "wins_lifetime_before",
    "games_season": "games_season_before", "wins_season": "wins_season_before", "days_since": "days_since_last_game", "civ_games": "civ_games_before", "civ_wins": "civ_wins_before",
    "map_games": "map_games_before", "map_wins": "map_wins_before",
}


def training_features(stats: DataFrame, seasons: list[int] | None = None) -> DataFrame:
    """One row for each match: both players' base features and the matchup prior; ``target`` is 1 if player a won."""
    named = stats.select("game_id", "profile_id", "started_at", "map", "patch", "season", "result", *[F.col(x).alias(name) for name, x in BASE.items()])
    chosen = named if seasons is None else named.filter(F.col("season").isin(seasons))
    both = pair_up(chosen, ["result", *BASE], shared=["started_at", "map", "patch", "season"])
    both = both.withColumnRenamed("result_a", "target").drop("result_b")
    priors = matchup_priors(stats).withColumnsRenamed({"prior_games": "prior_matchup_games", "prior_wins": "prior_matchup_wins"})
    return both.join(priors, ["civ_a", "civ_b", "season"], "left")


def _sides(df: DataFrame, make) -> DataFrame:
    out: dict[str, Column] = {}
    for s in ("a", "b"):
        out |= make(s)
    return df.withColumns(out)


def _diffs(df: DataFrame, names: Iterable[str], nulls_as_zero: bool = False) -> DataFrame:
    value = (lambda x: zero(x)) if nulls_as_zero else F.col
    return df.withColumns({f"{x}_diff": value(f"{x}_a") - value(f"{x}_b") for x in names})


def base_derived(df: DataFrame) -> DataFrame:
    """Smoothed rates, skill, missing flags, differences, new-player and context flags."""

    def side(s: str) -> dict[str, Column]:
        own = skill(f"mmr_{s}", f"rating_{s}")
        return {
            f"overall_wr_{s}": smooth(f"wins_lifetime_{s}", f"games_lifetime_{s}"),
            f"season_wr_{s}": smooth(f"wins_season_{s}", f"games_season_{s}"),
            f"civ_wr_{s}": smooth(f"civ_wins_{s}", f"civ_games_{s}"),
            f"map_wr_{s}": smooth(f"map_wins_{s}", f"map_games_{s}"),
            f"skill_{s}": own,
            f"missing_mmr_{s}": flag(F.col(f"mmr_{s}").isNull()),
            f"missing_rating_{s}": flag(F.col(f"rating_{s}").isNull()),
            f"missing_skill_{s}": flag(own.isNull()),
            f"is_new_player_{s}": flag(F.col(f"games_lifetime_{s}") < NEW_PLAYER_GAMES),
        }

    out = _diffs(_sides(df, side), ["mmr", "rating", "skill"])
    civs = F.col("civ_a").isNotNull() & F.col("civ_b").isNotNull()
    return out.withColumns(
        {
            "games_diff": F.col("games_lifetime_a") - F.col("games_lifetime_b"),
            "wr_diff": F.col("overall_wr_a") - F.col("overall_wr_b"),
            "prior_matchup_wr_a": smooth("prior_matchup_wins", "prior_matchup_games"),
            "civs_known": flag(civs),
            "map_known": flag(F.col("map").isNotNull()),
            "full_context_known": flag(civs & F.col("map").isNotNull()),
        }
    )


def p1_derived(df: DataFrame) -> DataFrame:
    """Civilisation recency: smoothed rates, the civilisation's part of recent games, differences."""

    def side(s: str) -> dict[str, Column]:
        out = {f"civ_wr_{n}d_{s}": smooth(f"civ_wins_{n}d_{s}", f"civ_games_{n}d_{s}") for n in (7, 30, 60)}
        return out | {f"civ_frac_{n}d_{s}": zero(f"civ_games_{n}d_{s}") / F.greatest(zero(f"act_games_{n}d_{s}"), F.lit(1)) for n in (30, 60)}

    return _diffs(_sides(df, side), ["civ_wr_30d", "civ_wr_60d", "civ_frac_30d", "civ_frac_60d"])


def p2_derived(df: DataFrame) -> DataFrame:
    """mmr trend: changes, slopes, a rising flag, differences."""

    def side(s: str) -> dict[str, Column]:
        change = {n: F.col(f"mmr_{s}") - F.col(f"mmr_lag{n}_{s}") for n in (3, 5, 10, 20)}
        out = {f"mmr_change_{n}_{s}": x for n, x in change.items()}
        return out | {f"mmr_slope_10_{s}": change[10] / 10, f"mmr_slope_20_{s}": change[20] / 20, f"mmr_rising_10_{s}": flag(zero(change[10]) > 0)}

    return _diffs(_sides(df, side), ["mmr_change_10", "mmr_change_20", "mmr_slope_10", "mmr_std_10", "mmr_std_20"])


def p3_derived(df: DataFrame) -> DataFrame:
    """Recent form: smoothed rates of the last 5, 10 and 20 games, differences."""
    out = _sides(df, lambda s: {f"recent_wr_{n}_{s}": smooth(f"recent_w_{n}_{s}", f"recent_n_{n}_{s}") for n in (5, 10, 20)})
    return _diffs(out, [f"recent_wr_{n}" for n in (5, 10, 20)])


def p4_derived(df: DataFrame) -> DataFrame:
    """Durations: smoothed rates and shares of short and long games, differences (nulls as 0)."""

    def side(s: str) -> dict[str, Column]:
        out = {f"{x}_wr_{s}": smooth(f"{x}_wins_{s}", f"{x}_games_{s}") for x in ("short", "long")}
        return out | {f"{x}_share_{s}": zero(f"{x}_games_{s}") / F.greatest(F.col(f"games_lifetime_{s}"), F.lit(1)) for x in ("short", "long")}

    return _diffs(_sides(df, side), ["avg_dur_life", "avg_dur_20", "short_wr", "long_wr", "short_share", "long_share", "civ_avg_dur"], nulls_as_zero=True)


def p5_derived(df: DataFrame) -> DataFrame:
    """Head to head: a smoothed rate, and whether there are enough meetings."""
    return df.withColumns({"h2h_wr_a": smooth("h2h_wins_a", "h2h_games", H2H_STRENGTH), "h2h_has_data": flag(zero("h2h_games") >= H2H_ENOUGH)})


def p6_derived(df: DataFrame) -> DataFrame:
    """Map types: smoothed rates, differences."""
    out = _sides(df, lambda s: {f"{x}_wr_{s}": smooth(f"{x}_wins_{s}", f"{x}_games_{s}") for x in ("map_type", "openness")})
    return _diffs(out, ["map_type_wr", "openness_wr"])


def p7_derived(df: DataFrame) -> DataFrame:
    """Map priors: nulls as 0, logarithm of the count."""
    return df.withColumn("prior_map_games", zero("prior_map_games")).withColumn("log_prior_map_games", F.log1p(F.col("prior_map_games").cast("double")))


def p8_derived(df: DataFrame) -> DataFrame:
    """Low-history and missing-skill flags."""
    a, b = zero("missing_mmr_a") == 1, zero("missing_mmr_b") == 1
    out = {"both_mmr_missing": flag(a & b), "a_mmr_missing_only": flag(a & ~b), "b_mmr_missing_only": flag(~a & b)}
    for s in ("a", "b"):
        out |= {f"{s}_low_lt{n}": flag(zero(f"games_lifetime_{s}") < n) for n in (5, 10, 20)}
        out[f"is_first10_season_{s}"] = flag(zero(f"games_season_{s}") < 10)
    low = [zero(f"games_lifetime_{s}") < 20 for s in ("a", "b")]
    return df.withColumns(out | {"one_low_one_est": flag(low[0] != low[1]), "both_low": flag(low[0] & low[1])})


def p9_derived(df: DataFrame) -> DataFrame:
    """Activity: inactivity flags, differences."""
    out = _sides(df, lambda s: {f"inactive_{n}d_{s}": flag(zero(f"act_games_{n}d_{s}") == 0) for n in (30, 7)})
    return _diffs(out, [f"act_games_{n}d" for n in (7, 14, 30)], nulls_as_zero=True)


def h2h_priors(rows: DataFrame) -> DataFrame:
    """(game_id, pid_lo, pid_hi): earlier meetings, and those the lower id won."""
    both = pair_up(rows, ["result"], shared=["started_at"]).withColumnsRenamed({"profile_id_a": "pid_lo", "profile_id_b": "pid_hi"})
    keys = ("pid_lo", "pid_hi")
    return both.select("game_id", *keys, W.count_before(*keys).alias("h2h_games_before"), W.sum_over("result_a", W.prior(*keys)).alias("h2h_wins_lo_before"))


def map_archetype_stats(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Games and wins before each match on maps of the same type, and of the same openness."""
    known = rows.join(as_dimension(maps.select("map_id", "map_type_primary", "openness", "chokepoint_level")), "map_id", "left").repartition("profile_id")
    out = {}
    for name, x in (("map_type", "map_type_primary"), ("openness", "openness")):
        out[f"{name}_games_before"] = W.count_before("profile_id", x)
        out[f"{name}_wins_before"] = W.sum_over("result", W.prior("profile_id", x))
    return known.withColumns(out)


def map_patch_priors(games: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(map_id, patch): games, mean duration and shares of short and long games in earlier patches, by patch date."""
    starts = games.groupBy("patch").agg(F.min("started_at").alias("first"))
    if patches is not None:
        starts = starts.join(as_dimension(patches.select("patch", F.col("patch_start_at").cast("timestamp_ntz").alias("given"))), "patch", "left")
        starts = starts.select("patch", F.coalesce("given", "first").alias("patch_start_at"))
    else:
        starts = starts.withColumnRenamed("first", "patch_start_at")
    by_patch = games.filter("kind = 'rm_1v1' AND map_id IS NOT NULL").groupBy("map_id", "patch").agg(
        F.count("*").alias("games"), F.sum("duration").alias("duration"), F.sum(flag(F.col("duration") <= SHORT_GAME)).alias("short"), F.sum(flag(F.col("duration") >= LONG_GAME)).alias("long")
    )
    out = before_in_order(by_patch.join(as_dimension(starts), "patch"), ["map_id"], "patch_start_at", ["games", "duration", "short", "long"])
    return out.select(
        "map_id", "patch", "patch_start_at", F.col("prior_games").alias("prior_map_games"), ratio("prior_duration", "prior_games").alias("prior_avg_duration"),
        ratio("prior_short", "prior_games").alias("prior_short_game_share"), ratio("prior_long", "prior_games").alias("prior_long_game_share"),
    )


def civ_extra(rows: DataFrame) -> DataFrame:
    """Civilisation familiarity: days since the civilisation was last played, its games in this patch."""
    by_patch = W.prior("profile_id", "civ", "patch")
    return rows.repartition("profile_id").withColumns(
        {"days_since_civ": days_between(F.lag("started_at").over(W.ordered("profile_id", "civ")), "started_at"), "civ_games_patch": W.sum_over(F.lit(1), by_patch)}
    )


#: Families of extended features: the columns each needs of ``player_stats_ext`` and what it derives.
FAMILIES = {
    "civ_recency": ([*[f"civ_{x}_{n}d" for n in (7, 30, 60) for x in ("games", "wins")], "days_since_civ", "act_games_30d", "act_games_60d"], p1_derived),
    "mmr_trend": ([*[f"mmr_lag{n}" for n in (3, 5, 10, 20)], "mmr_std_10", "mmr_std_20"], p2_derived),
    "adjusted_form": ([f"recent_{x}_{n}" for n in (5, 10, 20) for x in ("n", "w")], p3_derived),
    "duration_profile": (["avg_dur_life", "avg_dur_20", "short_games", "short_wins", "long_games", "long_wins", "civ_avg_dur"], p4_derived),
    "activity_session": ([f"act_games_{n}d" for n in (7, 14, 30, 60)], p9_derived),
}


def extend_features(training: DataFrame, families: Iterable[str], ext: DataFrame, h2h: DataFrame | None = None) -> DataFrame:
    """``training`` with the columns of the chosen families; others are never computed."""
    chosen = [x for x in FAMILIES if x in set(families)]
    columns = list(dict.fromkeys(c for x in chosen for c in FAMILIES[x][0]))
    wanted = training.select("game_id").distinct()
    out = join_roles(training, ext.join(wanted, "game_id", "left_semi"), columns) if columns else training
    for x in chosen:
        out = FAMILIES[x][1](out)
    if "head_to_head" in set(families) and h2h is not None:
        named = h2h.select("game_id", F.col("pid_lo").alias("profile_id_a"), F.col("pid_hi").alias("profile_id_b"), F.col("h2h_games_before").alias("h2h_games"), F.col("h2h_wins_lo_before").alias("h2h_wins_a"))
        out = p5_derived(out.join(named, ["game_id", "profile_id_a", "profile_id_b"], "left"))
    if "low_history" in set(families):
        out = p8_derived(out)
    return out
