"""Features of capped histories (each player's last n games), careers and the spread of recent games over time.

The visible games of a row are an array built by one window, so that nothing is
joined by ranges: a player's history is sorted once, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.exprs import LONG_GAME, MICROS_A_DAY, SHORT_GAME, days_between, micros, smooth, zero
from .joins import capped_history, join_roles, seen, seen_avg, seen_max, seen_min, seen_sum
from .pregame import _diffs, _sides

#: What is kept of each visible game.
VISIBLE = ["game_id", "result", "civ", "map", "season", "started_at", "at", "duration", "seq", "gap"]


def visible_games(stats: DataFrame, cap: int) -> DataFrame:
    """``stats`` with ``visible``; ``gap`` is the days since the game before."""
    if cap <= 0:
        raise ValueError("the cap must be positive")
    gap = days_between(F.lag("started_at").over(W.ordered("profile_id")), "started_at")
    rows = stats.withColumns({"at": micros("started_at"), "seq": W.sequence("profile_id"), "gap": gap})
    return capped_history(rows, cap, VISIBLE)


def _since(days: int):
    return lambda x: x["at"] >= F.col("at") - days * MICROS_A_DAY


def _civ(x: Column) -> Column:
    return x["civ"] == F.col("civ")


def _both(*conditions):
    def test(x: Column) -> Column:
        out = F.lit(True)
        for c in conditions:
            out &= c(x)
        return out

    return test


def capped_stats(stats: DataFrame, cap: int) -> DataFrame:
    """For each player's match, recency, durations and base counts from the last ``cap`` games alone."""
    won, length = (lambda x: x["result"]), (lambda x: x["duration"])
    short, long = (lambda x: x["duration"] <= SHORT_GAME), (lambda x: x["duration"] > LONG_GAME)
    out = {
        "visible_games": seen(),
        "avg_dur_life": seen_avg(length),
        "civ_avg_dur": seen_avg(length, _civ),
        "avg_dur_20": seen_avg(length, lambda x: x["seq"] >= F.col("seq") - 20),
        "days_since_civ": days_between(seen_max(lambda x: x["started_at"], _civ), "started_at"),
        "short_games": seen(short), "short_wins": seen_sum(won, short), "long_games": seen(long), "long_wins": seen_sum(won, long),
        "games_lifetime": seen(), "wins_lifetime": seen_sum(won),
    }
    for n in (7, 30, 60):
        out[f"civ_games_{n}d"] = seen(_both(_civ, _since(n)))
        out[f"civ_wins_{n}d"] = seen_sum(won, _both(_civ, _since(n)))
    for n in (30, 60):
        out[f"act_games_{n}d"] = seen(_since(n))
    for name, same in (("games_season", lambda x: x["season"] == F.col("season")), ("civ_games", _civ), ("map_games", lambda x: x["map"] == F.col("map"))):
        out[name] = seen(same)
        out[name.replace("games", "wins")] = seen_sum(won, same)
    return visible_games(stats, cap).withColumns(out)


CAPPED = ["visible_games", "avg_dur_life", "civ_avg_dur", "avg_dur_20", *[f"civ_{x}_{n}d" for n in (7, 30, 60) for x in ("games", "wins")], "days_since_civ", "act_games_30d", "act_games_60d", "short_games", "short_wins", "long_games", "long_wins"]
CAPPED_BASE = ["games_lifetime", "wins_lifetime", "games_season", "wins_season", "civ_games", "civ_wins", "map_games", "map_wins"]


def capped_overrides(training: DataFrame, stats: DataFrame, cap: int) -> DataFrame:
    """One row for each match: the capped columns of both players and the meetings both can see."""
    rows = capped_stats(stats, cap).select("game_id", "profile_id", "visible", *CAPPED)
    both = join_roles(training.select("game_id", "profile_id_a", "profile_id_b"), rows, [*CAPPED, "visible"])
    seen_by_b = F.transform("visible_b", lambda x: x["game_id"])
    shared = F.filter("visible_a", lambda x: F.array_contains(seen_by_b, x["game_id"]))
    out = both.withColumn("_shared", shared)
    return out.withColumns({"h2h_games": seen(array="_shared"), "h2h_wins_a": seen_sum(lambda x: x["result"], array="_shared")}).drop("_shared", "visible_a", "visible_b", "profile_id_a", "profile_id_b")


def capped_base_overrides(training: DataFrame, stats: DataFrame, cap: int) -> DataFrame:
    """One row for each match: base counts of both players from their last ``cap`` games."""
    rows = capped_stats(stats, cap).select("game_id", "profile_id", *CAPPED_BASE)
    return join_roles(training.select("game_id", "profile_id_a", "profile_id_b"), rows, CAPPED_BASE).drop("profile_id_a", "profile_id_b")


def career(stats: DataFrame) -> DataFrame:
    """Peak and mean mmr of all earlier games beside the lifetime counts."""
    w = W.prior("profile_id")
    return stats.select(
        "game_id", "profile_id", F.col("games_lifetime_before").alias("career_games"), F.col("wins_lifetime_before").alias("career_wins"), F.col("civ_games_before").alias("career_civ_games"),
        F.col("civ_wins_before").alias("career_civ_wins"), F.max("mmr").over(w).alias("peak_mmr"), F.avg("mmr").over(w).alias("career_avg_mmr"),
    )


def apply_career(training: DataFrame, careers: DataFrame) -> DataFrame:
    """Career rates, gaps to peak and mean, form against career (where recent form is there), differences."""
    columns = ["career_games", "career_wins", "career_civ_games", "career_civ_wins", "peak_mmr", "career_avg_mmr"]

    def side(s: str) -> dict[str, Column]:
        rate = smooth(f"career_wins_{s}", f"career_games_{s}")
        out = {
            f"career_wr_{s}": rate,
            f"career_civ_wr_{s}": smooth(f"career_civ_wins_{s}", f"career_civ_games_{s}"),
            f"mmr_vs_peak_{s}": F.col(f"mmr_{s}") - F.col(f"peak_mmr_{s}"),
            f"mmr_vs_career_avg_{s}": F.col(f"mmr_{s}") - F.col(f"career_avg_mmr_{s}"),
        }
        return out | ({f"form_vs_career_{s}": F.col(f"recent_wr_20_{s}") - rate} if f"recent_wr_20_{s}" in training.columns else {})

    out = _diffs(_sides(join_roles(training, careers, columns), side), ["career_wr", "peak_mmr", "career_avg_mmr"])
    out = out.withColumn("career_games_diff", zero("career_games_a") - zero("career_games_b"))
    return out.drop(*[f"{x}_{s}" for x in ("career_wins", "career_civ_games", "career_civ_wins") for s in ("a", "b")])


TEMPORAL = ["window_span_days", "gap_mean_window", "gap_max_window", "wt_act_7d", "wt_act_30d"]


def temporal_stats(stats: DataFrame, cap: int) -> DataFrame:
    """How each player's last ``cap`` games spread over days."""
    gap = lambda x: x["gap"]
    return visible_games(stats, cap).withColumns(
        {
            "wt_visible": seen(),
            "window_span_days": days_between(seen_min(lambda x: x["started_at"]), "started_at"),
            "gap_mean_window": seen_avg(gap),
            "gap_max_window": seen_max(gap),
            "wt_act_7d": seen(_since(7)),
            "wt_act_30d": seen(_since(30)),
        }
    )


def apply_temporal(training: DataFrame, stats: DataFrame, cap: int) -> DataFrame:
    """``training`` with the spread of both players' windows, densities and differences."""
    rows = temporal_stats(stats, cap).select("game_id", "profile_id", "wt_visible", *TEMPORAL)
    both = join_roles(training, rows, ["wt_visible", *TEMPORAL])
    density = lambda s: {f"games_per_day_window_{s}": zero(f"wt_visible_{s}") / (F.greatest(zero(f"window_span_days_{s}"), F.lit(0)) + F.lit(1.0))}
    out = _diffs(_sides(both, density), ["games_per_day_window"])
    return _diffs(out, ["window_span_days", "gap_max_window", "wt_act_30d"], nulls_as_zero=True).drop("wt_visible_a", "wt_visible_b")
