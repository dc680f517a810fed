"""Rating deltas: the study's frame, its validation, live player states and conditional deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.exprs import days_between, elo_delta, flag, micros, round_half_away
from .pregame import player_games


def recent_rate(n: int, *keys: str) -> Column:
    """Share won of the last n games; null before the first."""
    w = W.last(n, *keys)
    return F.sum("result").over(w).cast("double") / F.nullif(F.count("*").over(w).cast("double"), F.lit(0.0))


def history(rows: DataFrame) -> DataFrame:
    """Counts, gap, recent rates and the streak (signed length) before each match."""
    key = "profile_id"
    run = W.runs(rows.repartition(key), key, "result")
    sign = F.when(F.col("result") == 1, 1).otherwise(-1)
    return run.withColumns(
        {
            "games_lifetime_before": W.count_before(key),
            "games_season_before": W.count_before(key, "season"),
            "days_since_last_game": days_between(F.lag("started_at").over(W.ordered(key)), "started_at"),
            "recent_wr_10": recent_rate(10, key),
            "recent_wr_20": recent_rate(20, key),
            "current_streak": F.coalesce(F.lag(sign * F.col("run_len")).over(W.ordered(key)), F.lit(0)).cast("long"),
        }
    ).drop("run", "run_len")


def rating_frame(games: DataFrame, participants: DataFrame, seasons: list[int] | None = None) -> DataFrame:
    """One row for each player's match with an observed rating change, with the opponent and both histories."""
    rows = player_games(games, participants)
    past = history(rows)
    main = past.filter("rating_diff IS NOT NULL")
    main = main if seasons is None else main.filter(F.col("season").isin(seasons))
    other = past.select("game_id", F.col("profile_id").alias("opponent_profile_id"), F.col("rating").alias("opponent_rating_before"), F.col("mmr").alias("opponent_mmr_before"), F.col("games_season_before").alias("opponent_games_this_season_before"))
    both = main.join(other, "game_id").filter("profile_id <> opponent_profile_id")
    missing = {"missing_player_rating": "rating", "missing_opponent_rating": "opponent_rating_before", "missing_player_mmr": "mmr", "missing_opponent_mmr": "opponent_mmr_before"}
    return both.select(
        "game_id", "started_at", "season", "patch", "map", "profile_id", "opponent_profile_id", F.col("rating").alias("player_rating_before"), "opponent_rating_before",
        (F.col("rating") - F.col("opponent_rating_before")).alias("visible_rating_gap"), F.col("mmr").alias("player_mmr_before"), "opponent_mmr_before",
        (F.col("mmr") - F.col("opponent_mmr_before")).alias("hidden_mmr_gap"), "result", F.col("rating_diff").alias("observed_rating_delta"), F.col("mmr_diff").alias("observed_hidden_mmr_delta"),
        "games_lifetime_before", F.col("games_season_before").alias("games_this_season_before"), "opponent_games_this_season_before", "days_since_last_game", "current_streak", "recent_wr_10", "recent_wr_20",
        *[flag(F.col(x).isNull()).alias(name) for name, x in missing.items()],
    )


def validate(frame: DataFrame) -> DataFrame:
    """One row: how often winners gain and losers lose, quantiles of the change, whether that is fatal or a warning."""
    win, gain = F.col("result") == 1, F.col("observed_rating_delta") > 0
    share = lambda inside, good: (F.sum(F.when(inside & good, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(inside, 1.0).otherwise(0.0)), F.lit(0.0)))
    out = frame.agg(
        F.count("*").alias("rows"), share(win, gain).alias("winner_positive"), share(~win, F.col("observed_rating_delta") < 0).alias("loser_negative"),
        *[F.percentile("observed_rating_delta", F.lit(q / 100)).alias(f"delta_p{q:02d}") for q in (5, 25, 50, 75, 95)],
    )
    return out.withColumns({"fatal": flag(F.col("winner_positive") < 0.8), "warning": flag(F.col("winner_positive") < 0.95)})


def player_state(rows: DataFrame, before: Column | None = None) -> DataFrame:
    """Each player's state after the last match (before a time, if given): rating and mmr after it, streak, recent rates."""
    past = rows if before is None else rows.filter(F.col("started_at") < before)
    order = Window.partitionBy("profile_id").orderBy(F.desc("started_at"), F.desc("game_id"))
    # Ranks and the end of the newest run need the whole history; one sort by player gives both.
    ranked = past.withColumn("rn", F.row_number().over(order)).withColumn("newest", F.first("result").over(order))
    after = lambda x, d: F.max_by(F.when(F.col(x).isNotNull(), F.col(x) + F.coalesce(F.col(d), F.lit(0))), F.when(F.col(x).isNotNull(), F.struct(micros("started_at"), "game_id")))
    rate = lambda n: F.avg(F.when(F.col("rn") <= n, F.col("result")))
    out = ranked.groupBy("profile_id").agg(
        F.count("*").alias("games"), after("rating", "rating_diff").alias("rating"), after("mmr", "mmr_diff").alias("mmr"),
        F.max("newest").alias("newest"), F.coalesce(F.min(F.when(F.col("result") != F.col("newest"), F.col("rn"))) - 1, F.count("*")).alias("run"), rate(10).alias("recent_wr_10"), rate(20).alias("recent_wr_20"),
    )
    return out.withColumn("streak", F.when(F.col("newest") == 1, F.col("run")).otherwise(-F.col("run")).cast("long")).drop("newest", "run")


def conditional_deltas(pairs: DataFrame, k: float = 32.0, spread: float = 400.0) -> DataFrame:
    """Four rows for each pair (side x outcome): the change each result would bring; null without a rating, with a warning."""
    rows = pairs.select(
        "game_id",
        F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(r).alias("result"), F.col(f"rating_{s}").alias("own"), F.col(f"rating_{o}").alias("other")) for s, o in (("a", "b"), ("b", "a")) for r in (0, 1)])).alias("x"),
    ).select("game_id", "x.*")
    raw = elo_delta(F.col("own").cast("double"), F.col("other").cast("double"), F.col("result").cast("double"), k, spread)
    warn = F.array_compact(F.array(F.when(F.col("own").isNull(), "no_rating"), F.when(F.col("other").isNull(), "no_opponent_rating")))
    return rows.select("game_id", "side", "result", raw.alias("delta"), round_half_away(raw).alias("delta_rounded"), F.floor(raw).alias("delta_floor"), F.array_join(warn, ",").alias("warnings"))
