"""Player clustering features: smoothed civilisation shares, entropy, map dependence, distance from the meta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .joins import as_dimension

MIN_GAMES, MIN_MAP_GAMES, MIN_MAPS = 50, 10, 2
ALPHA_OVERALL, ALPHA_MAP, ALPHA_META = 10, 5, 10
P = "profile_id"


def picks(rows: DataFrame) -> DataFrame:
    """Games with a chosen (not random) civilisation."""
    return rows.filter("NOT coalesce(civilization_randomized, false)")


def eligible(rows: DataFrame, least: int = MIN_GAMES) -> DataFrame:
    """Players with enough picks: games, random rate, picks."""
    random = F.coalesce(F.col("civilization_randomized"), F.lit(False))
    out = rows.groupBy(P).agg(F.count("*").alias("n_games"), F.avg(random.cast("int")).alias("random_civ_rate"), F.count(F.when(~random, 1)).alias("n_nonrandom_games"))
    return out.filter(F.col("n_nonrandom_games") >= least)


def civ_prior(rows: DataFrame) -> DataFrame:
    """(civ, prior): each civilisation's share of all picks."""
    counts = rows.groupBy("civ").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("civ", ratio("n", "t").alias("prior"))  # total is one row


def smoothed_shares(rows: DataFrame, prior: DataFrame, alpha: int = ALPHA_OVERALL) -> DataFrame:
    """(profile_id, civ): picks, raw and smoothed share, for every civilisation."""
    counts = rows.groupBy(P, "civ").agg(F.count("*").alias("n"))
    grid = rows.select(P).distinct().crossJoin(as_dimension(prior))  # players x civilisations (a small dimension)
    total = F.sum("n").over(Window.partitionBy(P))
    return grid.join(counts, [P, "civ"], "left").na.fill(0, ["n"]).select(P, "civ", "prior", "n", ratio("n", total).alias("raw"), ((F.col("n") + alpha * F.col("prior")) / (total + alpha)).alias("share"))


def diagnostics(shares: DataFrame) -> DataFrame:
    """Top picks, normalised entropy and effective pool of each player."""
    rank = F.row_number().over(Window.partitionBy(P).orderBy(F.desc("raw"), "civ"))
    p = F.greatest("raw", F.lit(1e-12))
    out = shares.withColumn("r", rank).groupBy(P).agg(
        F.max(F.when(F.col("r") == 1, F.col("civ"))).alias("top_civ"), F.max("raw").alias("top_civ_share"), F.sum(F.when(F.col("r") <= 3, F.col("raw")).otherwise(0.0)).alias("top_3_civ_share"), F.sum(-p * F.ln(p)).alias("e"), F.count("*").alias("k")
    )
    return out.select(P, "top_civ", "top_civ_share", "top_3_civ_share", (F.col("e") / F.ln(F.col("k").cast("double"))).alias("civ_entropy"), F.exp("e").alias("effective_civ_pool_size"))


def _distance(x: str, y: str):
    return F.sqrt(0.5 * F.sum(F.pow(F.sqrt(F.greatest(F.col(x), F.lit(0.0))) - F.sqrt(F.greatest(F.col(y), F.lit(0.0))), F.lit(2.0))))


def map_dependence(rows: DataFrame, shares: DataFrame, alpha: int = ALPHA_MAP) -> DataFrame:
    """Mean Hellinger distance, weighted by games, of a player's picks by map from all the player's picks."""
    enough = rows.groupBy(P, "map").agg(F.count("*").alias("n_map")).filter(F.col("n_map") >= MIN_MAP_GAMES)
    maps = F.count("*").over(Window.partitionBy(P))
    enough = enough.withColumn("maps", maps).filter(F.col("maps") >= MIN_MAPS)
    counts = rows.groupBy(P, "map", "civ").agg(F.count("*").alias("c"))
    long = enough.join(shares.select(P, "civ", "share"), P).join(counts, [P, "map", "civ"], "left").na.fill(0, ["c"])
    long = long.withColumn("of_map", (F.col("c") + alpha * F.col("share")) / (F.col("n_map") + alpha))
    by_map = long.groupBy(P, "map", "n_map").agg(_distance("of_map", "share").alias("h"))
    return by_map.groupBy(P).agg((F.sum(F.col("h") * F.col("n_map")) / F.sum("n_map")).alias("map_dependence_score"))


def off_meta(rows: DataFrame, base: DataFrame, shares: DataFrame, prior: DataFrame, alpha: int = ALPHA_META) -> DataFrame:
    """Hellinger distance of a player's picks from what the maps and seasons played would lead one to expect.

    ``rows`` are all picks (for the meta), ``base`` all games of the players.
    """
    counts = rows.groupBy("map", "season", "civ").agg(F.count("*").alias("c"))
    totals = rows.groupBy("map", "season").agg(F.count("*").alias("t"))
    grid = totals.crossJoin(as_dimension(prior))  # (map, season) x civilisations
    meta = grid.join(counts, ["map", "season", "civ"], "left").na.fill(0, ["c"]).select("map", "season", "civ", ((F.col("c") + alpha * F.col("prior")) / (F.col("t") + alpha)).alias("m"))
    weights = base.groupBy(P, "map", "season").agg(F.count("*").alias("n")).join(totals.select("map", "season"), ["map", "season"])
    weights = weights.withColumn("w", ratio("n", F.sum("n").over(Window.partitionBy(P))))
    expected = weights.join(meta, ["map", "season"]).groupBy(P, "civ").agg(F.sum(F.col("w") * F.col("m")).alias("expected"))
    return expected.join(shares.select(P, "civ", "share"), [P, "civ"]).groupBy(P).agg(_distance("share", "expected").alias("off_meta_score"))


def latest_value(rows: DataFrame, column: str = "mmr") -> DataFrame:
    """The latest value that isn't null."""
    return rows.filter(F.col(column).isNotNull()).groupBy(P).agg(F.max_by(column, F.struct("started_at", "game_id")).alias(f"latest_{column}"))


def season_profile(rows: DataFrame) -> DataFrame:
    """First and last game, seasons played, and the season with most games (the earliest of equals)."""
    counts = rows.groupBy(P, "season").agg(F.count("*").alias("n"), F.min("started_at").alias("a"), F.max("started_at").alias("b"))
    return counts.groupBy(P).agg(
        F.min("a").alias("first_game_date"), F.max("b").alias("last_game_date"), F.count("*").alias("n_seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        (F.max("season") - F.min("season")).alias("season_span"), F.max_by("season", F.struct("n", -F.col("season"))).alias("dominant_season"),
    )


def mmr_profile(rows: DataFrame) -> DataFrame:
    """Each player's mean mmr, how often it is known and how often not."""
    return rows.groupBy(P).agg(F.avg("mmr").alias("mean_mmr"), F.count("mmr").alias("n_mmr_obs"), F.avg(F.col("mmr").isNull().cast("int")).alias("mmr_missing_rate"))


def player_features(rows: DataFrame, least: int = MIN_GAMES) -> DataFrame:
    """All clustering features of players with enough picks."""
    players = eligible(rows, least)
    base = rows.join(players.select(P), P, "left_semi")
    chosen, everyone = picks(base), picks(rows)
    prior = civ_prior(chosen)
    shares = smoothed_shares(chosen, prior)
    out = players
    for part in (diagnostics(shares), mmr_profile(base), latest_value(base), season_profile(base), map_dependence(chosen, shares), off_meta(everyone, base, shares, civ_prior(everyone))):
        out = out.join(part, P, "left")
    return out.withColumn("v1_eligible", F.col("map_dependence_score").isNotNull())
