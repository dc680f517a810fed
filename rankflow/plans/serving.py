"""Batch serving: requests joined to histories as of their time, marginal chances, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..operators.joins import as_dimension, asof_join

LOW_HISTORY = 10


def states_as_of(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (request_id, profile_id, civ, map, season, at) with the player's counts before its time.

    Requests join the histories as rows without a result, in the same windows
    that make training features; a request sees earlier times alone.
    """
    probe = requests.select(F.col("request_id"), "profile_id", "civ", "map", "season", F.col("at").alias("started_at"))
    columns = ["profile_id", "civ", "map", "season", "started_at"]
    # A game_id below all others puts a request before history of the same time.
    past = rows.select(F.lit(None).cast("long").alias("request_id"), *columns, "game_id", "result", "mmr", "rating")
    asked = probe.select("request_id", *columns, F.lit(-1).cast("long").alias("game_id"), F.lit(None).cast("int").alias("result"), F.lit(None).cast(rows.schema["mmr"].dataType).alias("mmr"), F.lit(None).cast(rows.schema["rating"].dataType).alias("rating"))
    # Several requests of one player must not count one another: they meet history through separate copies of the key.
    both = past.unionByName(asked)
    real = F.col("request_id").isNull()
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("started_at", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *keys: F.coalesce(F.sum(flag(real)).over(earlier(*keys)), F.lit(0)).alias
    wins = lambda *keys: F.coalesce(F.sum("result").over(earlier(*keys)), F.lit(0)).alias
    latest = lambda x: F.last(F.when(real, F.col(x)), ignorenulls=True).over(earlier("profile_id")).alias(f"latest_{x}")
    spans = {"lifetime": ("profile_id",), "season": ("profile_id", "season"), "civ": ("profile_id", "civ"), "map": ("profile_id", "map")}
    out = both.repartition("profile_id").select("request_id", "profile_id", *[count(*k)(f"{x}_games") for x, k in spans.items()], *[wins(*k)(f"{x}_wins") for x, k in spans.items()], latest("mmr"), latest("rating"))
    return out.filter("request_id IS NOT NULL")


def latest_matchup(requests: DataFrame, priors: DataFrame) -> DataFrame:
    """The newest cumulative row of a directional pairing up to the request's season."""
    return asof_join(requests, priors, ["civ_a", "civ_b"], ["prior_games", "prior_wins"], at="season", tie="season", inclusive=True)


def mirror_fixed(matchups: DataFrame) -> DataFrame:
    """Snapshot rows; a civilisation against itself has won half its games."""
    return matchups.withColumn("wins", F.when(F.col("civ_a") == F.col("civ_b"), F.floor(F.col("games") / 2)).otherwise(F.col("wins")))


def marginal_win(civ_a: DataFrame, civ_b: DataFrame, win: DataFrame) -> DataFrame:
    """Sum over both picks of P(a) P(b) P(win | a, b), for each request; ``civ_a`` and ``civ_b`` have request_id, civ, p."""
    both = civ_a.select("request_id", F.col("civ").alias("civ_a"), F.col("p").alias("pa")).join(civ_b.select("request_id", F.col("civ").alias("civ_b"), F.col("p").alias("pb")), "request_id")
    full = both.join(as_dimension(win.select("civ_a", "civ_b", F.col("p").alias("pw"))), ["civ_a", "civ_b"], "left")
    mass = F.col("pa") * F.col("pb")
    return full.groupBy("request_id").agg((F.sum(mass * F.coalesce("pw", F.lit(0.5))) / F.nullif(F.sum(mass), F.lit(0.0))).alias("p_win"))


def civ_distribution(scores: DataFrame, group: list[str], score: str | None, games: str, least: int = LOW_HISTORY) -> DataFrame:
    """Normalised scores; uniform where the player has few games or there is no score."""
    w = Window.partitionBy(*group)
    uniform = F.lit(1.0) / F.count("*").over(w)
    if score is None:
        return scores.withColumn("p", uniform)
    total = F.sum(score).over(w)
    return scores.withColumn("p", F.when((F.col(games) < least) | F.coalesce(total <= 0, F.lit(True)), uniform).otherwise(F.col(score) / total))


def context(df: DataFrame) -> DataFrame:
    """How much is known of a request, and warnings about what isn't."""
    known = lambda *x: [F.col(c).isNotNull() for c in x]
    civs, place = known("civ_a", "civ_b"), known("map")[0]
    warn = {
        "unknown map": F.col("map").isNull(), "unknown civilization": ~(civs[0] & civs[1]), "no skill of player a": F.col("skill_a").isNull(), "no skill of player b": F.col("skill_b").isNull(),
        "few games of player a": F.col("games_lifetime_a") < LOW_HISTORY, "few games of player b": F.col("games_lifetime_b") < LOW_HISTORY,
    }
    level = F.when(civs[0] & civs[1] & place, "full").when(civs[0] & civs[1], "civs").when(place, "map").otherwise("players")
    return df.withColumns({"context_level": level, "warnings": F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in warn.items()]))})


def confidence(p: Column) -> Column:
    """A word for how sure a probability is."""
    d = F.abs(p - 0.5)
    return F.when(d >= 0.25, "high").when(d >= 0.1, "medium").otherwise("low")
