"""Features of requests as of their time: from the whole history (extended states) or from lists of recent games.

Requests join histories as further rows of the same windows, so that a player's
games are sorted once however many requests there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.exprs import LONG_GAME, MICROS_A_DAY, SHORT_GAME, cold_start, day_number, elo_expected, flag, micros, ratio, zero
from ..operators import pregame
from ..operators.joins import join_roles, pair_up, seen, seen_avg, seen_max, seen_sum

#: What a request needs of each game before it, newest first.
GAME = "array<struct<game_id:long,started_at:timestamp_ntz,duration:int,map:string,season:int,patch:string,civ:string,result:int,rating:int,mmr:int,opponent_profile_id:long>>"
CAP = 30
LAST = 20
DAYS = (7, 14, 30, 60)


def _upto_now(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_upto``: the player's last games, this one included, newest last."""
    item = F.struct("mmr", "result", "duration")
    games = F.collect_list(item).over(W.ordered("profile_id").rowsBetween(1 - LAST, 0))
    return rows.repartition("profile_id").withColumn("_upto", F.struct("started_at", "game_id", games.alias("games")))


def extended_states_as_of(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (request_id, profile_id, civ, at) with the extended columns of its player as of its time.

    Columns are those of ``player_stats_ext``; games at the request's own time
    don't count.  Days since a civilisation was played are full days.
    """
    columns = ["profile_id", "civ", "started_at", "result", "duration", "_upto"]
    past = _upto_now(rows).select(F.lit(None).cast("long").alias("request_id"), *columns)
    null = lambda x: F.lit(None).cast(past.schema[x].dataType).alias(x)
    asked = requests.select(F.col("request_id").cast("long"), "profile_id", "civ", F.col("at").alias("started_at"), null("result"), null("duration"), null("_upto"))
    real = F.col("request_id").isNull()
    one = lambda test=None: flag(real if test is None else real & F.coalesce(test, F.lit(False)))
    won = lambda test: F.when(test, F.col("result"))
    always, own = W.earlier_time("profile_id"), W.earlier_time("profile_id", "civ")
    short, long = F.col("duration") <= SHORT_GAME, F.col("duration") > LONG_GAME
    # A request without a civilisation has no games with it.
    count = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)).cast("long")
    known = lambda x: F.when(F.col("civ").isNotNull(), x)
    out: dict[str, Column] = {
        "avg_dur_life": F.avg(F.when(real, F.col("duration"))).over(always),
        "civ_avg_dur": known(F.avg(F.when(real, F.col("duration"))).over(own)),
        "short_games": count(one(short), always), "short_wins": count(won(short), always), "long_games": count(one(long), always), "long_wins": count(won(long), always),
    }
    for n in (7, 30, 60):
        w = W.within_days(n, "profile_id", "civ")
        out[f"civ_games_{n}d"], out[f"civ_wins_{n}d"] = F.coalesce(known(count(one(), w)), F.lit(0)), F.coalesce(known(count(F.col("result"), w)), F.lit(0))
    for n in DAYS:
        out[f"act_games_{n}d"] = count(one(), W.within_days(n, "profile_id"))
    last = F.max(F.when(real, micros("started_at"))).over(own)
    out["days_since_civ"] = known(F.floor((micros("started_at") - last) / F.lit(MICROS_A_DAY))).cast("int")
    out["_games"] = F.reverse(F.coalesce(F.max("_upto").over(always)["games"], F.array()))
    found = past.unionByName(asked).repartition("profile_id").withColumns(out).filter("request_id IS NOT NULL")
    return found.select("request_id", "profile_id", *[x for x in out if x != "_games"], *[x.alias(name) for name, x in _of_last_games().items()])


def _spread(values: Column) -> Column:
    """The sample standard deviation of an array; null for fewer than two values."""
    size = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / size
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(size >= 2, F.sqrt(squares / (size - 1)))


def _of_last_games() -> dict[str, Column]:
    """Trend, form and duration of the last games in ``_games`` (newest first)."""
    mmr = lambda x: x["mmr"]
    out = {f"mmr_lag{n}": F.get("_games", F.lit(n - 1))["mmr"] for n in (3, 5, 10, LAST)}
    for n in (10, LAST):
        values = F.filter(F.transform(F.slice("_games", 1, n), mmr), lambda v: v.isNotNull())
        out[f"mmr_std_{n}"] = _spread(values)
    for n in (5, 10, LAST):
        played = F.slice("_games", 1, n)
        out[f"recent_n_{n}"] = F.size(played).cast("long")
        out[f"recent_w_{n}"] = F.aggregate(played, F.lit(0).cast("long"), lambda acc, x: acc + zero(x["result"]))
    lengths = F.filter(F.transform("_games", lambda x: x["duration"]), lambda v: v.isNotNull())
    out["avg_dur_20"] = ratio(F.aggregate(lengths, F.lit(0.0), lambda acc, v: acc + v), F.size(lengths))
    return out


EXTENDED = list(dict.fromkeys(c for columns, _ in pregame.FAMILIES.values() for c in columns))


def meetings_as_of(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, h2h_games, h2h_wins_a): earlier meetings of the players of each request (request_id, profile_id_a, profile_id_b, at)."""
    met = pair_up(rows, ["result"], shared=["started_at"]).select(F.lit(None).cast("long").alias("request_id"), "profile_id_a", "profile_id_b", "started_at", F.col("result_a").cast("long").alias("w"))
    lo, hi = F.least("profile_id_a", "profile_id_b"), F.greatest("profile_id_a", "profile_id_b")
    swapped = F.col("profile_id_a") > F.col("profile_id_b")
    asked = requests.select("request_id", lo.alias("profile_id_a"), hi.alias("profile_id_b"), F.col("at").alias("started_at"), F.lit(None).cast("long").alias("w"), swapped.alias("swapped"))
    both = met.withColumn("swapped", F.lit(False)).unionByName(asked)
    w = W.earlier_time("profile_id_a", "profile_id_b")
    out = both.withColumns({"h2h_games": F.count("w").over(w), "_wins": F.coalesce(F.sum("w").over(w), F.lit(0))}).filter("request_id IS NOT NULL")
    return out.select("request_id", "h2h_games", F.when(F.col("swapped"), F.col("h2h_games") - F.col("_wins")).otherwise(F.col("_wins")).alias("h2h_wins_a"))


def extended_request_features(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, profile_id_a, profile_id_b, civ_a, civ_b, at and base features) with the extended features P1 to P5, P8 and P9."""
    sides = [requests.select("request_id", F.col(f"profile_id_{s}").alias("profile_id"), F.col(f"civ_{s}").alias("civ"), "at") for s in ("a", "b")]
    states = extended_states_as_of(rows, sides[0].unionByName(sides[1]))
    out = join_roles(requests, states, EXTENDED, key="request_id").join(meetings_as_of(rows, requests), "request_id", "left")
    for _, derive in pregame.FAMILIES.values():
        out = derive(out)
    return pregame.p8_derived(pregame.p5_derived(out))


# Requests that bring the players' recent games along.


def _side(t: str) -> dict[str, Column]:
    """Counts of one player's list of games ``games{t}`` (newest first): all but skills from its first games ``_visible{t}``, and of the match's season apart."""
    games, array = F.col(f"games{t}"), f"_visible{t}"
    civ = lambda x: x["civ"] == F.col(f"civ{t}")
    place = lambda x: x["map"] == F.col("map")
    won, length = (lambda x: x["result"]), (lambda x: x["duration"])
    short, long = (lambda x: x["duration"] <= SHORT_GAME), (lambda x: x["duration"] > LONG_GAME)
    since = lambda n: lambda x: micros(x["started_at"]) >= micros("at") - n * MICROS_A_DAY
    both = lambda f, g: lambda x: f(x) & g(x)
    first = lambda name: F.get(F.filter(F.transform(games, lambda x: x[name]), lambda v: v.isNotNull()), F.lit(0))
    days = lambda at: (day_number("at") - day_number(at)).cast("int")
    out = {
        "visible_games": seen(array=array), "mmr": first("mmr"), "rating": first("rating"), "days_since": days(F.get(games, F.lit(0))["started_at"]),
        "days_since_civ": days(seen_max(lambda x: x["started_at"], civ, array)), "games_lifetime": seen(array=array), "wins_lifetime": seen_sum(won, array=array),
        "avg_dur_life": seen_avg(length, array=array), "civ_avg_dur": seen_avg(length, civ, array), "avg_dur_20": seen_avg(length, array=f"_last{t}"),
        "short_games": seen(short, array), "short_wins": seen_sum(won, short, array), "long_games": seen(long, array), "long_wins": seen_sum(won, long, array),
    }
    for name, same in (("civ_games", civ), ("map_games", place)):
        out[name], out[name.replace("games", "wins")] = seen(same, array), seen_sum(won, same, array)
    for n in (7, 30, 60):
        out[f"civ_games_{n}d"], out[f"civ_wins_{n}d"] = seen(both(civ, since(n)), array), seen_sum(won, both(civ, since(n)), array)
    for n in (30, 60):
        out[f"act_games_{n}d"] = seen(since(n), array)
    for n in (5, 10, 20):
        played = F.slice(games, 1, n)
        out[f"recent_n_{n}"] = F.size(played).cast("long")
        out[f"recent_w_{n}"] = F.aggregate(played, F.lit(0).cast("long"), lambda acc, x: acc + zero(x["result"]))
    return {f"{name}{t}": x for name, x in out.items()}


def _checked(cap: int) -> int:
    if cap < LAST:
        raise ValueError(f"the cap must be {LAST} or more")
    return cap


def _derived(out: DataFrame) -> DataFrame:
    """What both sides' counts and ``_shared``, the games that the two played, give."""
    out = out.withColumns({"h2h_games": seen(array="_shared"), "h2h_wins_a": seen_sum(lambda x: x["result"], array="_shared")})
    out = pregame.base_derived(out)
    for derive in (pregame.p1_derived, pregame.p3_derived, pregame.p4_derived, pregame.p5_derived):
        out = derive(out)
    out = out.withColumns({f"{x}_diff": zero(f"{x}_a") - zero(f"{x}_b") for x in ("mmr", "rating")})
    out = cold_start(out)
    return out.withColumn("skill_diff", F.col("skill_a") - F.col("skill_b")).drop("_shared")


def recent_features(requests: DataFrame, cap: int = CAP) -> DataFrame:
    """Model features of requests that carry their players' games.

    ``requests`` has request_id, profile_id_a and _b, civ_a and _b, map, at,
    games_a and games_b (``GAME``, newest first), prior_matchup_games and
    prior_matchup_wins, and maybe season and patch; if these are null, the
    newest game of either player gives them.  A null list counts as empty.
    Everything but skills and form comes from the last ``cap`` games.
    """
    _checked(cap)
    out = requests.withColumns({f"games_{s}": F.coalesce(F.col(f"games_{s}"), F.array().cast(GAME)) for s in ("a", "b")})
    for x, kind in (("season", "int"), ("patch", "string")):
        if x not in out.columns:
            out = out.withColumn(x, F.lit(None).cast(kind))
    newest = F.array_max(F.transform(F.concat(F.slice("games_a", 1, 1), F.slice("games_b", 1, 1)), _stamp))
    out = out.withColumns({"season": F.coalesce("season", newest["season"]), "patch": F.coalesce("patch", newest["patch"])})
    out = out.withColumns({f"_{name}_{s}": F.slice(f"games_{s}", 1, n) for s in ("a", "b") for name, n in (("visible", cap), ("last", LAST))})
    same = lambda x: x["season"].eqNullSafe(F.col("season"))
    of_season = {f"{name}_season_{s}": f(f"_visible_{s}") for s in ("a", "b") for name, f in (("games", lambda v: seen(same, v)), ("wins", lambda v: seen_sum(lambda x: x["result"], same, v)))}
    out = out.withColumns(_side("_a") | _side("_b") | of_season)
    ids = F.transform("_visible_b", lambda x: x["game_id"])
    shared = F.filter("_visible_a", lambda x: (x["opponent_profile_id"] == F.col("profile_id_b")) & F.array_contains(ids, x["game_id"]))
    return _derived(out.withColumn("_shared", shared)).drop("games_a", "games_b", *[f"_{name}_{s}" for s in ("a", "b") for name in ("visible", "last")])


def _stamp(x: Column) -> Column:
    return F.struct(x["started_at"].alias("t"), x["season"].alias("season"), x["patch"].alias("patch"))


# Batches of probabilities.


class EloModel:
    """A model without parameters to fit: the Elo expectation of two skills, with missing ones filled in."""

    def __init__(self, spread: float = 400.0):
        self.spread = spread

    def transform(self, df: DataFrame) -> DataFrame:
        filled = cold_start(df)
        return filled.withColumn("p_win", elo_expected("skill_a", "skill_b", self.spread))


def pregame_probabilities(matches: DataFrame, rows: DataFrame, model, p: str = "p_win") -> DataFrame:
    """(match_id, p) for matches (match_id, slot1, slot2, started_at, usable): the chance of slot 1 as of the match's start.

    Matches that aren't usable, or whose players are the same or unknown, are
    left out.  The model sees the as-of states of both players (``_a`` is slot
    1) and gives the column ``p``; a match of slot 2 against slot 1 would get
    the complement only if the model is symmetric.
    """
    from .serving import states_as_of

    usable = matches.filter("coalesce(usable, true) AND slot1 IS NOT NULL AND slot2 IS NOT NULL AND slot1 <> slot2 AND started_at IS NOT NULL")
    none = lambda x: F.lit(None).cast(rows.schema[x].dataType).alias(x)
    asked = usable.select(F.col("match_id").alias("request_id"), F.explode(F.array("slot1", "slot2")).alias("profile_id"), none("civ"), none("map"), none("season"), F.col("started_at").alias("at"))
    states = states_as_of(rows, asked).withColumnsRenamed({"latest_mmr": "mmr", "latest_rating": "rating"})
    named = usable.select("match_id", F.col("match_id").alias("request_id"), F.col("slot1").alias("profile_id_a"), F.col("slot2").alias("profile_id_b"))
    both = join_roles(named, states, ["mmr", "rating", "lifetime_games", "lifetime_wins"], key="request_id")
    return model.transform(both).select("match_id", p)


def _lists(rows: DataFrame, most: int) -> DataFrame:
    """Each row with ``games`` (see ``recent_lists``; ``several`` marks games of more than two) and ``_players``, those of its match.

    Both windows go through one sort of narrow rows; no list is sorted or sent.
    """
    players = F.collect_set("profile_id").over(Window.partitionBy("game_id"))
    faced = rows.withColumn("_players", players).withColumns({"opponent_profile_id": F.get(F.array_remove("_players", F.col("profile_id")), F.lit(0)), "several": F.size("_players") > 2, "_t": micros("started_at")})
    item = F.struct("game_id", "started_at", "duration", "map", "season", "patch", "civ", "result", "rating", "mmr", "opponent_profile_id", "several")
    w = Window.partitionBy("profile_id").orderBy("_t", "game_id").rowsBetween(1 - most, 0)
    known = faced.repartition("profile_id").withColumn("_upto", F.struct("_t", "game_id", F.collect_list(item).over(w).alias("games")))
    before = F.max("_upto").over(Window.partitionBy("profile_id").orderBy("_t").rangeBetween(W.START, -1))["games"]
    return known.withColumn("games", F.reverse(F.coalesce(before, F.array()))).drop("_upto", "_t", "opponent_profile_id", "several")


def recent_lists(rows: DataFrame, most: int = CAP) -> DataFrame:
    """Each row with ``games``: its player's last ``most`` games at earlier times, newest first, as requests bring them along."""
    return _lists(rows, most).withColumn("games", F.transform("games", lambda x: x.dropFields("several"))).drop("_players")


def recent_match_features(rows: DataFrame, most: int = CAP, cap: int = CAP, sides: list[str] | None = None) -> DataFrame:
    """``recent_features`` of each match as a request of its players, with their last ``most`` games at earlier times.

    Each side is counted where its player's games are; only counts travel to
    the match, not the lists: of a list, no more than the games against players
    of this match and a count for each season.  With ``sides``, only these
    columns of a side (named without ``_a`` and ``_b``) are counted; others and
    what derives from them are null.
    """
    own = _lists(rows, most).withColumn("at", F.col("started_at"))
    own = own.withColumns({name: F.slice("games", 1, n) for name, n in (("_visible", _checked(cap)), ("_last", LAST))})
    of = lambda s: lambda x: x["season"].eqNullSafe(s)
    season = lambda s: F.struct(s.alias("season"), seen(of(s), "_visible").alias("games"), seen_sum(lambda x: x["result"], of(s), "_visible").alias("wins"))
    among = lambda x: F.array_contains("_players", x["opponent_profile_id"])
    game = lambda x: F.struct(x["game_id"].alias("game_id"), x["opponent_profile_id"].alias("opponent_profile_id"), x["result"].alias("result"))
    counted = _side("")
    kept = [x for x in counted if sides is None or x in sides]
    seasons, met = F.transform(F.array_distinct(F.transform("_visible", lambda x: x["season"])), season), F.transform(F.filter("_visible", among), game)
    ids = F.transform(F.filter("_visible", lambda x: x["several"] | among(x)), lambda x: x["game_id"])
    made = {x: counted[x] for x in kept} | {"_newest": F.get(F.transform(F.slice("games", 1, 1), _stamp), F.lit(0)), "_seasons": seasons, "_met": met, "_ids": ids}
    own = own.select("game_id", "profile_id", "civ", "at", "map", *[x.alias(name) for name, x in made.items()])
    out = pair_up(own, ["civ", *made], shared=["at", "map"]).withColumnRenamed("game_id", "request_id")
    out = out.withColumns({f"{x}_{s}": F.lit(None).cast("long") for x in counted if x not in kept for s in ("a", "b")} | {f"prior_matchup_{x}": F.lit(None).cast("long") for x in ("games", "wins")})
    newest = F.array_max(F.array("_newest_a", "_newest_b"))
    out = out.withColumns({"season": newest["season"], "patch": newest["patch"]})
    now = lambda s, x: zero(F.get(F.filter(f"_seasons_{s}", of(F.col("season"))), F.lit(0))[x])
    out = out.withColumns({f"{x}_season_{s}": now(s, x) for s in ("a", "b") for x in ("games", "wins")})
    shared = F.filter("_met_a", lambda x: (x["opponent_profile_id"] == F.col("profile_id_b")) & F.array_contains("_ids_b", x["game_id"]))
    return _derived(out.withColumn("_shared", shared)).drop(*[f"{x}_{s}" for x in ("_newest", "_seasons", "_met", "_ids") for s in ("a", "b")])
