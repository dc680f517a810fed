"""Which civilisation a player picks: candidate rows, their histories, ranks and entropies, and the anonymous variant.

Per-candidate histories come from windows and arrays over each player's own
games, and global rates from cumulative counts; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.exprs import ANONYMOUS_SMOOTHING, CIV_OPTIONS, MICROS_A_DAY, SHARE_SMOOTHING, civ_option, days_between, flag, forbid_columns, micros, ratio, smooth, smooth_share, tier
from .joins import as_dimension, expand_candidates, seen
from .pregame import player_games

UNIFORM = 1.0 / CIV_OPTIONS
GROUP = ["game_id", "profile_id"]


def raw_games(games: DataFrame, participants: DataFrame) -> DataFrame:
    """Players' games with the option picked, the one before and how long that had been picked in a row."""
    rows = player_games(games, participants).filter("civ IS NOT NULL").withColumn("civ", civ_option("civ"))
    run = W.runs(rows.repartition("profile_id"), "profile_id", "civ")  # and so are the rows that come out
    w = W.ordered("profile_id")
    return run.withColumns({"prev_civ": F.lag("civ").over(w), "prev_civ_streak_len": F.coalesce(F.lag("run_len").over(w), F.lit(0))}).drop("run", "run_len")


def civ_games(raw: DataFrame) -> DataFrame:
    """Each game's number and wins so far with its option, itself included."""
    return raw.withColumns({"civ_game_num": W.sequence("profile_id", "civ"), "civ_wins_cumul": W.sum_over("result", W.ordered("profile_id", "civ").rowsBetween(W.START, 0))})


def first_seen(games: DataFrame, participants: DataFrame) -> DataFrame:
    both = participants.filter("civilization IS NOT NULL").join(games.select("game_id", "started_at"), "game_id")
    return both.groupBy(civ_option().alias("civ")).agg(F.min("started_at").alias("first_seen_at"))


def pick_rates(raw: DataFrame, by: str) -> DataFrame:
    """(by, civ): the option's share of all picks of that season or patch."""
    counts = raw.groupBy(by, "civ").agg(F.count("*").alias("n"))
    return counts.select(by, "civ", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("pick_rate"))


def previous_rates(rates: DataFrame, by: str) -> DataFrame:
    """(by, civ): the rate of the latest earlier ``by`` in which the option was picked, for each value of ``by``."""
    grid = rates.select(by).distinct().crossJoin(as_dimension(rates.select("civ").distinct()))  # patches x options: a small grid
    w = Window.partitionBy("civ").orderBy(by).rowsBetween(W.START, -1)
    full = grid.join(rates, [by, "civ"], "left")
    return full.select(by, "civ", F.last("pick_rate", ignorenulls=True).over(w).alias("pick_rate"))


def counts_as_of(events: DataFrame, probes: DataFrame, keys: list[str], name: str, at: str = "started_at") -> DataFrame:
    """(keys, at, name): how many ``events`` (keys, at, n) have the same keys and an earlier time, for each of ``probes`` (keys, at).

    Counts are cumulative within a day, and days are cumulative on their own, so
    that no window holds more than the times of one day or the days of one key.
    """
    both = events.select(*keys, at, "n", F.lit(0).alias("_asked")).unionByName(probes.select(*keys, at, F.lit(0).cast("long").alias("n"), F.lit(1).alias("_asked")))
    times = both.groupBy(*keys, at).agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked")).withColumn("_day", F.to_date(at))
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    days = times.groupBy(*keys, "_day").agg(F.sum("n").alias("n"))
    days = days.select(*keys, "_day", before(Window.partitionBy(*keys).orderBy(F.unix_date("_day")).rowsBetween(W.START, -1)).alias("_earlier"))
    within = Window.partitionBy(*keys, "_day").orderBy(micros(at)).rowsBetween(W.START, -1)
    own = times.withColumn("_within", before(within)).filter("_asked = 1")
    return own.join(days, [*keys, "_day"]).select(*keys, at, (F.col("_earlier") + F.col("_within")).alias(name))


def with_rate_before(rows: DataFrame, raw: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Candidate rows with the share of picks of their option among all picks of the same keys at earlier times (null if none)."""
    at = ["started_at"]
    picks = raw.groupBy(*keys, *at, F.col("civ").alias("candidate_civ")).agg(F.count("*").alias("n"))
    of_civ = counts_as_of(picks, rows.select(*keys, "candidate_civ", *at).distinct(), [*keys, "candidate_civ"], "_own")
    of_all = counts_as_of(raw.groupBy(*keys, *at).agg(F.count("*").alias("n")), raw.select(*keys, *at).distinct(), keys, "_all")
    known = rows.join(of_civ, [*keys, "candidate_civ", *at], "left").join(of_all, [*keys, *at], "left")
    return known.withColumn(name, ratio("_own", "_all")).drop("_own", "_all")


def candidates(raw: DataFrame, seen_at: DataFrame, seasons: list[int] | None = None, sample: Column | None = None) -> DataFrame:
    chosen = raw if seasons is None else raw.filter(F.col("season").isin(seasons))
    chosen = chosen if sample is None else chosen.filter(sample)
    return expand_candidates(chosen.withColumnRenamed("civ", "chosen_civ"), seen_at, "chosen_civ")


def with_player_counts(raw: DataFrame, days: int = 30, dealt: bool = False) -> DataFrame:
    """The player's games at earlier times: all, of ``days`` days, of this patch and of this map; ``dealt``: rows are dealt by player already."""
    return (raw if dealt else raw.repartition("profile_id")).withColumns(
        {
            "player_games_lifetime": F.count("*").over(W.earlier_time("profile_id")),
            "player_games_30d": F.count("*").over(W.within_days(days, "profile_id")),
            "player_games_this_patch": F.count("*").over(W.earlier_time("profile_id", "patch")),
            "player_games_this_map": F.count("*").over(W.earlier_time("profile_id", "map")),
        }
    )


def with_recent(raw: DataFrame, last: int = 20, dealt: bool = False) -> DataFrame:
    """``recent``: the player's last ``last`` games at earlier times, newest first, however many share a time.

    Both windows go through one sort of rows without lists; ``dealt``: rows are dealt by player already.
    """
    item = F.struct("started_at", "game_id", "civ", "map")
    rows = (raw if dealt else raw.repartition("profile_id")).withColumn("_t", micros("started_at"))
    upto = F.collect_list(item).over(Window.partitionBy("profile_id").orderBy("_t", "game_id").rowsBetween(1 - last, 0))
    rows = rows.withColumn("_upto", F.struct("_t", "game_id", upto.alias("games")))
    latest = F.max("_upto").over(Window.partitionBy("profile_id").orderBy("_t").rangeBetween(W.START, -1))["games"]
    return rows.withColumn("recent", F.reverse(F.coalesce(latest, F.array()))).drop("_upto", "_t")


def _own_history(raw: DataFrame, rows: DataFrame, days: int = 30) -> DataFrame:
    """Candidate rows with counts of the player's own earlier games with that option.

    Candidates and games go through one sort by player, option and time: a
    candidate row adds nothing to the sums and sees all games at earlier times.
    """
    keys = ["profile_id", "candidate_civ"]
    probe = rows.select(*keys, "game_id", "started_at", "patch", "map", F.lit(0).alias("_one"), F.lit(0).alias("result"))
    past = raw.select("profile_id", F.col("civ").alias("candidate_civ"), "game_id", "started_at", "patch", "map", F.lit(1).alias("_one"), "result")
    both = probe.unionByName(past).repartition("profile_id")
    out = _own_counts(F.col("_one"), days)
    return both.withColumns(out).filter("_one = 0").select("game_id", *keys, *out)


def _own_counts(one: Column, days: int = 30) -> dict[str, Column]:
    """Counts of the player's earlier rows with the candidate, as far as they are games with it (``one`` is 1)."""
    keys = ["profile_id", "candidate_civ"]
    spans = {"lifetime": W.earlier_time(*keys), "30d": W.within_days(days, *keys), "this_patch": W.earlier_time(*keys, "patch"), "this_map": W.earlier_time(*keys, "map")}
    out = {f"cand_games_{x}": W.sum_over(one, w) for x, w in spans.items()} | {f"cand_wins_{x}": W.sum_over(F.when(one == 1, F.col("result")), w) for x, w in spans.items()}
    out["days_since_cand_civ"] = days_between(F.max(F.when(one == 1, F.col("started_at"))).over(spans["lifetime"]), "started_at")
    return out


#: Families of a candidate row's features.
FAMILIES = ("own", "recent", "global")
TOPS = (1, 2, 3, 5, 10, 20)


def _game_sequence(rows: DataFrame) -> DataFrame:
    """What the last games in ``recent`` tell of the player, whatever the candidate."""
    rows = rows.withColumn("_ten", F.transform(F.slice("recent", 1, 10), lambda x: x["civ"]))
    older = F.slice("_ten", 2, 10)
    changes = F.zip_with(F.slice("_ten", F.lit(1), F.greatest(F.size("_ten") - 1, F.lit(0))), older, lambda x, y: x != y)
    kinds = F.array_distinct("_ten")
    share = lambda c: F.size(F.filter("_ten", lambda x: x == c)) / F.size("_ten")
    entropy = F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - share(c) * F.ln(share(c)))
    return rows.withColumns(
        {
            "recent_civ_switch_count_last_10_games": F.size(F.filter(changes, lambda z: z)).cast("long"),
            "recent_unique_civs_last_10_games": F.size(kinds).cast("long"),
            "recent_entropy_last_10_games": F.when(F.size("_ten") > 0, entropy).otherwise(0.0),
            "player_games_last_20_same_map": seen(lambda x: x["map"] == F.col("map"), array="recent"),
        }
    ).drop("_ten")


def _with_game_sequence(raw: DataFrame, dealt: bool = False) -> DataFrame:
    return _game_sequence(with_recent(raw, dealt=dealt))


def backfill_sequences(matrix: DataFrame, raw: DataFrame, last: int = 20) -> DataFrame:
    """A matrix of older rows with the sequence columns added (or replaced), without building it anew.

    ``matrix`` has game_id, profile_id, candidate_civ, started_at and map.  The
    player's games at earlier times count; streaks are those of the last
    ``last`` games.  Global rates that such a matrix lacks are uniform.
    """
    columns = ["profile_id", "started_at", "_upto"]
    item = F.struct("started_at", "game_id", "civ", "map")
    own = raw.join(matrix.select("profile_id").distinct(), "profile_id", "left_semi")
    upto = F.collect_list(item).over(W.ordered("profile_id").rowsBetween(1 - last, 0))
    past = own.withColumn("_upto", F.struct("started_at", "game_id", upto.alias("games"))).select(*columns, F.lit(None).cast("long").alias("game_id"), F.lit(None).cast("string").alias("map"))
    asked = matrix.select("profile_id", "started_at", F.lit(None).cast(past.schema["_upto"].dataType).alias("_upto"), "game_id", "map").distinct()
    latest = F.max("_upto").over(W.earlier_time("profile_id"))["games"]
    both = past.unionByName(asked).withColumn("recent", F.reverse(F.coalesce(latest, F.array()))).filter("game_id IS NOT NULL")
    known = _game_sequence(both.drop("_upto"))
    first = F.get("recent", F.lit(0))["civ"]
    ends = F.array_min(F.transform("recent", lambda x, i: F.when(x["civ"] != first, i)))
    known = known.withColumns({"_newest": first, "player_current_streak_len": F.coalesce(ends, F.size("recent")).cast("long")}).drop("map")
    added = [x for x in known.columns if x not in ("profile_id", "started_at", "game_id")]
    rows = matrix.drop(*[x for x in SEQUENCE if x in matrix.columns]).join(known.select("game_id", "profile_id", "started_at", *added), ["game_id", "profile_id", "started_at"], "left")
    rows = _with_candidate_sequence(rows).withColumn("candidate_current_streak_len", F.when(F.col("candidate_civ") == F.col("_newest"), F.col("player_current_streak_len")).otherwise(F.lit(0).cast("long"))).drop("_newest")
    missing = [x for x in ("cand_global_pr_patch_mmr_bucket", "cand_global_pr_map_patch") if x not in rows.columns]
    return rows.withColumns({x: F.lit(UNIFORM) for x in missing})


SEQUENCE = [
    *[f"cand_games_last_{n}_games" for n in TOPS], "candidate_last_played_position", "cand_games_last_20_same_map", "player_games_last_20_same_map", "player_current_streak_len", "candidate_current_streak_len",
    "recent_civ_switch_count_last_10_games", "recent_unique_civs_last_10_games", "recent_entropy_last_10_games",
]


def _with_candidate_sequence(rows: DataFrame) -> DataFrame:
    civs = F.transform("recent", lambda x: x["civ"])
    place = F.array_position(civs, F.col("candidate_civ")).cast("long")
    hit = lambda n: F.size(F.filter(F.slice("recent", 1, n), lambda x: x["civ"] == F.col("candidate_civ"))).cast("long")
    out = {f"cand_games_last_{n}_games": hit(n) for n in TOPS} | {
        "candidate_last_played_position": F.when(place > 0, place).otherwise(F.lit(21).cast("long")),
        "cand_games_last_20_same_map": seen(lambda x: (x["map"] == F.col("map")) & (x["civ"] == F.col("candidate_civ")), array="recent"),
    }
    return rows.withColumns(out).drop("recent")


def training_matrix(raw: DataFrame, seen_at: DataFrame, seasons: list[int] | None = None, sample: Column | None = None, families: tuple[str, ...] = FAMILIES, dealt: bool = False) -> DataFrame:
    """One row for each sampled game and option known by then, with the option's histories.

    Only the families asked for are computed: "own" (the player's earlier games
    with the option), "recent" (the last 20 games) and "global" (pick rates of
    all players).  ``dealt`` says that rows are dealt by player already, as
    those of ``raw_games`` are.  With all games as candidates, a player's games
    with an option are among the candidate rows, which stay with the player.
    """
    base = with_player_counts(raw, dealt=dealt) if "own" in families else raw
    base = _with_game_sequence(base, dealt or "own" in families) if "recent" in families else base
    whole = "own" in families and seasons is None and sample is None
    if whole:
        options = as_dimension(seen_at.select(F.col("civ").alias("candidate_civ"), F.col("first_seen_at").alias("_since")))
        known, own = F.col("_since") <= F.col("started_at"), F.col("candidate_civ") == F.col("chosen_civ")
        rows = base.withColumnRenamed("civ", "chosen_civ").dropna(subset=GROUP).join(options, known | own).withColumn("target", F.when(own, 1).otherwise(0))
    else:
        rows = candidates(base, seen_at, seasons, sample)
    rows = rows.withColumns(
        {
            "player_current_streak_len": F.col("prev_civ_streak_len"),
            "candidate_current_streak_len": F.when(F.col("candidate_civ") == F.col("prev_civ"), F.col("prev_civ_streak_len")).otherwise(0),
        }
    )
    if "recent" in families:
        rows = _with_candidate_sequence(rows)
    if whole:
        counts = _own_counts(F.col("target"))
        rows = rows.withColumns(counts).filter(known).drop("_since")
        rows = rows.select(*GROUP, "candidate_civ", *[x for x in rows.columns if x not in (*GROUP, "candidate_civ")])
    elif "own" in families:
        rows = rows.join(_own_history(raw, rows), [*GROUP, "candidate_civ"])
    return _with_global_rates(raw, rows) if "global" in families else rows


def _with_global_rates(raw: DataFrame, rows: DataFrame) -> DataFrame:
    by_season, by_patch = pick_rates(raw, "season"), previous_rates(pick_rates(raw, "patch"), "patch")
    last_season = by_season.select((F.col("season") + 1).alias("season"), F.col("civ").alias("candidate_civ"), F.col("pick_rate").alias("cand_global_pr_prev_season"))
    last_patch = by_patch.select("patch", F.col("civ").alias("candidate_civ"), F.col("pick_rate").alias("cand_global_pr_prev_patch"))
    bucketed, rows = (x.withColumn("mmr_bucket", tier("mmr")) for x in (raw, rows))
    rows = rows.join(as_dimension(last_season), ["season", "candidate_civ"], "left").join(as_dimension(last_patch), ["patch", "candidate_civ"], "left")
    rows = with_rate_before(rows, bucketed, ["patch", "mmr_bucket"], "cand_global_pr_patch_mmr_bucket")
    rows = with_rate_before(rows, raw, ["map", "patch"], "cand_global_pr_map_patch")
    return rows.na.fill(UNIFORM, [f"cand_global_pr_{x}" for x in ("prev_season", "prev_patch", "patch_mmr_bucket", "map_patch")])


def derived(matrix: DataFrame) -> DataFrame:
    """Smoothed shares and rates, flags, dense ranks, entropies and pool sizes within each player's game."""
    group = Window.partitionBy(*GROUP)
    share = lambda x: smooth_share(f"cand_games_{x}", f"player_games_{x}", UNIFORM, SHARE_SMOOTHING)
    spans = ("lifetime", "30d", "this_patch", "this_map")
    out = matrix.withColumns({f"cand_pick_share_{x}": share(x) for x in spans} | {f"cand_wr_{x}": smooth(f"cand_wins_{x}", f"cand_games_{x}", SHARE_SMOOTHING) for x in spans})
    total = F.sum("cand_games_last_20_games").over(group)
    out = out.withColumn("cand_pick_share_last_20_games", F.when(total > 0, F.col("cand_games_last_20_games") / total).otherwise(0.0))
    last = F.col("candidate_civ") == F.coalesce("prev_civ", F.lit(""))
    rank = lambda x: F.dense_rank().over(group.orderBy(F.desc(f"cand_games_{x}")))
    ranks = {"lifetime": "lifetime", "30d": "30d", "this_patch": "this_patch", "last_20_games": "last_20_games"}
    out = out.withColumns(
        {
            "cand_recent_vs_lifetime_pick_share_delta": F.col("cand_pick_share_last_20_games") - F.col("cand_pick_share_lifetime"),
            "cand_pick_share_last_20_same_map": F.when(F.col("player_games_last_20_same_map") > 0, F.col("cand_games_last_20_same_map") / F.col("player_games_last_20_same_map")).otherwise(0.0),
            "candidate_is_last_civ": flag(last),
            "candidate_is_in_pool_lifetime": flag(F.col("cand_games_lifetime") > 0),
            "candidate_is_in_pool_30d": flag(F.col("cand_games_30d") > 0),
            **{f"candidate_played_last_{n}": flag(F.col(f"cand_games_last_{n}_games") > 0) for n in (1, 2, 3, 5)},
            "candidate_breaks_current_streak": flag((F.col("player_current_streak_len") > 0) & ~last),
            **{f"candidate_civ_rank_{x}": rank(y) for x, y in ranks.items()},
        }
    )
    mains = {"candidate_is_lifetime_main": "lifetime", "candidate_is_recent_30d_main": "30d", "candidate_is_patch_main": "this_patch"}
    place = F.when(F.col("cand_games_last_20_games") > 0, F.col("candidate_civ_rank_last_20_games"))
    entropies = {}
    for x in ("lifetime", "30d"):
        p = F.col(f"cand_pick_share_{x}") / F.sum(f"cand_pick_share_{x}").over(group)
        entropies[f"_e_{x}"] = F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    out = out.withColumns({k: flag(F.col(f"candidate_civ_rank_{x}") == 1) for k, x in mains.items()} | {f"candidate_is_top{n}_last_20_games": flag(place == n) for n in (1, 2, 3)} | entropies)
    return out.withColumns(
        {
            **{f"civ_pool_entropy_{x}": F.sum(f"_e_{x}").over(group) for x in ("lifetime", "30d")},
            **{f"num_civs_played_{x}": F.sum(flag(F.col(f"cand_games_{x}") > 0)).over(group) for x in ("lifetime", "30d", "this_patch")},
            **{f"main_civ_share_{x}": F.max(f"cand_pick_share_{x}").over(group) for x in ("lifetime", "30d")},
        }
    ).drop("_e_lifetime", "_e_30d")


# The anonymous variant: no history of the player who picks.

FORBIDDEN = ["cand_games_lifetime", "cand_wins_lifetime", "cand_pick_share_lifetime", "cand_games_30d", "cand_pick_share_30d", "candidate_is_last_civ", "candidate_last_played_position", "player_games_lifetime", "player_games_30d", "civ_pool_entropy_30d", "main_civ_share_lifetime"]
DIMENSIONS = {"global": [], "mmr_bucket": ["mmr_bucket"], "rating_bucket": ["rating_bucket"], "map": ["map"], "map_patch": ["map", "patch"], "patch": ["patch"]}


def anonymous_games(games: DataFrame, participants: DataFrame) -> DataFrame:
    rows = player_games(games, participants).filter("civ IS NOT NULL AND NOT coalesce(civilization_randomized, false)")
    unknown = lambda x: F.coalesce(F.col(x), F.lit("unknown")).alias(x)
    return rows.select("game_id", "profile_id", "civ", "result", "mmr", "rating", tier("mmr").alias("mmr_bucket"), tier("rating").alias("rating_bucket"), "started_at", "season", unknown("patch"), unknown("map"), F.to_date("started_at").alias("day"))


def counts_before_day(rows: DataFrame, keys: list[str], days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of (keys, civ) and of (keys) on earlier days, for each of ``days`` and each value: a full grid of days and values."""

    def cumulative(by: list[str], name: str) -> DataFrame:
        daily = rows.groupBy("day", *by).agg(F.count("*").alias("n"))
        asked = days.crossJoin(as_dimension(daily.select(*by).distinct())) if by else days  # days x values of the dimension
        full = asked.select("day", *by).distinct().join(daily, ["day", *by], "full_outer").na.fill(0, ["n"])
        w = Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(W.START, -1)
        return full.select("day", *by, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(name))

    return cumulative([*keys, "civ"], "cand_count"), cumulative(keys, "total_count")


def anonymous_matrix(rows: DataFrame, seen_at: DataFrame, seasons: list[int] | None = None, dimensions: list[str] | None = None) -> DataFrame:
    """Candidate rows with counts before the day, by each dimension.

    All dimensions roll up one daily aggregate, and are asked only for the days
    and values that candidate rows have.
    """
    chosen = rows if seasons is None else rows.filter(F.col("season").isin(seasons))
    out = expand_candidates(chosen.withColumnRenamed("civ", "chosen_civ"), seen_at, "chosen_civ")
    used = dimensions or list(DIMENSIONS)
    every = sorted({k for x in used for k in DIMENSIONS[x]})
    daily = rows.groupBy("day", *every, "civ").agg(F.count("*").alias("n")).withColumnRenamed("civ", "candidate_civ")
    asked = out.select("day", *every, "candidate_civ").distinct()
    for name in used:
        for keys, column in (([*DIMENSIONS[name], "candidate_civ"], f"cand_{name}_count"), (DIMENSIONS[name], f"{name}_total")):
            known = _days_before(daily, asked, keys, column)
            out = out.join(known, ["day", *keys], "left").na.fill(0, [column])
    return out


def _days_before(daily: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(day, keys, name): the counts of earlier days, for each (day, keys) that is asked for."""
    zero = F.lit(0).cast("long").alias("n")
    both = daily.groupBy("day", *keys).agg(F.sum("n").alias("n"), F.lit(0).alias("_asked")).unionByName(asked.select("day", *keys).distinct().select("day", *keys, zero, F.lit(1).alias("_asked")))
    by_day = both.groupBy("day", *keys).agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rowsBetween(W.START, -1)
    return by_day.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0))).filter("_asked = 1").select("day", *keys, name)


def user_recent(rows: DataFrame, candidate_rows: DataFrame, user: int) -> DataFrame:
    """Per candidate row of the watched user's games: how often recent opponents picked the option."""
    own = rows.filter(F.col("profile_id") == user).select("game_id", "started_at", F.col("profile_id").alias("user_id"))
    faced = own.join(rows.select("game_id", "profile_id", F.col("civ").alias("opponent_civ"), "map"), "game_id").filter("profile_id <> user_id")
    numbered = faced.withColumns({"num": F.row_number().over(Window.partitionBy("user_id").orderBy("started_at", "game_id"))})
    past = numbered.withColumn("past", F.collect_list(F.struct("num", "opponent_civ", F.col("map").alias("m"))).over(Window.partitionBy("user_id").orderBy("num").rowsBetween(-50, -1)))
    both = candidate_rows.join(past.select("game_id", "num", "past"), "game_id")
    since = lambda n: lambda x: x["num"] >= F.col("num") - n
    both_of = lambda f, g: lambda x: f(x) & g(x)
    civ, place = (lambda x: x["opponent_civ"] == F.col("candidate_civ")), (lambda x: x["m"] == F.col("map"))
    out = {}
    for n in (10, 30, 50):
        out[f"cand_count_{n}"] = seen(both_of(since(n), civ), array="past")
        out[f"total_{n}"] = seen(since(n), array="past")
    out["cand_same_map_30"] = seen(lambda x: since(30)(x) & place(x) & civ(x), array="past")
    out["total_same_map_30"] = seen(lambda x: since(30)(x) & place(x), array="past")
    return both.select(*GROUP, "candidate_civ", *[x.alias(name) for name, x in out.items()])


def anonymous_derived(matrix: DataFrame) -> DataFrame:
    """Shares smoothed along a hierarchy: global, then bucket, map or patch, then map and patch."""
    forbid_columns(matrix, FORBIDDEN)
    base = F.when(F.col("global_total") > 0, F.col("cand_global_count") / F.col("global_total")).otherwise(UNIFORM)
    out = matrix.withColumn("cand_global_pr_prior", base)
    of = lambda x, prior: smooth_share(f"cand_{x}_count", f"{x}_total", F.col(prior), ANONYMOUS_SMOOTHING)
    out = out.withColumns({f"cand_global_pr_{x}": of(x, "cand_global_pr_prior") for x in ("mmr_bucket", "rating_bucket", "map", "patch")})
    return out.withColumn("cand_global_pr_map_patch", of("map_patch", "cand_global_pr_map"))


BASELINES = ["p_global", "p_mmr_tier", "p_map_patch"]
UNSEEN = 1e-6


def anonymous_baselines(train: DataFrame, candidate_rows: DataFrame, recent: str | None = None) -> DataFrame:
    """Candidate rows with baseline chances: rates of the picks in ``train``, overall, by skill tier, and by map and patch.

    A rate that ``train`` lacks falls back: map and patch to map, then to the
    overall rate, and that to ``UNSEEN``.  ``recent`` names a column with the
    part of recent opponents that picked the option; ``p_recent_meta`` is that
    where it is over 0, else the tier's rate.
    """

    def rates(keys: list[str], name: str) -> DataFrame:
        counts = train.groupBy(*keys, F.col("civ").alias("candidate_civ")).agg(F.count("*").alias("n"))
        total = train.groupBy(*keys).agg(F.count("*").alias("t"))
        both = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # total is one row
        return as_dimension(both.select(*keys, "candidate_civ", ratio("n", "t").alias(name)))

    out = candidate_rows
    for name, keys in {"_all": [], "_tier": ["mmr_bucket"], "_map": ["map"], "_map_patch": ["map", "patch"]}.items():
        out = out.join(rates(keys, name), [*keys, "candidate_civ"], "left")
    overall = F.coalesce("_all", F.lit(UNSEEN))
    tier_rate = F.coalesce("_tier", overall)
    made = {"p_global": overall, "p_mmr_tier": tier_rate, "p_map_patch": F.coalesce("_map_patch", "_map", overall)}
    if recent is not None:
        made["p_recent_meta"] = F.when(F.col(recent) > 0, F.col(recent).cast("double")).otherwise(tier_rate)
    return out.withColumns(made).drop("_all", "_tier", "_map", "_map_patch")
