"""Scalar expressions: smoothing, buckets, flags, differences, ratings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ONE_V_ONE_KINDS = ["rm_1v1", "rm_solo"]
PRIOR_STRENGTH = 10.0
WIN_PRIOR = 0.5
H2H_STRENGTH = 5.0
H2H_ENOUGH = 3
NEW_PLAYER_GAMES = 10
COLD_START_BASE = 1000
COLD_START_GAP = 250
SHORT_GAME = 900
LONG_GAME = 1800
CIV_OPTIONS = 19
SHARE_SMOOTHING = 5.0
ANONYMOUS_SMOOTHING = 10.0
MICROS_A_DAY = 86_400_000_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_hash(x: Column | str, seed: str = "") -> Column:
    """48 bits of a digest of ``x`` as text: the same on every engine and version."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), col(x).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def zero(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(0))


def flag(condition: Column) -> Column:
    """1 where true, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def smooth(wins: Column | str, games: Column | str, strength: float = PRIOR_STRENGTH, prior: float = WIN_PRIOR) -> Column:
    """A rate drawn towards a prior; null counts are 0."""
    return (zero(wins) + F.lit(strength * prior)) / (zero(games) + F.lit(strength))


def smooth_share(count: Column | str, total: Column | str, prior: Column | float, strength: float = ANONYMOUS_SMOOTHING) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (col(count) + F.lit(strength) * prior) / (col(total) + F.lit(strength))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double, null where b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def skill(mmr: Column | str = "mmr", rating: Column | str = "rating") -> Column:
    return F.coalesce(col(mmr), col(rating))


def tier(x: Column | str) -> Column:
    """unknown, low (under 1000), mid (under 1400) or high."""
    x = col(x)
    return F.when(x.isNull(), "unknown").when(x < 1000, "low").when(x < 1400, "mid").otherwise("high")


def civ_option(civ: Column | str = "civilization", randomized: Column | str = "civilization_randomized") -> Column:
    """The civilisation, or ``random_civ`` for a random pick."""
    return F.when(col(randomized), "random_civ").otherwise(col(civ))


def micros(x: Column | str) -> Column:
    return F.unix_micros(col(x).cast("timestamp"))


def day_number(x: Column | str) -> Column:
    return F.unix_date(F.to_date(col(x)))


def days_between(earlier: Column | str, later: Column | str) -> Column:
    """Midnights between two times."""
    return F.datediff(F.to_date(col(later)), F.to_date(col(earlier))).cast("long")


def cut(x: Column | str, edges: Iterable[float], labels: Iterable[str], right: bool = False, lowest: bool = True) -> Column:
    """Buckets between neighbouring edges: [a, b), or with ``right`` (a, b] and the least edge included if ``lowest``."""
    x, edges, labels = col(x), list(edges), list(labels)
    out = None
    for k, name in enumerate(labels):
        a, b = edges[k], edges[k + 1]
        inside = (x > a) & (x <= b) if right else (x >= a) & (x < b)
        if right and lowest and k == 0:
            inside = (x >= a) & (x <= b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def round_half_away(x: Column | str) -> Column:
    return F.round(col(x)).cast("long")


def elo_expected(own: Column | str, other: Column | str, spread: float | Column = 400.0) -> Column:
    spread = spread if isinstance(spread, Column) else F.lit(float(spread))
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (col(other) - col(own)) / spread))


def elo_delta(own: Column | str, other: Column | str, result: Column | str, k: float | Column = 32.0, spread: float | Column = 400.0) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return k * (col(result) - elo_expected(own, other, spread))


def piecewise_intercept(games: Column | str, first: int, second: int, a: float, b: float, c: float, rate: float | None = None) -> Column:
    """Linear from a to b until ``first`` games (exponential with ``rate``), b until ``second``, then c."""
    n = col(games).cast("double")
    early = F.lit(a) + F.lit(b - a) * n / F.lit(float(first)) if rate is None else F.lit(b) + F.lit(a - b) * F.exp(-n * F.lit(rate))
    return F.when(n < first, early).when(n < second, F.lit(b)).otherwise(F.lit(c))


def cold_start(df: DataFrame, mmr: str = "mmr", rating: str = "rating") -> DataFrame:
    """Fill missing skills of a pair: both missing, the base; one missing, the opponent's less a gap; with how it was done."""
    a, b = skill(f"{mmr}_a", f"{rating}_a"), skill(f"{mmr}_b", f"{rating}_b")
    near = lambda x: F.round(x - COLD_START_GAP)
    return df.withColumns(
        {
            "skill_a": F.coalesce(a, near(b), F.lit(COLD_START_BASE)).cast("double"),
            "skill_b": F.coalesce(b, near(a), F.lit(COLD_START_BASE)).cast("double"),
            "imputed": flag(a.isNull()) + flag(b.isNull()),
            "impute_method": F.when(a.isNull() & b.isNull(), "global_baseline").when(a.isNull() | b.isNull(), "opponent_aware"),
        }
    )


def token(x: Column | str) -> Column:
    """Lower case, spaces and slashes as underscores; null or empty as ``unknown``."""
    return F.when(col(x).isNull() | (col(x) == ""), "unknown").otherwise(F.regexp_replace(F.lower(col(x)), "[ /]", "_"))


def keyword_class(name: Column | str, classes: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first class one of whose keywords occurs in the name."""
    low = F.lower(F.coalesce(col(name), F.lit("")))
    out = None
    for label, words in classes:
        hit = F.lit(False)
        for word in words:
            hit |= low.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def grid_cell(x: Column, y: Column, origin: tuple[Column, Column], target: tuple[Column, Column], cells: int) -> tuple[Column, Column]:
    """Cell of a point in a frame that puts ``origin`` low and ``target`` high on the first axis."""
    (ox, oy), (tx, ty) = origin, target
    angle, size = F.atan2(ty - oy, tx - ox), F.sqrt(F.pow(tx - ox, F.lit(2.0)) + F.pow(ty - oy, F.lit(2.0)))
    u = ((x - ox) * F.cos(angle) + (y - oy) * F.sin(angle)) / F.greatest(size, F.lit(1e-9))
    v = (-(x - ox) * F.sin(angle) + (y - oy) * F.cos(angle)) / F.greatest(size, F.lit(1e-9))
    clamp = lambda z: F.least(F.greatest(F.floor(z * F.lit(float(cells))), F.lit(0)), F.lit(cells - 1)).cast("int")
    return clamp((u + 0.5) / 2), clamp((v + 1.0) / 2)


def forbid_columns(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    """``df`` itself, unless it carries a forbidden column."""
    if bad := sorted(set(forbidden) & set(df.columns)):
        raise ValueError(f"forbidden columns: {', '.join(bad)}")
    return df
