"""Join operators: ordered pairs, opponents, as-of lookups, capped histories, candidates, idempotent inserts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ORDER, ordered

#: Rows of a small dimension (civilisations, maps, patches) that may be broadcast.
DIMENSION_ROWS = 10_000


def as_dimension(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it proves to have few rows; otherwise leave the choice to the optimizer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pair_up(players: DataFrame, columns: Iterable[str], key: str = "game_id", by: str = "profile_id", shared: Iterable[str] = ()) -> DataFrame:
    """One row for each match: the lower id's columns with ``_a``, the higher one's with ``_b``.

    A match's rows meet in one aggregation by match (one shuffle); rows of more
    than two players give each ordered pair, as a self-join would.
    """
    columns, shared = list(columns), list(shared)
    side = F.struct(F.col(by), *[F.col(x) for x in columns])
    grouped = players.groupBy(key, *shared).agg(F.sort_array(F.collect_list(side)).alias("_p"))
    firsts = F.transform("_p", lambda a, i: F.transform(F.filter("_p", lambda b: b[by] > a[by]), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = grouped.select(key, *shared, F.explode(F.flatten(firsts)).alias("_q"))
    return pairs.select(key, *shared, *[F.col(f"_q.{s}.{x}").alias(f"{x}_{s}") for s in ("a", "b") for x in [by, *columns]])


def with_opponents(players: DataFrame, columns: Iterable[str], key: str = "game_id", by: str = "profile_id") -> DataFrame:
    """Each player's row with every other player of the match (``opponent_`` columns)."""
    other = players.select(key, *[F.col(x).alias(f"opponent_{x}") for x in [by, *columns]])
    return players.join(other, key).filter(F.col(by) != F.col(f"opponent_{by}"))


def join_roles(df: DataFrame, side: DataFrame, columns: Iterable[str], key: str = "game_id", by: str = "profile_id") -> DataFrame:
    """Two left joins of one table, for the ``_a`` and the ``_b`` player."""
    columns = list(columns)
    for s in ("a", "b"):
        role = side.select(key, F.col(by).alias(f"{by}_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in columns])
        df = df.join(role, [key, f"{by}_{s}"], "left")
    return df


def asof_join(probes: DataFrame, history: DataFrame, keys: list[str], columns: list[str], at: str = "started_at", tie: str = "game_id", inclusive: bool = False) -> DataFrame:
    """Left as-of join: the latest history row of the same keys at an earlier time (with ``inclusive``, not a later one).

    Probes and history go through one sort by key and time; probes come before
    history of the same time, so that equal times don't count.  No pairs are
    made, whatever the number of rows of a key.
    """
    probe = probes.select(*keys, F.col(at).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.lit(None).cast(history.schema[tie].dataType).alias("_tie"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(history.select(F.struct(*columns)).schema[0].dataType).alias("_found"))
    past = history.select(*keys, F.col(at).alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(probe.schema["_probe"].dataType).alias("_probe"), F.struct(*columns).alias("_found"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = probe.unionByName(past).withColumn("_last", F.last("_found", ignorenulls=True).over(w))
    return both.filter("_probe IS NOT NULL").select("_probe.*", *[F.col(f"_last.{x}").alias(x) for x in columns])


def latest(df: DataFrame, keys: list[str], columns: Iterable[str], order: Iterable[str] = ORDER) -> DataFrame:
    """The latest row of each key, as one aggregation."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def capped_history(players: DataFrame, cap: int, columns: Iterable[str], key: str = "profile_id") -> DataFrame:
    """Each row with ``visible``: its player's last ``cap`` earlier rows (oldest first), as an array of structs."""
    frame = ordered(key).rowsBetween(-cap, -1)
    return players.withColumn("visible", F.collect_list(F.struct(*columns)).over(frame))


def seen(condition=None, array: str = "visible") -> Column:
    """How many visible rows there are (for which the condition holds), as an int64."""
    return F.size(F.filter(array, condition) if condition else F.col(array)).cast("long")


def seen_sum(value, condition=None, array: str = "visible") -> Column:
    kept = F.filter(array, condition) if condition else F.col(array)
    return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(value(x).cast("long"), F.lit(0).cast("long")))


def seen_avg(value, condition=None, array: str = "visible") -> Column:
    kept = F.filter(array, lambda x: value(x).isNotNull() & (condition(x) if condition else F.lit(True)))
    return seen_sum(value, lambda x: value(x).isNotNull() & (condition(x) if condition else F.lit(True)), array).cast("double") / F.nullif(F.size(kept).cast("double"), F.lit(0.0))


def seen_max(value, condition=None, array: str = "visible") -> Column:
    return F.array_max(F.transform(F.filter(array, condition) if condition else F.col(array), value))


def seen_min(value, condition=None, array: str = "visible") -> Column:
    return F.array_min(F.transform(F.filter(array, condition) if condition else F.col(array), value))


def expand_candidates(rows: DataFrame, options: DataFrame, chosen: str, since: str = "first_seen_at", at: str = "started_at", name: str = "candidate_civ") -> DataFrame:
    """Rows times the options first seen by then; the options are a small dimension, checked before it is broadcast."""
    small = as_dimension(options.select(F.col("civ").alias(name), since))
    return rows.join(small, F.col(since) <= F.col(at)).drop(since).withColumn("target", F.when(F.col(chosen) == F.col(name), 1).otherwise(0))


def insert_new(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key is not there yet: an idempotent insert appends them."""
    return fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys meet, fresh values win unless they are null."""
    columns = [x for x in existing.columns if x not in keys]
    new = fresh.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in columns])
    return existing.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"_new_{x}", x).alias(x) for x in columns])


def replace_rows(existing: DataFrame, fresh: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
    """Insert or replace: fresh rows win; with ``ignore`` those that are there stay."""
    first, second = (existing, fresh) if ignore else (fresh, existing)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def override(df: DataFrame, values: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """``df`` with some columns overwritten where ``values`` has the key."""
    columns = list(columns)
    new = values.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in columns], F.lit(True).alias("_there"))
    out = df.join(new, keys, "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in df.columns])
