"""Splits in time, samples, slot swaps, unions and top lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import checkpointed
from ..functions.exprs import stable_hash

VALID, TEST = 0.15, 0.15


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``pos``: the place of each row in a total order, and ``total``.

    Rows are counted by range partition first, so that no task sorts them all.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = spread.withColumn("_at", F.monotonically_increasing_id())
    keyed = numbered.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(2**33 - 1)}).drop("_at")
    keyed = checkpointed(keyed)  # range partitions are sampled anew otherwise
    counts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts, total = [], 0
    for row in counts.orderBy("_part").collect():  # a row for each partition
        starts.append((row["_part"], total))
        total += row["_n"]
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return keyed.join(F.broadcast(first), "_part").withColumns({"pos": F.col("_start") + F.col("_in"), "total": F.lit(total).cast("long")}).drop("_part", "_in", "_start")


def split_of(pos: Column, total: Column, valid: float = VALID, test: float = TEST) -> Column:
    """train, valid or test by place: the last part is tested, the part before it validates."""
    n_test, n_valid = F.floor(total * test), F.floor(total * valid)
    return F.when(pos >= total - n_test, "test").when(pos >= total - n_test - n_valid, "valid").otherwise("train")


def temporal_split(df: DataFrame, order: Iterable[str] = ("started_at", "game_id"), valid: float = VALID, test: float = TEST) -> DataFrame:
    placed = positions(df, list(order))
    return placed.withColumn("split", split_of(F.col("pos"), F.col("total"), valid, test)).drop("pos", "total")


def group_split(df: DataFrame, group: list[str], order: str = "started_at", valid: float = VALID, test: float = TEST) -> DataFrame:
    """A split of distinct groups in time; a group's rows stay together."""
    groups = df.groupBy(*group).agg(F.min(order).alias("_at"))
    return df.join(temporal_split(groups, ["_at", *group], valid, test).drop("_at"), group)


def group_split_in_place(df: DataFrame, group: list[str], order: str = "started_at", valid: float = VALID, test: float = TEST) -> DataFrame:
    """``group_split`` where all rows of a group have one ``order``: rows are told apart by the first group of each part, and stay where they are."""
    groups = df.dropna(subset=group).groupBy(*group).agg(F.min(order).alias("_begun"))
    placed = temporal_split(groups, ["_begun", *group], valid, test)
    first = lambda part: F.min(F.when(F.col("split") == part, F.struct("_begun", *group))).alias(f"_{part}")
    key = F.struct(F.col(order).alias("_begun"), *group)
    split = F.when(key >= F.col("_test"), "test").when(key >= F.col("_valid"), "valid").otherwise("train")
    return df.dropna(subset=group).crossJoin(F.broadcast(placed.agg(first("valid"), first("test")))).withColumn("split", split).drop("_valid", "_test")  # one row


def season_holdout(df: DataFrame, held: list[int], valid: float = VALID) -> DataFrame:
    """Held-out seasons test; the latest part of the others validates."""
    rest = temporal_split(df.filter(~F.col("season").isin(held)), valid=valid, test=0.0)
    return rest.unionByName(df.filter(F.col("season").isin(held)).withColumn("split", F.lit("test")))


def evenly_spaced(df: DataFrame, n: int, by: str) -> DataFrame:
    """``n`` rows at even distances in order of ``by``, the first and the last among them."""
    placed = positions(df, [by])
    step = (F.col("total") - 1) / F.lit(max(n - 1, 1))
    index = F.round(F.col("pos") / F.greatest(step, F.lit(1e-9)))
    chosen = (F.col("total") <= n) | ((index < n) & (F.floor(index * step + 0.5) == F.col("pos")))
    return placed.filter(chosen).drop("pos", "total")


def hash_sample(df: DataFrame, key: str, parts: int = 10, keep: int = 2) -> DataFrame:
    """A repeatable sample of keys."""
    return df.filter(stable_hash(key) % parts < keep)


def seeded_sample(df: DataFrame, key: str, part: float, seed: int) -> DataFrame:
    """About a ``part`` of the keys, drawn by a seeded hash: a rerun, on any partitioning, draws the same ones."""
    return df.filter(stable_hash(key, f"{seed}:") < F.lit(int(part * 2**48)))


def stride_sample(df: DataFrame, stride: int, order: list[str]) -> DataFrame:
    """Every n-th row in order."""
    return positions(df, order).filter(F.col("pos") % stride == 0).drop("pos", "total")


def swapped(df: DataFrame, target: str = "target", complements: Iterable[str] = ("h2h_wr_a", "prior_matchup_wr_a"), remainders: dict[str, str] | None = None, twins: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Players a and b exchanged: twin columns swap, differences change sign, rates of a become 1 - rate, counts of a the rest.

    Every antisymmetric column is covered, so that swapping twice gives the rows back.
    """
    other = {x: x[:-2] + ("_b" if x.endswith("_a") else "_a") for x in df.columns if x[-2:] in ("_a", "_b")}
    other |= {x: y for pair in twins for x, y in (pair, pair[::-1])}
    rest = {"h2h_wins_a": "h2h_games", "prior_matchup_wins": "prior_matchup_games"} if remainders is None else remainders

    def of(x: str) -> Column:
        if x == target:
            return 1 - F.col(x)
        if x in complements:
            return 1 - F.col(x)
        if x in rest and rest[x] in df.columns:
            return F.col(rest[x]) - F.col(x)
        if x.endswith("_diff"):
            return -F.col(x)
        return F.col(other[x]) if other.get(x) in df.columns else F.col(x)

    return df.select(*[of(x).alias(x) for x in df.columns])


def augmented(df: DataFrame, **options) -> DataFrame:
    """The rows and their swapped copies."""
    return df.unionByName(swapped(df, **options))


def half_swapped(df: DataFrame, key: str = "game_id", **options) -> DataFrame:
    """Rows, about half of them swapped, by a hash of the key."""
    coin = stable_hash(key, "swap:") % 2 == 1
    return df.filter(~coin).unionByName(swapped(df.filter(coin), **options))


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first rows in an order (no full sort)."""
    return df.orderBy(*order).limit(n)


def top_or_other(df: DataFrame, column: str, n: int, other: str = "other") -> DataFrame:
    """The n most frequent values; the rest as ``other``."""
    best = df.groupBy(column).agg(F.count("*").alias("c")).filter(F.col(column).isNotNull()).orderBy(F.desc("c"), column).limit(n)
    names = [r[0] for r in best.select(column).collect()]
    return df.withColumn(column, F.when(F.col(column).isin(names), F.col(column)).otherwise(other))


def first_in_group(df: DataFrame, group: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_r = 1").drop("_r")
