"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1.  Each input partition permutes its own rows at random and is written, so
    that partition and place of a row are fixed whatever happens later.
2.  How many rows each partition sends to each shard is drawn exactly: the rows
    of the matrix are multivariate hypergeometric given the shards' sizes.  The
    driver draws it for at most ``GROUPS`` groups of partitions; each group then
    draws its own partitions' rows in a task of its own.
3.  A row's place in its partition decides its shard; rows are exchanged.
4.  Within a shard rows are permuted again: by a random key, cut into cells of
    bounded size, so that no task sorts a whole shard.

The law is ``rows``: shard sizes differ by one at most.  Every assignment of
rows to places has the same probability.  Rows are told apart by place, so
repeated rows, equal texts, null ids and null texts (16 bytes) need no care; a
table without rows gives none.  Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

GROUPS = 1024
CELL = 65_536  # rows that are sorted together
SEED = 20240229
MATRIX_ROWS = 20_000  # partitions whose matrix rows may be broadcast


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the larger ones come first."""
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], dtype=np.int64)


def split_exactly(counts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random matrix with row sums ``counts`` and column sums ``sizes``, as a uniform shuffle would give it."""
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest, pool = int(n), int(left.sum())
        for j in range(len(sizes)):  # one column after the other, given those before
            if rest == 0:
                break
            pool -= int(left[j])
            out[i, j] = _hypergeometric(rng, int(left[j]), pool, rest)
            rest -= int(out[i, j])
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad.

    numpy's own generator ends at 10**9; beyond it the distribution is inverted
    over 12 standard deviations around its mode (all but 1e-30 of it).
    """
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    spread = (draws / total * good * (bad / total) * (1 - draws / total)) ** 0.5
    low, high = max(0, draws - bad), min(draws, good)
    mode = (draws + 1) * (good + 1) // (total + 2)
    low, high = max(low, mode - int(12 * spread) - 2), min(high, mode + int(12 * spread) + 2)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _matrix(placed: DataFrame, shards: int) -> tuple[DataFrame, int, int]:
    """For each partition the running totals of what it sends to the shards; rows and partitions in all."""
    spark = placed.sparkSession
    counts = written(placed.groupBy("part").agg(F.count("*").alias("n")), "counts")
    grouped = counts.withColumn("g", F.pmod("part", F.lit(GROUPS)))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).orderBy("g").toPandas()
    rows = int(groups["n"].sum()) if len(groups) else 0
    drawn = split_exactly(groups["n"].to_numpy(np.int64), shard_sizes(rows, shards), np.random.default_rng(SEED)) if rows else np.zeros((0, shards), np.int64)
    budget = spark.createDataFrame(pd.DataFrame({"g": groups["g"].astype("int64"), "sizes": [x.tolist() for x in drawn]}), "g long, sizes array<long>")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        rng = np.random.default_rng([SEED, int(frame["g"].iloc[0])])
        own = split_exactly(frame["n"].to_numpy(np.int64), np.array(frame["sizes"].iloc[0], dtype=np.int64), rng)
        return pd.DataFrame({"part": frame["part"], "upto": np.cumsum(own, axis=1).tolist()})

    joined = grouped.withColumn("g", F.col("g").cast("long")).join(F.broadcast(budget), "g")  # GROUPS rows at most
    matrix = joined.groupBy("g").applyInPandas(each, "part long, upto array<long>")
    return written(matrix, "matrix"), rows, int(groups["parts"].sum()) if len(groups) else 0


def shard_rows(df: DataFrame, shards: int) -> DataFrame:
    """The rows of ``df`` as a struct ``row``, with ``shard`` and ``slot``."""
    drawn = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(F.monotonically_increasing_id(), F.lit(SEED)).alias("key"))
    local = drawn.sortWithinPartitions("key").select("row", F.monotonically_increasing_id().alias("at"))
    placed = written(local.select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(2**33 - 1).alias("place")), "placed")
    matrix, rows, parts = _matrix(placed.select("part"), shards)
    sent = placed.join(small(matrix, parts, MATRIX_ROWS), "part")
    sent = sent.select("row", F.size(F.filter("upto", lambda x: x <= F.col("place"))).alias("shard"), F.xxhash64("part", "place", F.lit(SEED + 1)).alias("key"), "part", "place")
    bits = max(0, (rows // max(1, shards * CELL)).bit_length())
    if not bits:
        order = Window.partitionBy("shard").orderBy("key", "part", "place")
        return sent.select("row", "shard", (F.row_number().over(order) - 1).cast("long").alias("slot"))
    sent = sent.withColumn("cell", F.shiftrightunsigned("key", 64 - bits))
    sizes = sent.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sizes.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start")), "starts")
    order = Window.partitionBy("shard", "cell").orderBy("key", "part", "place")
    ranked = sent.select("row", "shard", "cell", (F.row_number().over(order) - 1).alias("rank"))
    return ranked.join(small(starts), ["shard", "cell"]).select("row", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with shard and slot; columns of these names that it has already become ``shard_before`` and ``slot_before``, with more ``_`` if need be."""
    taken, names = set(docs.columns), []
    for x in docs.columns:
        if x in ("shard", "slot"):
            x = f"{x}_before"
            while x in taken:
                x += "_"
        names.append(x)
        taken.add(x)
    return shard_rows(docs.toDF(*names), shards).select("row.*", "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = shard_rows(narrow, shards).select("row.*", "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """One folder ``shard=i`` for each shard, its files in the order of the slots."""
    out = shard_documents(docs, shards)
    spread = out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.mode("overwrite").partitionBy("shard").parquet(path)

