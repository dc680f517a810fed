"""Shared helpers: tables, written intermediate results, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few numbers a row) that may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000
#: Edges whose components one task finds; more are dealt out.
EDGES_AT_ONCE = 100_000
#: Bytes of an Arrow batch between Spark and Python; a longer row is a batch of its own.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset in local mode (tests), a folder of its own that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rankflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    The tables stay, as results may read them whenever they are used, until
    ``remove_written`` is called.  Rows of megabytes need ``at_once``, the rows
    of a row group: Parquet's writer looks at its size every hundred rows only,
    and a batch of Spark's reader holds up to 4096 rows of a group in memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", at_once) if at_once else writer).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many tables this driver has written; ``written_since`` names those that come after."""
    return len(_WRITTEN)


def written_since(mark: int) -> list[str]:
    return _WRITTEN[mark:]


def remove_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that this driver has written, all by default; for when the results that read them have been saved."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in filter(None, list(_WRITTEN) if paths is None else paths):
        path = hadoop.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN[_WRITTEN.index(name)] = ""
    if paths is None:
        _WRITTEN.clear()


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if it has at most ``most`` rows; otherwise leave it to a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def bound_batches(spark: SparkSession) -> None:
    """Give the session Arrow batches of ``BATCH_BYTES``, unless it has a limit other than Spark's own of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64MB") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, BATCH_BYTES)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, whose size is bounded."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def pieces_of(text: Column) -> Column:
    """Words between white space (\\x20, \\x09-\\x0D) as an array, and empty strings where a text begins or ends with it."""
    return F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0b\\x0c\\r]+")


def words_of(text: Column) -> Column:
    """Words between white space as an array; null or blank text gives an empty one."""
    return F.array_remove(pieces_of(text), "")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a table of edges by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            high, low = root(u), root(v)
            if high != low:
                parent[max(high, low)] = min(high, low)
    yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` on ids of type long: (node, label), label the least id reached.

    Up to ``EDGES_AT_ONCE`` edges go through one task.  More alternate large-star
    and small-star steps until the edges form stars; the number of rounds grows
    with the logarithm of the component size.  A hub only meets joins (whose
    skewed partitions Spark splits) and partial aggregates.  Each round is
    written to the shared folder.  Either way gives the same labels.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct()
    e = written(e, "cc")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is None and 0 < state["n"] <= EDGES_AT_ONCE:
            return e.coalesce(1).mapInArrow(_united, "node long, label long")
        if state == before or state["n"] == 0:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u")
        small_star = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small_star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
