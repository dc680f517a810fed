"""MinHash near-duplicate detection with an LSH forest.

1.  Each text becomes its set of k-word shingles (64-bit hashes) and a MinHash
    signature.  Texts of equal sets form one class; only classes go on.
2.  The forest: several orders (permutations) of the signature's hashes.  For
    each, the classes are sorted by the reordered signature; every class meets
    its neighbours on both sides with the longest common prefix, at most
    ``WINDOW`` places away and with ``MIN_DEPTH`` values in common, also over
    the borders of sorted partitions.
3.  Candidates with too low an estimate (four standard deviations under the
    threshold) go.  In dense regions each class also meets the region's hubs
    (the classes nearest to its modal signature), which joins large groups
    early.  Links are confirmed on full shingle sets, in blocks of a bounded
    number of classes; connected components give groups.
4.  Depth adapts to the region.  A region of at most ``WINDOW`` + 1 classes with
    ``MIN_DEPTH`` common values has had all its pairs compared by then.  Denser
    ones are searched whole: all pairs of different groups are compared, block
    by block within a task, first by signatures, which tells families of
    regions that hang together, then by full sets within those families.  Of
    the compared pairs only those that join two groups leave the task.  Pairs
    within a group need no look, so that a large group that is joined already
    costs no more than its few other neighbours.

A pair at the threshold of 0.8 shares no such prefix in any of the 16 orders
with a chance of 1e-5, and is estimated too low with one of 3e-5; no other pair
is lost.  No step emits all pairs of a group: pairs are linear in the number of
classes whatever the group sizes, and a hot prefix is cut by range partitioning
and into blocks.

Nulls, empty and blank texts have no set, link with nothing and are their own
component.  Texts with fewer than k words have one shingle.  Repeated rows give
repeated results.  A null doc_id has a component only through other rows' ids
and is never kept as the smallest.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, map_arrow, small, written
from .tokens import NON_SPACE, hash_words, shingles, text_runs

SIGNATURE = 128  # MinHash values of 16 bits
TREES = 16
DEPTH = 12
MIN_DEPTH = 3
WINDOW = 4
DENSE = 16  # classes of one label, from which on hubs are used
HUBS = 8
HUB_ROWS = 20_000  # of hubs with their signatures that may be broadcast
BLOCK = 400  # classes of each side of a block of sets
WIDE_BLOCK = 4000  # and of one of signatures alone
BLOCK_BYTES = 8_000_000  # and their sets

_RNG = np.random.default_rng(71)
_FACTORS = _RNG.integers(0, 2**31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDERS = np.stack([_RNG.permutation(SIGNATURE)[:DEPTH] for _ in range(TREES)])


def signature(elements: np.ndarray) -> np.ndarray:
    """MinHash values (their low 16 bits) of a set of 64-bit hashes."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, np.multiply.outer(_FACTORS, x[i : i + 512]).min(axis=1), out=least)
    return least.astype("<u2")


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for i, j, buf, starts in text_runs(column):
        words = hash_words(buf, starts, NON_SPACE)
        for d in range(j - i):
            yield shingles(words.hash[words.first[d] : words.first[d + 1]], k)


def _set_key(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.astype("<u8").tobytes())


def _describe(k: int):
    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, keys, signatures = [], [], []
        seen: dict[bytes, bytes] = {}
        for elements in _sets(batch.column(1), k):
            key = _set_key(elements) if len(elements) else None
            if key is not None and key not in seen:
                seen[key] = signature(elements).tobytes()
            sizes.append(len(elements))
            keys.append(key)
            signatures.append(seen[key] if key is not None else None)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n", "key", "sig"])

    return each


def _paths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """One row for each class and order: the reordered signature, as bytes that sort like it."""
    ids, values = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, SIGNATURE)
    for tree in range(TREES):
        path = np.ascontiguousarray(values[:, _ORDERS[tree]].astype(">u2"))
        yield pa.record_batch([pa.array(np.full(len(ids), tree, dtype=np.int32)), pa.array([x.tobytes() for x in path], pa.binary()), pa.array(ids)], ["tree", "path", "id"])


def _close(tree: np.ndarray, path: np.ndarray, ids: np.ndarray, part: np.ndarray, old: int) -> Iterator[pa.RecordBatch]:
    """Pairs of at most WINDOW places apart in sorted rows, with MIN_DEPTH values in common; the later one isn't among the first ``old``."""
    for w in range(1, min(WINDOW, len(ids) - 1) + 1):
        at = np.arange(max(w, old), len(ids))
        same = (tree[at] == tree[at - w]) & (path[at, : 2 * MIN_DEPTH] == path[at - w, : 2 * MIN_DEPTH]).all(axis=1)
        if old < 0:
            same &= part[at] != part[at - w]
        at = at[same]
        if len(at):
            none = pa.nulls(len(at))
            yield pa.record_batch([pa.array(np.minimum(ids[at], ids[at - w])), pa.array(np.maximum(ids[at], ids[at - w])), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int32())], NEAR)


NEAR = ["a", "b", "place", "tree", "path", "part"]
NEAR_SCHEMA = "a long, b long, place int, tree int, path binary, part int"


def _rows(batch: pa.RecordBatch, tree: int, path: int, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(tree).to_numpy(), np.frombuffer(b"".join(batch.column(path).to_pylist()), dtype=np.uint8).reshape(-1, 2 * DEPTH), batch.column(ids).to_numpy()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of near rows of a sorted partition; without b, the first and the last rows of the partition."""
    from pyspark import TaskContext

    held = (np.zeros(0, np.int32), np.zeros((0, 2 * DEPTH), np.uint8), np.zeros(0, np.int64))
    first, total = held, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = _rows(batch, 0, 1, 2)
        if total < WINDOW:
            first = tuple(np.concatenate([x, y])[:WINDOW] for x, y in zip(first, fresh, strict=True))
        total += batch.num_rows
        tree, path, ids = (np.concatenate([x, y]) for x, y in zip(held, fresh, strict=True))
        yield from _close(tree, path, ids, tree, len(held[2]))
        held = tree[-2 * WINDOW :], path[-2 * WINDOW :], ids[-2 * WINDOW :]
    edge = held if total <= 2 * WINDOW else tuple(np.concatenate([x, y[-WINDOW:]]) for x, y in zip(first, held, strict=True))
    tree, path, ids = edge
    part = np.full(len(ids), TaskContext.get().partitionId(), dtype=np.int32)
    yield pa.record_batch([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(tree, pa.int32()), pa.array([x.tobytes() for x in path], pa.binary()), pa.array(part)], NEAR)


def _over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near rows of different partitions, from the partitions' first and last rows in order."""
    found = [b for b in batches if b.num_rows]
    if found:
        parts = [_rows(b, 3, 4, 0) for b in found]
        tree, path, ids = (np.concatenate([x[k] for x in parts]) for k in range(3))
        for pairs in _close(tree, path, ids, np.concatenate([b.column(5).to_numpy() for b in found]), -1):
            yield pairs.select(["a", "b"])


def _near(paths: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of neighbours in the sorted orders."""
    order = paths.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    found = written(order.mapInArrow(_neighbours, NEAR_SCHEMA), "sorted")
    edges = found.filter("b is null").repartition(1).sortWithinPartitions("part", "place")  # 2 WINDOW rows a partition
    pairs = found.filter("b is not null").select("a", "b").unionByName(edges.mapInArrow(_over_borders, "a long, b long"))
    return written(pairs.distinct(), "near")


def _estimates(least: float):
    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, SIGNATURE) for i in (2, 3))
        score = (x == y).mean(axis=1)
        ok = pa.array(score >= least)
        yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(score.astype(np.float32)).filter(ok)], ["a", "b", "score"])

    return each


def _least(threshold: float) -> float:
    """The least estimate of a candidate: four standard deviations under the threshold."""
    return max(0.0, threshold - 4 * (threshold * (1 - threshold) / SIGNATURE) ** 0.5)


def _scored(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures do, within four standard deviations."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    return _estimated(pairs.join(side("a"), "a").join(side("b"), "b"), threshold)


def _estimated(both: DataFrame, threshold: float) -> DataFrame:
    """``_scored`` of pairs that bring their sizes (na, nb) and signatures (sa, sb)."""
    least = _least(threshold)
    both = both.filter(F.least("na", "nb") >= F.floor(threshold * F.greatest("na", "nb")))
    return map_arrow(both.select("a", "b", "sa", "sb"), _estimates(least), "a long, b long, score float")


def _labels(scored: DataFrame) -> DataFrame:
    """(a, l): candidates that hang together share a label."""
    return written(components(scored.select("a", "b")).select(F.col("node").alias("a"), F.col("label").alias("l")), "label")


def _votes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """How often each value occurs at each place of the signatures of a label."""
    place = np.arange(SIGNATURE, dtype=np.int64)
    label, values = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, SIGNATURE).astype(np.int64)
    names, which = np.unique(label, return_inverse=True)
    found, n = np.unique((which[:, None] * SIGNATURE + place[None, :]) * 65536 + values, return_counts=True)
    yield pa.record_batch([pa.array(names[found // 65536 // SIGNATURE]), pa.array(found // 65536 % SIGNATURE), pa.array(found % 65536), pa.array(n)], ["l", "place", "value", "n"])


def _agreement(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    values = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u2").reshape(-1, SIGNATURE)
    modal = np.stack(batch.column(4).to_numpy(zero_copy_only=False))
    yield pa.record_batch([*batch.columns[:3], pa.array((values == modal).sum(axis=1))], ["a", "l", "m", "agree"])


def _with_hubs(label: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Scored pairs of each class of a dense label with the label's hubs: those nearest to its modal signature."""
    size = label.groupBy("l").agg(F.count("*").alias("m")).filter(F.col("m") > DENSE)
    sig = classes.select(F.col("id").alias("a"), "n", "sig")
    dense = written(label.join(size, "l").join(sig, "a").select("a", "l", "m", "n", "sig"), "dense")
    votes = map_arrow(dense.select("l", "sig"), _votes, "l long, place long, value long, n long").groupBy("l", "place", "value").agg(F.sum("n").alias("n"))
    modes = votes.groupBy("l", "place").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    modal = modes.groupBy("l").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("modal"))
    rated = written(map_arrow(dense.join(written(modal, "modal"), "l").select("a", "l", "m", "sig", "modal"), _agreement, "a long, l long, m long, agree long"), "rated")
    part = rated.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / BLOCK)))
    for by in (["l", "part"], ["l"]):  # the best of each part, then of the label
        part = part.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("agree"), "a"))).filter(F.col("r") <= HUBS)
    # Classes bring their signatures along, and the hubs' come to them.
    hubs = written(part.select("l", F.col("a").alias("h")).join(dense.select(F.col("a").alias("h"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "h"), "hubs")
    far = dense.select("a", "l", F.col("n").alias("na"), F.col("sig").alias("sa")).join(small(hubs, most=HUB_ROWS), "l").filter("a <> h")
    found = _estimated(far.withColumnRenamed("h", "b"), threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()


def _parts(n: Column, size: Column, block: int) -> Column:
    """The number of parts for n classes with sets of ``size`` values."""
    return F.greatest(F.ceil(n / block), F.ceil(size * 8 / BLOCK_BYTES), F.lit(1))


def _blocks(pairs: DataFrame, label: DataFrame, classes: DataFrame) -> DataFrame:
    """A block for each pair: that of its label; a label with many classes is cut into a grid."""
    size = label.join(classes.select(F.col("id").alias("a"), "n"), "a").groupBy("l").agg(_parts(F.count("*"), F.sum("n"), BLOCK).alias("g")).filter("g > 1")
    label = label.join(small(written(size, "grid")), "l", "left").select("a", "l", F.coalesce("g", F.lit(1)).alias("g"))
    x, y = (F.pmod(F.xxhash64(c), F.col("g")) for c in ("a", "b"))  # both classes of a pair have one label
    return pairs.join(label, "a").select("a", "b", "score", F.xxhash64("l", F.least(x, y), F.greatest(x, y)).alias("block"))


def _confirm(threshold_percent: int):
    """Rows of a block: sets first, then pairs by falling estimate; yields each class with the least one it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, parent = None, {}, {}

        def joined() -> pa.RecordBatch:
            found = [(x, root(x)) for x in parent]
            found = [x for x in found if x[0] != x[1]]
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for at, a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if at != block:
                    yield joined()
                    block, sets = at, {}
                    parent.clear()
                if data is not None:
                    sets[a] = np.frombuffer(data, dtype="<u8")
                    continue
                if root(a) == root(b):
                    continue
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                common = int(np.count_nonzero(y[place] == x))
                if 100 * common >= threshold_percent * (len(x) + len(y) - common):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
        yield joined()

    return run


def _sets_of(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(id, data): the full sets of some classes, from the texts that their doc_id names."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(_set_key(x), x.astype("<u8").tobytes()) for x in _sets(batch.column(0), k) if len(x)]
        yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["key", "data"])

    named = small(chosen.select("doc_id").distinct(), chosen.count())
    texts = docs.join(named, docs["doc_id"].eqNullSafe(named["doc_id"]), "left_semi").select("text")
    # Rows that share a doc_id and a text give a set again.
    sets = map_arrow(texts, each, "key binary, data binary").join(chosen.select("id", "key"), "key").select("id", "data")
    return written(sets, "given")


def _links(docs: DataFrame, classes: DataFrame, scored: DataFrame, label: DataFrame, k: int, threshold_percent: int) -> DataFrame:
    """Confirmed links that span the components of the candidates' graph."""
    blocked = written(_blocks(scored, label, classes), "blocks")
    wanted = blocked.select("a").unionByName(blocked.select(F.col("b").alias("a"))).distinct()
    chosen = written(classes.join(wanted, classes["id"] == wanted["a"], "left_semi").select("id", "key", "doc_id", "n"), "chosen")
    members = blocked.select("block", F.col("a").alias("id")).unionByName(blocked.select("block", F.col("b").alias("id"))).distinct()
    given = members.join(_sets_of(docs, chosen, k), "id").select("block", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(2.0).cast("float").alias("score"), "data")
    asked = blocked.select("block", "a", "b", "score", F.lit(None).cast("binary").alias("data"))
    rows = given.unionByName(asked).repartition("block").sortWithinPartitions("block", F.desc("score"), "a", "b")
    return rows.mapInArrow(_confirm(threshold_percent), "a long, b long")


def _grid(members: DataFrame, block: int) -> DataFrame:
    """(block, side, id, comp) from ``members`` (r, id, comp, n): blocks that hold all pairs of an r with different comp.

    The largest comp of an r only meets the others.  Within a block, all pairs
    count, or, where there are two sides, those of different sides.
    """
    of_comp = members.groupBy("r", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    about = of_comp.groupBy("r").agg(F.count("*").alias("k"), F.max(F.struct("c", "comp", "s")).alias("big"), F.sum("c").alias("c"), F.sum("s").alias("s")).filter("k > 1")
    about = about.select("r", F.col("big.comp").alias("big"), _parts(F.col("big.c"), F.col("big.s"), block).alias("g_big"), _parts(F.col("c") - F.col("big.c"), F.col("s") - F.col("big.s"), block).alias("g_rest"))
    at = members.join(small(written(about, "about")), "r").withColumn("in_big", F.col("comp") == F.col("big"))
    at = at.withColumn("p", F.pmod(F.xxhash64("id"), F.when(F.col("in_big"), F.col("g_big")).otherwise(F.col("g_rest"))))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("q")
    made = lambda rows, n, kind, first, second, side: rows.select("*", upto(n)).select(F.xxhash64("r", F.lit(kind), first, second).alias("block"), side.alias("side"), "id", "comp")
    p, q = F.col("p"), F.col("q")
    rest, big = at.filter("not in_big"), at.filter("in_big")
    among = made(rest, "g_rest", 0, F.least(p, q), F.greatest(p, q), F.when(p > q, 1).otherwise(0))
    return among.unionByName(made(rest, "g_big", 1, p, q, F.lit(0))).unionByName(made(big, "g_rest", 1, q, p, F.lit(1)))


def _joins(batches: Iterator[pa.RecordBatch], least: int, threshold_percent: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, id, comp, sig[, data]) sorted by block: pairs of comps that the estimate and, if asked for, the full sets join."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            once = np.unique(rows["id"].to_numpy(), return_index=True)[1]
            rows = rows if len(once) == len(rows) else rows.take(pa.array(once))
            found = _block_joins(rows, least, threshold_percent)
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            held.clear()

    last = None
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if a < b:
                if block[a] != last:
                    yield from flush()
                    last = block[a]
                held.append(batch.slice(a, b - a))
    yield from flush()


def _block_joins(rows: pa.Table, least: int, threshold_percent: int | None) -> list[tuple[int, int]]:
    side, comp = rows["side"].to_numpy(), rows["comp"].to_numpy()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), dtype="<u2").reshape(-1, SIGNATURE)
    if threshold_percent is not None:
        data = rows["data"].to_pylist()
        size = np.array([len(x) // 8 for x in data])
        begin = np.concatenate([[0], np.cumsum(size)])
        names, element = np.unique(np.frombuffer(b"".join(data), dtype="<u8"), return_inverse=True)
        marked = np.zeros(len(names), dtype=bool)
    group = np.unique(comp, return_inverse=True)[1]
    two = side.min() != side.max()
    right = np.flatnonzero(side == 1) if two else np.arange(len(side))
    out = []
    for i in (np.flatnonzero(side == 0) if two else right).tolist():
        other = right if two else right[i + 1 :]
        other = other[group[other] != group[i]]
        if not len(other):
            continue
        other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
        if len(other) and threshold_percent is not None:
            own = element[begin[i] : begin[i + 1]]
            marked[own] = True
            n = size[other]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(begin[other] - ends + n, n)
            common = np.add.reduceat(marked[element[at]].astype(np.int64), ends - n)
            marked[own] = False
            other = other[100 * common >= threshold_percent * (size[i] + n - common)]
        while len(other):
            j = other[0]
            out.append((int(comp[i]), int(comp[j])))
            group[group == group[j]] = group[i]
            other = other[group[other] != group[i]]
    return out


def _dense_joins(docs: DataFrame, classes: DataFrame, paths: DataFrame, grouped: DataFrame, k: int, threshold_percent: int) -> DataFrame | None:
    """Pairs of groups to join, from all pairs of different groups in dense regions; ``grouped`` has (id, comp) of joined classes."""
    at = paths.select(F.xxhash64("tree", F.substring("path", 1, 2 * MIN_DEPTH)).alias("r"), "id")
    dense = written(at.groupBy("r").agg(F.count("*").alias("m")).filter(F.col("m") > WINDOW + 1).select("r"), "dense")
    members = at.join(small(dense), "r").join(grouped, "id", "left").select("r", "id", F.coalesce("comp", "id").alias("comp"))
    members = written(members, "members")
    split = members.groupBy("r").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    # Several orders may find one region.
    split = written(split.filter("low <> high").groupBy("m", "x", "y").agg(F.min("r").alias("r")).select("r"), "split")
    if split.isEmpty():
        return None
    threshold = threshold_percent / 100
    least = int(np.ceil(_least(threshold) * SIGNATURE))
    sig, size = classes.select("id", "sig"), classes.select("id", "n")

    def searched(members: DataFrame, more: DataFrame, full: int | None) -> DataFrame:
        blocks = _grid(members, BLOCK if full else WIDE_BLOCK).join(more, "id").repartition("block").sortWithinPartitions("block")
        rows = blocks.select("block", "side", "id", "comp", "sig", *(["data"] if full else []))
        return rows.mapInArrow(lambda batches: _joins(batches, least, full), "a long, b long")

    likely = searched(members.join(small(split), "r").withColumn("n", F.lit(SIGNATURE // 4)), sig, None)
    family = components(written(likely, "likely"))
    if family.isEmpty():
        return None
    family = written(family.select(F.col("node").alias("comp"), F.col("label").alias("r")), "family")
    every = members.select("id", "comp").unionByName(grouped.select("id", "comp")).distinct()
    chosen = written(every.join(family, "comp").join(size, "id").select("r", "id", "comp", "n"), "chosen")
    sets = _sets_of(docs, written(classes.join(chosen.select("id"), "id", "left_semi").select("id", "key", "doc_id"), "named"), k)
    return written(searched(chosen, sets.join(sig, "id"), threshold_percent), "joins")


def near_duplicates(docs: DataFrame, k: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (see the module)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = written(map_arrow(docs, _describe(k), "doc_id long, n long, key binary, sig binary"), "sets")
    classes = described.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    paths = map_arrow(classes.select("id", "sig"), _paths, "tree int, path binary, id long")
    near = _near(paths)
    threshold = threshold_percent / 100
    scored = written(_scored(near, classes, threshold), "scored")
    label = _labels(scored)
    extra = _with_hubs(label, classes, threshold).join(scored, ["a", "b"], "left_anti")
    scored = written(scored.unionByName(extra), "scored")
    found = components(written(_links(docs, classes, scored, label, k, threshold_percent), "links"))
    grouped = written(found.select(F.col("node").alias("id"), F.col("label").alias("comp")), "grouped")
    more = _dense_joins(docs, classes, paths, grouped, k, threshold_percent)
    if more is not None:
        joined = written(components(more).select(F.col("node").alias("comp"), "label"), "joined")
        # Groups of one class that were joined only now.
        alone = joined.select(F.col("comp").alias("id"), "comp").join(grouped.select("id"), "id", "left_anti")
        every = grouped.unionByName(alone).join(small(joined), "comp", "left")
        grouped = written(every.select("id", F.coalesce("label", "comp").alias("comp")), "grouped")
    of_class = written(classes.select("id", "key", "doc_id").join(grouped, "id").select("key", "doc_id", "comp"), "several")
    least = written(of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    alone = classes.join(grouped, "id", "left_anti").select("key", F.col("doc_id").alias("component_id"))
    found = written(of_class.join(small(least), "comp").select("key", "component_id").unionByName(alone), "found")
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "key").join(found, "key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, k: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``: that of the least doc_id, then row.

    Rows are told apart by number, so that rows which repeat a doc_id or have
    none go only as copies of another's text.
    """
    packed = written(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(packed.select("row", F.col("doc.text").alias("text")), k, threshold_percent, doc_id="row")
    found = written(found.select(F.col("doc_id").alias("row"), "component_id"), "copies")
    several = written(found.groupBy("component_id").count().filter("count > 1").select("component_id"), "several")
    members = found.join(small(several), "component_id", "left_semi").join(packed.select("row", F.col("doc.doc_id").alias("doc_id")), "row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = members.groupBy("component_id").agg(F.min(place)["row"].alias("first"))
    gone = written(members.join(first, "component_id").filter("row <> first").select("row"), "gone")
    return packed.join(small(gone), "row", "left_anti").select("doc.*")
