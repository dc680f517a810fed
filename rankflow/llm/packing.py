"""Token-id output: best-fit-decreasing packing of documents into rows of fixed length.

Texts become token ids of a public byte-level BPE vocabulary (a file of the
driver's, sent to all executors) and an end-of-text id.  A document longer than a row is split
without loss into full rows' worth of segments and a rest.

Each task packs what it reads, in groups of at most ``GROUP_TOKENS`` tokens
(a longer document is a group of its own): segments by falling length, each
into the row with the least room that is enough.  A segment tree over the room
of open rows finds it in a logarithmic number of steps.  No shuffle is needed.

Packed rows hold ids, cumulative segment lengths, positions that restart with
each segment, and where each segment comes from.  Padding is ``PAD``.

Null texts count as empty; an empty text is a segment of its end-of-text id.
Repeated rows are packed as often as they occur; a null doc_id stays null.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_arrow

ROW = 2048
PAD = -1
GROUP_TOKENS = 2_000_000
#: The vocabulary of the registered query.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level BPE splits text (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
QUICK_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
ROW_SCHEMA = "pack string, ids array<int>, cu_seqlens array<int>, positions array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"

_RUN_OF_SPACE = re.compile(r"\s\s")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    """The ids of a text.

    The pattern's lookahead only matters within runs of white space; without
    one, the pattern without it splits alike and takes two thirds of the time.
    """
    return encoding(path, PATTERN if _RUN_OF_SPACE.search(text) else QUICK_PATTERN).encode_ordinary(text)


class Capacity:
    """A segment tree over the room left in open rows: how many rows have each amount of room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of ``need`` or more."""
        count, at = self.count, self.size + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until a right neighbour has rows
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """The row of each segment, and how many rows there are; no segment is longer than ``row``."""
    out, rows, tree = np.zeros(len(sizes), dtype=np.int64), 0, Capacity(row)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = tree.take(size) if rows else None
        room, at = found if found else (row, rows)
        rows += found is None
        out[k] = at
        if room > size:
            tree.add(room - size, at)
    return out, rows


class _Group:
    """Documents read so far, to be packed together."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def pack(self, name: str, row: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in self.ids], dtype=np.int64)
        pieces = -(-sizes // row)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        ends = np.cumsum(pieces)
        piece = np.arange(len(doc)) - np.repeat(ends - pieces, pieces)
        length = np.minimum(row, sizes[doc] - piece * row)
        where, rows = best_fit_decreasing(length, row)
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(rows + 1))
        flat = np.concatenate(self.ids)
        first = np.concatenate([[0], np.cumsum(sizes)])[doc] + piece * row  # of each segment in the group's ids
        for a in range(0, rows, 256):
            b = min(rows, a + 256)
            own = order[edge[a] : edge[b]]
            n, at = length[own], where[own] - a
            ends = np.cumsum(n)
            within = np.arange(ends[-1]) - np.repeat(ends - n, n)
            used = edge[a : b + 1] - edge[a]
            start = (ends - n) - np.concatenate([[0], ends])[used[:-1]][at]  # of each segment in its row
            target = np.repeat(at * row + start, n) + within
            matrix, positions = np.full((b - a) * row, PAD, dtype=np.int32), np.zeros((b - a) * row, dtype=np.int32)
            matrix[target] = flat[np.repeat(first[own], n) + within]
            positions[target] = within
            cu = np.insert(start + n, used[:-1], 0)
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            full = np.arange(b - a + 1) * row
            yield pa.record_batch(
                [
                    pa.array([f"{name}-{r}" for r in range(a, b)]), lists(full, pa.array(matrix)), lists(used + np.arange(len(used)), pa.array(cu, pa.int32())), lists(full, pa.array(positions)),
                    lists(used, pa.array([self.docs[k] for k in doc[own]], pa.int64())), lists(used, pa.array(piece[own], pa.int32())), lists(used, pa.array(piece[own] * row, pa.int64())),
                ],
                ["pack", "ids", "cu_seqlens", "positions", "doc_ids", "pieces", "starts"],
            )


def pack(docs: DataFrame, vocabulary: str, row: int = ROW) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text): see ROW_SCHEMA.  ``vocabulary`` is a path that the driver can read.

    ``starts`` has the offset of each segment in its document's ids; the ids of
    a document end with the vocabulary's first free id.
    """

    bound_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name_of_file = vocabulary.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles, TaskContext

        vocabulary = SparkFiles.get(name_of_file)
        end = encoding(vocabulary).n_vocab
        task, number, group = TaskContext.get().partitionId(), 0, _Group()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.array([*encode(text.as_py() or "", vocabulary), end], dtype=np.int32)
                if group.tokens and group.tokens + len(own) > GROUP_TOKENS:
                    yield from group.pack(f"{task}-{number}", row)
                    number, group = number + 1, _Group()
                group.docs.append(name)
                group.ids.append(own)
                group.tokens += len(own)
        if group.docs:
            yield from group.pack(f"{task}-{number}", row)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW_SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """One row for each segment: pack, segment, doc_id, piece, doc_start, row_start, length, ids_crc32."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, cu = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        n = batch.column(3).value_lengths().to_numpy()  # segments of each row
        row = np.repeat(np.arange(len(n)), n)
        segment = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = np.arange(len(row)) + row  # a row has one more cumulative length than segments
        start, length = cu[place], cu[place + 1] - cu[place]
        base = np.repeat(np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])[:-1], n) + start
        data = memoryview(np.ascontiguousarray(ids, dtype="<i4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(base.tolist(), length.tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(row)), pa.array(segment, pa.int32()), batch.column(3).flatten(), batch.column(4).flatten(), batch.column(5).flatten(), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
        yield pa.record_batch(columns, ["pack", "segment", "doc_id", "piece", "doc_start", "row_start", "length", "ids_crc32"])

    slim = packed.select("pack", "ids", "cu_seqlens", "doc_ids", "pieces", "starts")
    return map_arrow(slim, each, "pack string, segment int, doc_id long, piece int, doc_start long, row_start int, length int, ids_crc32 long")


def write_packed(docs: DataFrame, path: str, vocabulary: str, row: int = ROW) -> None:
    """Packed rows as Parquet: id matrices, cumulative lengths and positions."""
    pack(docs, vocabulary, row).write.mode("overwrite").parquet(path)
