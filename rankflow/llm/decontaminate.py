"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: every index row covers a block of consecutive
documents and stores, for each distinct word of the block, its postings (word
positions, delta coded).  Positions run through the block with a gap between
documents, so that no phrase crosses two of them.  The rows are written to the
shared folder; questions are then answered block by block without a shuffle.

A phrase is found by intersecting offset-adjusted postings: its rarest word
(by counts over the whole index) gives candidate starts, and each further word,
by rising count, keeps those starts that its own postings, moved by its
offset, confirm.  Proximity matches ask for all words of a window, in any
order, within a span that is ``slop`` words longer than the window.

Test items are taken in runs of bounded size, so any number of them works.  A
run gives, for each document that it hits, the merged spans of words and the
items; the runs of a document are put together by its row number.  The way is
the same for one run and for many.

Nulls, empty and blank texts have no word and no hit.  Repeated rows give
repeated results.  Items without a word match nothing; items of equal text
match alike; a null item_id is left out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small, written
from .tokens import ALNUM, hash_words, text_runs

WINDOW = 10
ITEM_BYTES = 4_000_000  # text of test items looked up at once
CANDIDATES = 2_000_000  # candidate starts held at once
INDEX_SCHEMA = "rows binary, ids binary, valid binary, first binary, terms binary, counts binary, postings binary"


def _index(gap: int):
    """Index rows of a batch of (row, doc_id, text)."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, number = batch.column(1), batch.column(0).to_numpy()
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        for i, j, buf, starts in text_runs(batch.column(2)):
            words = hash_words(buf, starts, ALNUM)
            n = np.diff(words.first)
            doc = np.repeat(np.arange(j - i), n)
            position = np.arange(len(doc)) + doc * gap
            order = np.argsort(words.hash, kind="stable")
            terms, at, counts = np.unique(words.hash[order], return_index=True, return_counts=True)
            sorted_positions = position[order].astype(np.int64)
            delta = np.diff(sorted_positions, prepend=0)
            delta[at] = sorted_positions[at]
            row = [number[i:j].astype("<i8"), values[i:j].astype("<i8"), valid[i:j].astype(np.uint8), words.first.astype("<i8"), terms.astype("<u8"), counts.astype("<u4"), delta.astype("<u4")]
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in row], ["rows", "ids", "valid", "first", "terms", "counts", "postings"])

    return each


def build_index(docs: DataFrame, gap: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written positional index of all words of ``docs``; its rows keep their numbers ``row`` or get new ones."""
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    return written(map_arrow(docs.select(row.cast("long").alias("row"), F.col(doc_id).cast("long"), F.col(text)), _index(gap), INDEX_SCHEMA), "index")


class Phrases:
    """Distinct windows of some test items: words by rank in the shared vocabulary, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = sorted({x for x, _ in items})
        number = {x: i for i, x in enumerate(self.items)}
        hashes, length, item = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j, buf, starts in text_runs(pa.array([x[1] for x in items], pa.large_string())):
            words = hash_words(buf, starts, ALNUM)
            for k in range(j - i):
                own = words.hash[words.first[k] : words.first[k + 1]]
                if len(own):
                    size = min(window, len(own))
                    rows = np.lib.stride_tricks.sliding_window_view(own, size)
                    hashes.append(np.pad(rows, ((0, 0), (0, window - size))))
                    length.append(np.full(len(rows), size))
                    item.append(np.full(len(rows), number[items[i + k][0]]))
        found, length, item = np.concatenate(hashes), np.concatenate(length), np.concatenate(item)
        inside = np.arange(window)[None, :] < length[:, None]
        self.vocabulary, inverse = np.unique(found[inside], return_inverse=True)
        ranks = np.full(found.shape, -1, dtype=np.int32)
        ranks[inside] = inverse
        self.words, which = np.unique(ranks, axis=0, return_inverse=True) if len(ranks) else (ranks, item)
        self.length = (self.words >= 0).sum(axis=1)
        self.words = np.maximum(self.words, 0).astype(np.int64)
        pairs = np.unique(np.stack([which.reshape(-1), item]), axis=1)
        self.item_of = pairs[1]
        self.item_from = np.searchsorted(pairs[0], np.arange(len(self.words) + 1))
        self.order = np.zeros_like(self.words)

    def of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``windows``, item) for all items of some windows."""
        sizes = self.item_from[windows + 1] - self.item_from[windows]
        return np.repeat(np.arange(len(windows)), sizes), self.item_of[np.repeat(self.item_from[windows], sizes) + _within(sizes)]

    def rank(self, counts: np.ndarray) -> None:
        """Offsets of each window by rising count of their words over the whole index."""
        amount = counts[self.words].astype(np.float64)
        amount[np.arange(self.words.shape[1])[None, :] >= self.length[:, None]] = np.inf
        self.order = np.argsort(amount, axis=1, kind="stable")


class Block:
    """The postings of one index row for the words of a vocabulary."""

    def __init__(self, row: dict, vocabulary: np.ndarray, gap: int):
        self.rows = np.frombuffer(row["rows"], dtype="<i8")
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.valid = np.frombuffer(row["valid"], dtype=np.uint8).astype(bool)
        self.first = np.frombuffer(row["first"], dtype="<i8")
        terms, counts = np.frombuffer(row["terms"], dtype="<u8"), np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
        place = np.searchsorted(terms, vocabulary)
        place[place == len(terms)] = 0
        here = terms[place] == vocabulary if len(terms) else np.zeros(len(vocabulary), dtype=bool)
        begin = np.concatenate([[0], np.cumsum(counts)])
        self.count = np.where(here, counts[place] if len(terms) else 0, 0)
        delta = np.frombuffer(row["postings"], dtype="<u4").astype(np.int64)
        total = np.concatenate([[0], np.cumsum(delta)])
        at = np.flatnonzero(here)
        sizes = self.count[at]
        take = np.repeat(begin[place[at]], sizes) + _within(sizes)
        self.position = total[take + 1] - np.repeat(total[begin[place[at]]], sizes)
        self.key = (np.repeat(at, sizes) << 40) | self.position  # rising, as terms and their positions are
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        self.base = self.first[:-1] + np.arange(len(self.ids)) * gap  # position of each document's first word

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 40) | np.maximum(position, 0)
        place = np.searchsorted(self.key, key)
        place[place == len(self.key)] = 0
        return (self.key[place] == key) & (position >= 0)

    def nearest(self, term: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first position of each term from ``low`` on; a very large number if there is none."""
        place = np.searchsorted(self.key, (term << 40) | np.maximum(low, 0))
        found = self.key[np.minimum(place, len(self.key) - 1)]
        return np.where((place < len(self.key)) & (found >> 40 == term), found & ((1 << 40) - 1), 1 << 40)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, position, side="right") - 1


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, joined."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _runs(phrases: Phrases, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows all of whose words occur in the block, with the positions of their rarest word, in bounded runs."""
    if not len(phrases.words) or not len(block.key):
        return
    inside = np.arange(phrases.words.shape[1])[None, :] < phrases.length[:, None]
    alive = np.flatnonzero(((block.count[phrases.words] > 0) | ~inside).all(axis=1))
    rarest = phrases.words[alive, phrases.order[alive, 0]]
    ends = np.cumsum(block.count[rarest])
    i = 0
    while i < len(alive):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CANDIDATES, side="right")))
        sizes = block.count[rarest[i:j]]
        yield np.repeat(alive[i:j], sizes), block.position[np.repeat(block.begin[rarest[i:j]], sizes) + _within(sizes)]
        i = j


def phrase_starts(phrases: Phrases, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of all exact matches in the block."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for window, position in _runs(phrases, block):
        start = position - phrases.order[window, 0]
        for step in range(1, phrases.words.shape[1]):
            offset = phrases.order[window, step]
            ok = (step >= phrases.length[window]) | block.has(phrases.words[window, offset], start + offset)
            window, start = window[ok], start[ok]
        out.append((window, start))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def proximity_starts(phrases: Phrases, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position of the span) where all words of a window, in any order, lie within its length plus ``slop``."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for window, position in _runs(phrases, block):
        for back in range(phrases.words.shape[1] + slop):
            low = position - back
            high = low + phrases.length[window] + slop
            ok = (low >= 0) & (position < high)
            for step in range(phrases.words.shape[1]):
                ok[ok] &= (step >= phrases.length[window[ok]]) | (block.nearest(phrases.words[window[ok], step], low[ok]) < high[ok])
            ok[ok] &= block.document(low[ok]) == block.document(np.minimum(high[ok] - 1, position[ok]))
            out.append((window[ok], low[ok]))
    window, start = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    both = np.unique(np.stack([window, start]), axis=1)
    return both[0], both[1]


def _item_runs(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Test items, read to the driver in runs of bounded size."""
    run, size = [], 0
    for row in benchmark.filter("item_id is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        run.append((row["item_id"], row["text"] or ""))
        size += len(run[-1][1])
        if size > ITEM_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _counted(index: DataFrame, phrases: Phrases) -> None:
    """Give the windows' words their order of rarity, by counts over the whole index."""
    vocabulary = phrases.vocabulary

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms, counts = np.frombuffer(terms, dtype="<u8"), np.frombuffer(counts, dtype="<u4")
            _, mine, theirs = np.intersect1d(vocabulary, terms, assume_unique=True, return_indices=True)
            total[mine] += counts[theirs]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["word", "n"])

    found = map_arrow(index.select("terms", "counts"), each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    counts[found["word"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    phrases.rank(counts)


def _looked_up(index: DataFrame, benchmark: DataFrame, window: int, each, schema: str) -> DataFrame:
    """``each(phrases)`` over the blocks of the index, for every run of test items."""
    parts = []
    for run in _item_runs(benchmark):
        phrases = Phrases(run, window)
        _counted(index, phrases)
        parts.append(map_arrow(index, each(phrases), schema))
    return reduce(DataFrame.unionByName, parts) if parts else index.sparkSession.createDataFrame([], schema)


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, gap: int = WINDOW) -> DataFrame:
    """One row for each match: row (the document's number in the index), doc_id, item_id, word (of its start in the document) and length.

    Exact phrases, or with ``slop`` proximity matches.  ``benchmark`` has item_id and text.
    """

    def each(phrases: Phrases):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names = pa.array(phrases.items, pa.string())
            for row in batch.to_pylist():
                block = Block(row, phrases.vocabulary, gap)
                which, start = phrase_starts(phrases, block) if slop is None else proximity_starts(phrases, block, slop)
                at, item = phrases.of(which)
                doc = block.document(start)[at]
                yield pa.record_batch(
                    [pa.array(block.rows[doc]), pa.array(block.ids[doc], mask=~block.valid[doc]), names.take(pa.array(item)), pa.array(start[at] - block.base[doc]), pa.array(phrases.length[which][at] + (slop or 0))],
                    ["row", "doc_id", "item_id", "word", "length"],
                )

        return run

    return _looked_up(index, benchmark, window, each, "row long, doc_id long, item_id string, word long, length long")


def _hits(index: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(row, begins, ends, items) for each run of items and document hit: its words hit, as merged spans, and the items."""

    def each(phrases: Phrases):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names = pa.array(phrases.items, pa.string())
            for row in batch.to_pylist():
                block = Block(row, phrases.vocabulary, window)
                which, start = phrase_starts(phrases, block)
                if not len(which):
                    continue
                order = np.argsort(start, kind="stable")
                which, start = which[order], start[order]
                reach = np.maximum.accumulate(start + phrases.length[which])
                # Blocks have gaps between documents, so that spans of two documents never touch.
                opens = np.concatenate([[True], start[1:] > reach[:-1]])
                begin, end = start[opens], reach[np.concatenate([opens[1:], [True]])]
                home = block.document(begin)
                hit, first = np.unique(home, return_index=True)
                cut = pa.array(np.append(first, len(begin)), pa.int32())
                at, item = phrases.of(which)
                pairs = np.unique(np.stack([block.document(start)[at], item]), axis=1)
                edge = pa.array(np.searchsorted(pairs[0], np.append(hit, len(block.ids))), pa.int32())
                spans = [pa.ListArray.from_arrays(cut, pa.array(x - block.base[home])) for x in (begin, end)]
                yield pa.record_batch([pa.array(block.rows[hit]), *spans, pa.ListArray.from_arrays(edge, names.take(pa.array(pairs[1])))], ["row", "begins", "ends", "items"])

        return run

    return _looked_up(index, benchmark, window, each, "row long, begins array<long>, ends array<long>, items array<string>")


def _sizes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, ids, valid, first in zip(*[x.to_pylist() for x in batch.columns], strict=True):
        ids, valid, first = np.frombuffer(ids, dtype="<i8"), np.frombuffer(valid, dtype=np.uint8).astype(bool), np.frombuffer(first, dtype="<i8")
        yield pa.record_batch([pa.array(np.frombuffer(rows, dtype="<i8")), pa.array(ids, mask=~valid), pa.array(np.diff(first))], ["row", "doc_id", "n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    index = build_index(docs.select("doc_id", "text"), window)
    found = _put_together(written(_hits(index, benchmark, window), "hits"))
    every = map_arrow(index.select("rows", "ids", "valid", "first"), _sizes, "row long, doc_id long, n_words long")
    out = every.join(small(found), "row", "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _put_together(hits: DataFrame) -> DataFrame:
    """(row, n_hit, n_items, items_sha256) from the hits of all runs of items."""
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")))))
    grouped = hits.groupBy("row").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.lit(0).cast("long")
    more = lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["n"] + F.greatest(none, x["end"] - F.greatest(acc["upto"], x["begin"]))).alias("n")
    )
    n_hit = F.aggregate("spans", F.struct(none.alias("upto"), none.alias("n")), more, lambda acc: acc["n"])
    return grouped.select("row", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, each judged by itself whatever its doc_id."""
    packed = written(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")
    index = build_index(packed.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), window)
    hit = written(_hits(index, benchmark, window).select("row").distinct(), "hit")
    return packed.join(small(hit), "row", "left_anti").select("doc.*")
