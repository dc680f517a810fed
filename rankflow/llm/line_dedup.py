"""Removal of repeated passages of lines.

Two kinds of spans of a text's lines are compared; both depend on the text in
them and next to them alone and shift with it.

1.  Windows: from each line that isn't blank, the fewest lines on that reach
    ``LONG`` words, and to each such line the fewest lines back.  A repeated
    run of lines of ``LONG`` words or more is the union of its windows, all of
    which occur in each of its copies, so that it is found whole whatever
    surrounds it.
2.  Content-defined chunks: a rolling hash over the hashes of the last ``SPAN``
    lines (blank ones left out) ends a chunk where its value is divisible by
    ``EVERY``; a line of ``LONG`` words or more is a chunk of its own.  A chunk
    with two lines that aren't blank counts, however few its words.

Spans with equal 128-bit digests of their bytes that occur more than once among
all documents are candidates; all but the first (least doc_id, then row, then
place) may go.  A span that overlaps its first copy in the same text stays.
Neighbouring spans of a text whose first copies are neighbours too are put
together, and a removed run's bytes are compared with those of its first copy.
Each removed line has an equal one in an earlier place, so some copy of every
line is kept.

A single line goes only if it has ``LONG`` words or more, as a passage of its
own, or within a longer run.

Spans of a hot passage are joined to one first copy each, never to one
another; their counts are partial sums.  Only digests are shuffled to find
them; bytes follow for what may go.

Null texts count as empty: no line, nothing removed.  Documents without doc_id
come last in the order of copies.  Repeated rows are copies of one another.
Extra columns stay untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small, written
from .tokens import NON_SPACE, hash_words, mix, text_runs

SPAN = 2
EVERY = 3
LONG = 50
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
SPANS = "row long, doc_id long, line int, lines int, k1 long, k2 long"
FIGURES = ["n_lines", "n_chunks", "removed_chunks", "removed_lines", "removed_words"]


def _chunk_ends(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each line whether a chunk ends after it."""
    n = len(hashes)
    ends = np.zeros(n, dtype=bool)
    full = np.flatnonzero(words > 0)
    if len(full):
        own = hashes[full]
        rolled = own.copy()
        for back in range(1, SPAN):
            rolled[back:] = mix(rolled[back:] + own[:-back] * np.uint64(2 * back + 1))
        ends[full[rolled % np.uint64(EVERY) == 0]] = True
        long = full[words[full] >= LONG]
        ends[long] = True
        ends[long[long > 0] - 1] = True
    if n:
        ends[-1] = True
    return ends


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text that isn't empty its place in the batch, bytes, begin, end and words of each line, and last line of each chunk."""
    for i, j, buf, starts in text_runs(batch.column(batch.num_columns - 1)):
        spaced = hash_words(buf, starts, NON_SPACE, lower=False)
        breaks = np.flatnonzero(buf == 0x0A)
        data = buf.tobytes()
        for d in range(j - i):
            a, b = int(starts[d]), int(starts[d + 1])
            if a == b:
                continue
            inner = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
            begin = np.concatenate([[a], inner + 1])
            end = np.concatenate([inner, [b]])
            words = np.searchsorted(spaced.start, end) - np.searchsorted(spaced.start, begin)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(begin))
            yield i + d, data, begin, end, words, np.flatnonzero(_chunk_ends(hashes, words))


def _windows(words: np.ndarray) -> np.ndarray:
    """(first, last) line of the shortest spans of LONG words from each line that isn't blank, and to each one."""
    total = np.concatenate([[0], np.cumsum(words)])
    full = np.flatnonzero(words > 0)
    last = np.searchsorted(total, total[full] + LONG) - 1
    first = np.searchsorted(total, total[full + 1] - LONG, side="right") - 1
    on, back = last < len(words), total[full + 1] >= LONG
    return np.concatenate([np.stack([full[on], last[on]], axis=1), np.stack([first[back], full[back]], axis=1)])


def _spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    row, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    rows, docs, lines, keys = [], [], [], []

    def made() -> pa.RecordBatch:
        line, key = np.concatenate(lines), np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        columns = [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(line[:, 0].astype(np.int32)), pa.array((line[:, 1] - line[:, 0] + 1).astype(np.int32)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())]
        return pa.record_batch(columns, ["row", "doc_id", "line", "lines", "k1", "k2"])

    for d, data, begin, end, words, last in _texts(batch):
        first = np.concatenate([[0], last[:-1] + 1])
        full = np.concatenate([[0], np.cumsum(words > 0)])
        several = full[last + 1] - full[first] >= 2
        found = np.unique(np.concatenate([np.stack([first, last], axis=1)[several], _windows(words)]), axis=0)
        if not len(found):
            continue
        lines.append(found)
        rows += [row[d]] * len(found)
        docs += [doc[d]] * len(found)
        keys += [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(begin[found[:, 0]].tolist(), end[found[:, 1]].tolist(), strict=True)]
        if len(rows) >= 100_000:
            yield made()
            rows, docs, lines, keys = [], [], [], []
    if rows:
        yield made()


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """row, spans: the spans of a row whose first copies are as far away, put together where they touch."""
    out: list[tuple[int, int, int, int, int]] = []
    for row, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        last = None
        for first, off, line, lines in sorted((x["first_row"], x["first_line"] - x["line"], x["line"], x["lines"]) for x in spans):
            if last is not None and last[0] == (first, off) and line <= last[2]:
                last[2] = max(last[2], line + lines)
                continue
            if last is not None:
                out.append((row, last[1], last[2] - last[1], last[0][0], last[1] + last[0][1]))
            last = [(first, off), line, line + lines]
        out.append((row, last[1], last[2] - last[1], last[0][0], last[1] + last[0][1]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["row", "line", "lines", "first_row", "first_line"])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """row, wanted, text: the bytes of some runs of lines."""
    wanted = batch.column(1).to_pylist()
    row, found = batch.column(0).to_pylist(), []
    for d, data, begin, end, _, _ in _texts(batch):
        found += [(row[d], x["first_line"], x["lines"], data[begin[x["first_line"]] : end[x["first_line"] + x["lines"] - 1]]) for x in wanted[d]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    yield pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["first_row", "first_line", "lines", "bytes"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row, gone) from ``docs`` (row, doc_id, text): the runs to remove (line, lines, bytes of the first copy), for each row that has some."""
    spans = written(map_arrow(docs.select("row", F.col("doc_id").cast("long"), "text"), _spans, SPANS), "spans")
    repeated = written(spans.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"), "repeated")
    copies = written(spans.join(small(repeated, most=100_000), ["k1", "k2"], "left_semi"), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    first = written(copies.groupBy("k1", "k2").agg(F.min(place).alias("first")).select("k1", "k2", F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line")), "first")
    both = copies.join(small(first, most=100_000), ["k1", "k2"])
    later = (F.col("row") != F.col("first_row")) | (F.col("line") >= F.col("first_line") + F.col("lines"))
    by_row = both.filter(later).groupBy("row").agg(F.collect_list(F.struct("line", "lines", "first_row", "first_line")).alias("spans"))
    runs = written(map_arrow(by_row, _runs, "row long, line int, lines int, first_row long, first_line int"), "runs")
    piece = ["first_row", "first_line", "lines"]
    wanted = runs.select(*piece).distinct().groupBy(F.col("first_row").alias("row")).agg(F.collect_list(F.struct("first_line", "lines")).alias("wanted"))
    sources = docs.join(small(written(wanted, "wanted"), most=100_000), "row").select("row", "wanted", "text")
    pieces = written(map_arrow(sources, _pieces, "first_row long, first_line int, lines int, bytes binary"), "pieces")
    return written(runs.join(pieces, piece).groupBy("row").agg(F.collect_list(F.struct("line", "lines", "bytes")).alias("gone")), "gone")


def _cover(gone: list[dict] | None, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each line whether a run of ``gone`` covers it whose bytes are those of the text."""
    edge = np.zeros(len(begin) + 1, dtype=np.int64)
    for x in gone or []:
        a, b = x["line"], x["line"] + x["lines"]
        if data[begin[a] : end[b - 1]] == x["bytes"]:
            edge[a] += 1
            edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def _sums(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """row, doc_id, gone, text: the figures of each row."""
    out = np.zeros((batch.num_rows, 5), dtype=np.int64)
    gone = batch.column(2).to_pylist()
    for d, data, begin, end, words, last in _texts(batch):
        cover = _cover(gone[d], data, begin, end)
        kept = np.concatenate([[0], np.cumsum(~cover)])
        whole = kept[last + 1] == kept[np.concatenate([[0], last[:-1] + 1])]
        out[d] = len(words), len(last), whole.sum(), cover.sum(), words[cover].sum()
    yield pa.record_batch([batch.column(1), *[pa.array(out[:, k].copy()) for k in range(5)]], ["doc_id", *FIGURES])


def _cleaned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """row, gone, text: the text without the lines of ``gone``."""
    gone, clean = batch.column(1).to_pylist(), [""] * batch.num_rows
    for d, data, begin, end, _, _ in _texts(batch):
        kept = np.flatnonzero(~_cover(gone[d], data, begin, end))
        clean[d] = b"\n".join(data[x:y] for x, y in zip(begin[kept].tolist(), end[kept].tolist(), strict=True)).decode()
    yield pa.record_batch([batch.column(0), pa.array(clean, pa.string())], ["row", "clean"])


def _with_rows(docs: DataFrame) -> DataFrame:
    """Documents with a fixed number for each row."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, removed_chunks (whole ones), removed_lines, removed_words for each row of ``docs``."""
    base = written(_with_rows(docs.select("doc_id", "text")), "rows")
    marked = base.join(repeated_lines(base).hint("merge"), "row", "left")
    schema = ", ".join(["doc_id long", *[f"{x} long" for x in FIGURES]])
    return map_arrow(marked.select("row", F.col("doc_id").cast("long"), "gone", "text"), _sums, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with later copies of repeated passages taken out of ``text``, all columns kept."""
    packed = written(_with_rows(docs.select(F.struct(*docs.columns).alias("doc"))), "rows")
    gone = repeated_lines(packed.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")))
    texts = map_arrow(packed.join(gone.hint("merge"), "row").select("row", "gone", F.col("doc.text").alias("text")), _cleaned, "row long, clean string")
    both = packed.join(texts, "row", "left")
    text = F.coalesce(F.col("clean"), F.col("doc.text")).alias("text")
    return both.select(*[text if x == "text" else F.col("doc").getField(x).alias(x) for x in docs.columns])
