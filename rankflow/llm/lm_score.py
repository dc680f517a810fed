"""Language-model scores by cross-entropy difference.

Two word bigram models, a target model (documents labelled good) and a
background model (all documents), share one vocabulary and one smoothing, and
are matched in size: the background's counts are scaled to the target's number
of words, so that smoothing weighs alike in both.  A document's score is the
mean over its words of (target loss - background loss), in nats; lower is
closer to the target.  Each document is scored by the models of all other
documents: its own counts are taken off first.

The vocabulary is every word that the corpus holds twice or more; all others
are one unknown word.  Nothing else is cut: all words and bigrams of all
documents count, however many there are.  Those that occur once have no count
left once their own document's is taken off, so that only the rest is kept,
which changes no score.

1.  Documents go into blocks of some megabytes of text.  A block has a sorted
    list of its distinct words and bigrams, as hashes.
2.  Hashes are cut into ranges, as many as the corpus needs for a range to fit a
    task.  Each block sends each range its keys and their counts, packed: six
    bytes a key, a byte or less a count.  A common key is sent once a block.
3.  A range sums the counts of its keys over all blocks and sends each block the
    sums, packed, in the order of the block's keys, so that no key goes back.
4.  A block meets the answers of all ranges, in order, and its documents are
    scored.

No task or driver holds a model; memory is that of a block or a range.  Keys
have 48 bits and those of the range, so that a corpus of any size has next to
no collisions (under one in 30 GB; on average each takes one key's count for
another's).

Null, empty and blank texts have no word and null scores.  Without target
documents the target model is the prior.  Repeated rows are documents of their
own.  Null and repeated ids in ``good`` change nothing.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small, written
from .tokens import _MULT, NON_SPACE, count_words, hash_words, mix, text_runs

LEAST = 2  # occurrences of a known word
PRIOR = 0.5  # added to each word's count
MASS = 1.0  # weight of the word's own probability against the counts after the word before
DIGITS = 6
BLOCK_BYTES = 4_000_000  # text of a block
BLOCKS_AT_ONCE = 2  # that a reader or writer of blocks holds
RANGE_KEYS = 1_000_000  # keys of all blocks that a range gets, at most on average
#: What a packed block holds: documents (id, whether it has one, target, where their text begins) and the texts.
PARTS = {"ids": "<i8", "valid": "<u1", "target": "<u1", "starts": "<i8", "text": "<u1"}


def _pack(*parts: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(x, dtype=kind) for x, kind in zip(parts, PARTS.values(), strict=True)]
    return b"".join([np.array([x.nbytes for x in parts], dtype="<i8").tobytes(), *[x.tobytes() for x in parts]])


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more follow in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes() + np.array([len(x)], "<i8").tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1, len(data) - 8)[0])
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:-8], "<i8")
    return out


class Block:
    """Some documents as places in a sorted list of n-gram keys; odd keys are bigrams."""

    def __init__(self, data: pa.BinaryScalar, bits: int):
        buf = data.as_buffer()
        edges = np.cumsum([8 * len(PARTS), *np.frombuffer(buf, "<i8", len(PARTS))])
        parts = [np.frombuffer(buf[int(a) : int(b)], kind) for kind, a, b in zip(PARTS.values(), edges[:-1], edges[1:], strict=True)]
        self.ids, self.valid, self.target, starts, text = parts
        word, pair, count, self.pair_at = [], [], [np.zeros(1, np.int64)], []
        begin = 0
        for i, j, piece, at in text_runs(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(starts), pa.py_buffer(text)])):
            words = hash_words(piece, at, NON_SPACE)
            later = np.ones(len(words.hash), dtype=bool)
            later[words.first[:-1][words.first[:-1] < len(later)]] = False
            inner = np.flatnonzero(later)
            word.append(mix(words.hash) & ~np.uint64(1))
            pair.append(mix(words.hash[inner - 1] * _MULT + words.hash[inner]) | np.uint64(1))
            self.pair_at.append(inner + begin)
            count.append(np.diff(words.first))
            begin += len(words.hash)
        self.first = np.cumsum(np.concatenate(count))
        at = self.pair_at = np.concatenate([*self.pair_at, np.zeros(0, np.int64)])
        both = np.concatenate([*word, *pair, np.zeros(0, np.uint64)])
        both = (both >> np.uint64(64 - bits)) << np.uint64(1) | both & np.uint64(1)  # the first bits, and the kind
        self.keys, place, self.n = np.unique(both, return_inverse=True, return_counts=True)
        self.word, self.pair = place[:begin], place[begin:]
        own = np.repeat(self.target.astype(bool), np.diff(self.first))
        self.good = np.bincount(place[np.concatenate([own, own[at]])], minlength=len(self.keys))

    def losses(self, n: np.ndarray, good: np.ndarray, totals: dict) -> list[np.ndarray]:
        """For the target and the background model, the loss of each word; ``n`` and ``good`` are the counts of the keys in all documents."""
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        at, word, pair = self.pair_at, self.word, self.pair
        mine = _own(doc, word, len(self.keys))
        mine_pair = _own(doc[at], pair, len(self.keys))
        unknown = n[word] < LEAST
        strange = np.bincount(doc[unknown], minlength=len(self.ids))[doc]  # unknown words of the same document
        own_words = np.diff(self.first)[doc]
        is_target = self.target[doc].astype(np.int64)
        out = []
        for name, count, own in (("good", good, is_target), ("n", n, np.ones_like(is_target))):
            scale = totals["good"] / totals["n"] if name == "n" and totals["good"] else 1.0
            rest = np.where(unknown, totals[f"unknown_{name}"] - own * strange, count[word] - own * mine)
            p = (scale * rest + PRIOR) / (scale * (totals[name] - own * own_words) + PRIOR * (totals["vocabulary"] + 1))
            both = count[pair] - own[at] * mine_pair
            before = count[word[at - 1]] - own[at] * mine[at - 1]
            p[at] = (scale * both + MASS * p[at]) / (scale * before + MASS)
            out.append(-np.log(p))
        return out


def _own(doc: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """How often each key occurs in its document."""
    _, place, n = np.unique(doc * max(keys, 1) + key, return_inverse=True, return_counts=True)
    return n[place]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, target, text: packed blocks, each with its number of words, and of those in target documents."""
    ids = batch.column(0)
    valid, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    target = batch.column(1).to_numpy(zero_copy_only=False)
    for i, j, buf, starts in text_runs(batch.column(2), BLOCK_BYTES):
        n = count_words(buf, starts, NON_SPACE)
        packed = _pack(values[i:j], valid[i:j], target[i:j], starts, buf)
        yield pa.record_batch([pa.array([packed], pa.binary()), pa.array([int(n.sum())]), pa.array([int(n[target[i:j].astype(bool)].sum())])], ["data", "n", "good"])


def _sent(range_bits: int):
    """block, data: the packed keys and counts of each block for each range that has some."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = Block(data, 47 + range_bits)
            edges = np.searchsorted(block.keys >> np.uint64(48), np.arange(2**range_bits + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges))
            high, low = (block.keys >> np.uint64(16)).astype("<u4"), block.keys.astype("<u2")
            cut = [slice(edges[r], edges[r + 1]) for r in full]
            columns = [[high[x].tobytes() + low[x].tobytes() for x in cut], [_pack_counts(block.n[x]) for x in cut], [_pack_counts(block.good[x]) for x in cut]]
            yield pa.record_batch([pa.array(full), pa.array(np.full(len(full), number)), *[pa.array(x, pa.binary()) for x in columns]], ["part", "block", "keys", "n", "good"])

    return each


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_sent`` sorted by range: the sums for each block, and, in its first row, what the range knows of the vocabulary."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        keys = []
        for data in rows["keys"].to_pylist():
            k = len(data) // 6
            keys.append(np.frombuffer(data, "<u4", k).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", k, 4 * k))
        ends = np.cumsum([len(x) for x in keys])
        names, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate([_unpack_counts(x) for x in rows[c].to_pylist()]), minlength=len(names)).astype(np.int64) for c in ("n", "good")]
        known = (names % np.uint64(2) == 0) & (sums[0] >= LEAST)
        about = [int(known.sum()), int(sums[0][known].sum()), int(sums[1][known].sum())]
        more = [pa.array([x] + [0] * (len(keys) - 1), pa.int64()) for x in about]
        back = [[_pack_counts(x[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)] for x in sums]
        yield pa.record_batch([rows["part"].combine_chunks(), rows["block"].combine_chunks(), *[pa.array(x, pa.binary()) for x in back], *more], ["part", "block", "n", "good", "vocabulary", "known_n", "known_good"])

    last = None
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if a < b:
                if part[a] != last:
                    yield from flush()
                    last = part[a]
                held.append(batch.slice(a, b - a))
    yield from flush()


def count_ngrams(blocks: DataFrame) -> tuple[DataFrame, int, dict]:
    """Of blocks (block, data, n, good): the counts of their keys in all documents (block, part, n, good), bits of the ranges, and totals."""
    totals = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "good")]).first().asDict()
    range_bits = max(0, (2 * totals["n"] // RANGE_KEYS).bit_length())
    sent = map_arrow(blocks.select("block", "data"), _sent(range_bits), "part long, block long, keys binary, n binary, good binary")
    rows = sent.repartition("part").sortWithinPartitions("part")
    answers = written(rows.mapInArrow(_summed, "part long, block long, n binary, good binary, vocabulary long, known_n long, known_good long"), "answers")
    known = answers.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("vocabulary", "known_n", "known_good")]).first()
    return answers, range_bits, totals | {"vocabulary": known["vocabulary"]} | {f"unknown_{x}": totals[x] - known[f"known_{x}"] for x in ("n", "good")}


def _scored(range_bits: int, totals: dict):
    """Rows (part, n, good, data) of a block: the block itself first, then the answers by range."""

    def result(data: pa.BinaryScalar, answers: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = Block(data, 47 + range_bits)
        counts = [np.concatenate([np.zeros(0, np.int64), *[_unpack_counts(x) for rows in answers for x in rows.column(c).to_pylist()]]) for c in (1, 2)]
        count = np.diff(block.first)
        doc = np.repeat(np.arange(len(count)), count)
        mean = [np.bincount(doc, weights=x, minlength=len(count)) / np.maximum(count, 1) for x in block.losses(*counts, totals)]
        columns = [pa.array(np.round(x, DIGITS), mask=count == 0) for x in (mean[0], mean[1], mean[0] - mean[1])]
        return pa.record_batch([pa.array(block.ids, mask=block.valid == 0), pa.array(count), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, []
        for batch in batches:
            data = batch.column(3)
            begins = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([0, *begins + 1], [*begins, batch.num_rows], strict=True):
                if a < b:
                    answers.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    if block is not None:
                        yield result(block, answers)
                    block, answers = data[int(b)], []
        if block is not None:
            yield result(block, answers)

    return run


def score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row of ``docs``; ``good`` has the target's doc_id."""
    good = good.filter("doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = named.join(small(good), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", F.col("good_id").isNotNull().alias("target"), "text")
    blocks = map_arrow(flagged, _blocks, "data binary, n long, good long")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", BLOCKS_AT_ONCE)
    answers, range_bits, totals = count_ngrams(blocks)
    nothing = [F.lit(None).cast(kind).alias(x) for x, kind in (("part", "long"), ("n", "binary"), ("good", "binary"))]
    rows = blocks.select("block", *nothing, "data").unionByName(answers.select("block", "part", "n", "good", F.lit(None).cast("binary").alias("data")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("part")).drop("block")
    return rows.mapInArrow(_scored(range_bits, totals), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """The target by default: documents labelled good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")
