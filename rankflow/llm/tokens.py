"""Vectorised word hashing over UTF-8 bytes.

Every operator of this subpackage that needs words works on 64-bit word
hashes computed for a whole batch of texts at once: a polynomial in the bytes
of the word, made independent of where the word stands.  Words of
``LONG_WORD`` bytes or more are hashed one by one with XXH3, as a polynomial
modulo 2**64 is weak for very long inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1_000_000  # texts are hashed in runs of about so many bytes
LONG_WORD = 1024

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)

#: Byte classes: True where the byte belongs to a word.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # digits, a-z and every byte of a non-ASCII character
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(0, dtype=np.uint64)
        self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + CHUNK_BYTES // 2)
            inverse = np.uint64(pow(int(_MULT), -1, 2**64))
            self.up = np.multiply.accumulate(np.full(size, _MULT, dtype=np.uint64))
            self.down = np.multiply.accumulate(np.full(size, inverse, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """The words of some texts: hashes, byte spans, and where each text's words begin."""

    __slots__ = ("buf", "end", "first", "hash", "start", "text_start")

    def __init__(self, buf, text_start, start, end, hashes, first):
        self.buf, self.text_start = buf, text_start
        self.start, self.end, self.hash, self.first = start, end, hashes, first


def _opens(inside: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Whether a word begins at a byte."""
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    inner = text_start[(text_start > 0) & (text_start < len(inside))]
    opens[inner] = inside[inner]
    return opens


def count_words(buf: np.ndarray, text_start: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(_opens(in_word[buf], text_start))])[text_start])


def hash_words(buf: np.ndarray, text_start: np.ndarray, in_word: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts ``buf[text_start[i]:text_start[i+1]]``; ``first`` has one entry more than texts."""
    n = len(buf)
    if lower:
        buf = _LOWER[buf]
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(buf, text_start, empty, empty, np.zeros(0, dtype=np.uint64), np.zeros(len(text_start), dtype=np.int64))
    inside = in_word[buf]
    opens = _opens(inside, text_start)
    inner = text_start[(text_start > 0) & (text_start < n)]
    start = np.flatnonzero(opens)
    closes = np.empty(n, dtype=bool)
    closes[-1] = inside[-1]
    closes[:-1] = inside[:-1] & ~inside[1:]
    if len(inner):
        closes[inner - 1] = inside[inner - 1]
    end = np.flatnonzero(closes) + 1
    up, down = _POWERS.get(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up, out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start >= LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return Words(buf, text_start, start, end, hashes, np.searchsorted(start, text_start))


def text_runs(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of texts of about ``most`` bytes (a longer text is alone).

    Yields (first row, row after the last, bytes, text starts within the bytes);
    null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    rows = len(column)
    if rows == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + rows + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < rows:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(rows, max(i + 1, j))
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles; with fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = mix(total * _MULT + words[j : n - size + 1 + j])
    return np.unique(total)
