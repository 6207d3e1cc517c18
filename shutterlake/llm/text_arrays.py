"""Words, shingles and sets of whole texts as numpy arrays over an Arrow batch's bytes.

Everything here works on UTF-8 bytes: no Python object is made for a word. A word's
hash is a polynomial over its bytes modulo 2^64 with random byte values, mixed
afterwards; equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character that is neither a letter nor a digit.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text taken at once; a longer text is a slice of its own.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 2^bits of each."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(1 << bits, _BASE, np.uint64)
    down = np.full(1 << bits, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about `most` bytes. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts; between: the bytes that part words, if others than white space.

    start, end: byte positions of each word; first: for each text the number of its
    first word, and one more entry at the end, so that text i has the words first[i] to first[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        if len(data) == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = between[data]
        before = np.empty(len(data), bool)
        before[0], before[1:] = True, space[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after = np.empty(len(data), bool)
        after[-1], after[:-1] = True, space[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool, head: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z; head: of the first so many bytes of longer words, which no whole word's hash equals."""
        values = _VALUES[LOWER] if lower else _VALUES
        up, down = _powers(max(20, int(len(self.data)).bit_length()))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=total[1:])
        end = np.minimum(self.end, self.start + head) if head else self.end
        size = (end - self.start).astype(np.uint64) + np.where(end < self.end, np.uint64(1 << 40), np.uint64(0))
        return mixed((total[end] - total[self.start]) * down[self.start] + size)


def chains(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each position the hash of n hashes in a row; n - 1 fewer than there are hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, n):
        out = out * np.uint64(_BASE) + hashes[i : i + count]
    return mixed(out + np.uint64(n))


def shingle_sets(words: Words, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingles as 64-bit hashes; a text of fewer words has one shingle, of all its words, and one without words has none."""
    hashes = words.hashes(lower)
    every = chains(hashes, n)
    first = words.first
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield chains(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
