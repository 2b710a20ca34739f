"""Vectorised word, line and window hashing over the buffers of Arrow strings.

A batch of texts is one byte array with document offsets.  A prefix hash over
the bytes gives the 64-bit hash of any byte range in constant time, so words,
lines and word windows of a whole batch are hashed without a Python loop.
Words are maximal runs of bytes other than space and 0x09-0x0D.  Two ranges are
taken as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text that are hashed together; a longer document is taken alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        p = np.full(size, _P, U64)
        q = np.full(size, _P_INV, U64)
        p[0] = q[0] = 1
        _powers, _inverse = np.cumprod(p), np.cumprod(q)


class Texts:
    """Some consecutive texts of a batch; a null text counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._fold = fold_case
        self._prefix: np.ndarray | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return start and end bytes of all words, and the word offsets of the texts."""
        solid = ~_SPACE[self.data]
        before = np.empty(len(solid), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        inner = self.offsets[:-1]
        before[inner[inner < len(solid)]] = False  # a text starts a new word
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[last] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Return start and end bytes of all \n-split lines, and the line offsets of the texts."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        ends = np.concatenate([self.offsets[1:], cuts])
        # Number of the text that each boundary belongs to; empty texts have one empty line.
        of = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cuts, side="right") - 1])
        starts = starts[np.lexsort((starts, of))]
        ends = ends[np.lexsort((ends, of))]
        return starts, ends, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.n))])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Return the 64-bit hashes of byte ranges."""
        if self._prefix is None:
            _grow(len(self.data))
            self._prefix = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_CODES[self._fold][self.data] * _powers[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * _inverse[starts])

    def sums(self, per_byte: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """Return the sum of a per-byte (or per-item) array over each text."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        o = self.offsets if offsets is None else offsets
        return total[o[1:]] - total[o[:-1]]


def windows(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Return a hash for each run of ``width`` consecutive words, by its first word."""
    m = len(word_hashes) - width + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for i in range(width):
        out = out * U64(0xD6E8FEB86659FD93) + word_hashes[i : i + m]
    return mix(out)


def slices(column: pa.Array | pa.ChunkedArray, fold_case: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Yield (first row, end row, texts) over an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, obuf, dbuf = column.buffers()
    offsets = np.frombuffer(obuf, np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(dbuf, np.uint8) if dbuf is not None and dbuf.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], fold_case)
        at = end
