"""Words of whole Arrow batches, cut and hashed with array operations.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is
the same as the run of characters. All hashes are 64 bits wide and depend on the
bytes alone, so any two tasks agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 3 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_FACTOR))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the next batch."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts in order: text number, first byte and end byte of each."""

    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.text, minlength=self.texts).astype(np.int64)

    def firsts(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self) -> np.ndarray:
        """One hash for each word's bytes."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * _power(_FACTOR, len(self.data)), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _power(_INVERSE, len(self.data) + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))


_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def cut(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Cut a column into words; ``lower`` turns A-Z into a-z first.

    ``plain`` lowers all letters and also cuts at every ASCII character that is no
    letter or digit.
    """
    if plain:
        texts = pc.utf8_lower(texts)
    data, offsets = text_buffers(texts)
    if lower or plain:
        data = (_PLAIN if plain else _LOWER)[data]
    apart = _SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = ~apart, ~apart
    first[1:] &= apart[:-1] | edge[1:-1]
    last[:-1] &= apart[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, text, start, end)


def windows(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of every run of n words; not valid where it leaves its text."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    run = np.zeros(size, np.uint64)
    for i in range(n):
        run = run * _U(_FACTOR) + hashes[i : size + i]
    return mix(run + _U(n)), text[:size] == text[n - 1 :]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` text bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
