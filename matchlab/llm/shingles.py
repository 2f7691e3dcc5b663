"""Distinct word shingles of whole texts and their circulant MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from matchlab.llm.words import cut, mix, windows

WORDS = 5
BANDS, ROWS = 24, 4
_U = np.uint64
_U32 = np.uint32


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, offsets).

    Words are taken after lower-casing A-Z. A text of fewer than n words has its whole
    word sequence as its one shingle, a text without words has none.
    """
    words = cut(texts, lower=True)
    hashes, counts = words.hashes(), words.counts()
    run, valid = windows(hashes, words.text, n)
    at = np.flatnonzero(valid)
    shingle, text = run[at], words.text[at]
    first = words.firsts()
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole, _ = windows(hashes, words.text, k)
            shingle = np.concatenate([shingle, whole[first[short]]])
            text = np.concatenate([text, short])
    code = (text.astype(np.uint64) << _U(40)) | (shingle >> _U(24))
    order = np.argsort(code)
    code, shingle, text = code[order], shingle[order], text[order]
    same = code[1:] == code[:-1]
    if len(code) and np.any(same & (shingle[1:] != shingle[:-1])):
        order = np.lexsort((shingle, text))
        shingle, text = shingle[order], text[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[fresh], text[fresh]
    return shingle, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words.texts))]).astype(np.int64)


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a fixed bijection on 32-bit integers."""
    x ^= x >> _U32(16)
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signatures(shingle: np.ndarray, offsets: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: one row of ``size`` minima for each set that is not empty.

    The first permutation scatters shingles over 32-bit places (their hash does it);
    coordinate k is the least value of the second permutation, shifted circularly by
    k, over the set's places. Two permutations thus give all coordinates.
    """
    place = (mix(shingle) >> _U(32)).astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), size), np.uint32)
    if len(starts):
        for k in range(size):
            out[:, k] = np.minimum.reduceat(_permute(place - _U32(k)), starts)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is mixed in."""
    n, size = signature.shape
    parts = signature.reshape(n, size // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def digests(shingle: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set, as two columns; 0 for an empty set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ _U(salt)), dtype=np.uint64)])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]
