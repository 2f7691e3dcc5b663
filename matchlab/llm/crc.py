"""CRC-32 of many byte ranges at once."""

from __future__ import annotations

import zlib

import numpy as np

_LONG = 48
_FULL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


_STEP = _table()


def add_byte(value: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """Checksums after one more byte each."""
    state = value ^ _FULL
    return (_STEP[(state ^ np.uint32(byte) if np.isscalar(byte) else state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))) ^ _FULL


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """zlib.crc32(data[start:end], value) of each range, unsigned."""
    length = end - start
    state = (np.zeros(len(start), np.uint32) if value is None else value) ^ _FULL
    for i in np.flatnonzero(length > _LONG).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i] ^ _FULL)) ^ int(_FULL)
    short = np.flatnonzero((length > 0) & (length <= _LONG))
    order = short[np.argsort(-length[short], kind="stable")]
    at, now = start[order], state[order]
    # Ranges in order of length: those with a k-th byte come first.
    live = len(order) - np.cumsum(np.bincount(length[order], minlength=_LONG + 1))
    for k in range(_LONG):
        m = live[k]
        if not m:
            break
        now[:m] = _STEP[(now[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (now[:m] >> np.uint32(8))
    state[order] = now
    return state ^ _FULL
