"""Exact sums by 64-bit key, combined before they are shuffled.

Each task sums its own keys and sends one packed blob for every range of keys. A
range is merged by one task; how often a key occurs does not matter, since a task
sends it once in a blob. Keys are hashes, so ranges are even.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from matchlab.llm.storage import shard_of

BLOB_SCHEMA = "shard int, payload binary"
FLUSH_KEYS = 4_000_000


def shard_bits(spark: SparkSession) -> int:
    """Bits for at least as many shards as shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4, math.ceil(math.log2(max(1, partitions))))


def _squeeze(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsqueeze(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").reshape(n)


def pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted keys as differences, then the columns, bytes of equal weight together."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.int64)
    body = len(keys).to_bytes(8, "little") + b"".join(map(_squeeze, [steps, *columns]))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(payload: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    body = zstandard.ZstdDecompressor().decompress(payload)
    n = int.from_bytes(body[:8], "little")
    parts = [_unsqueeze(body[8 + 8 * n * i : 8 + 8 * n * (i + 1)], n) for i in range((len(body) - 8) // (8 * n))] if n else [np.zeros(0, np.int64)]
    return np.cumsum(parts[0].view(np.uint64), dtype=np.uint64), parts[1:]


def total(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys with summed columns."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(c[order], first) for c in columns]


def tally(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and how often each occurs."""
    keys, counts = np.unique(keys, return_counts=True)
    return keys, [counts.astype(np.int64)]


def blobs(keys: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """One row for each shard that sorted ``keys`` touch."""
    edges = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(edges))
    packed = [pack(keys[edges[i] : edges[i + 1]], [c[edges[i] : edges[i + 1]] for c in columns]) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["shard", "payload"])


def summed_blobs(parts: Iterable[tuple[np.ndarray, list[np.ndarray]]], bits: int) -> Iterator[pa.RecordBatch]:
    """Blobs of a task's (sorted keys, columns) parts, merged as far as memory allows."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    size = 0
    for keys, columns in parts:
        held.append((keys, columns))
        size += len(keys)
        if size >= FLUSH_KEYS:
            held = [merge(held)]
            size = len(held[0][0])
            if size >= FLUSH_KEYS // 2:
                yield blobs(*held[0], bits)
                held, size = [], 0
    if size:
        yield blobs(*merge(held), bits)


def merge(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys = np.concatenate([k for k, _ in parts])
    return total(keys, [np.concatenate(c) for c in zip(*(c for _, c in parts))])


def by_shard(frame: DataFrame, task, schema: str) -> DataFrame:
    """``task(shard, keys, columns)`` gives a pandas frame for each shard's sums."""

    def run(key, rows):
        return task(int(key[0]), *merge([unpack(bytes(p)) for p in rows["payload"]]))

    return frame.groupBy("shard").applyInPandas(run, schema)
