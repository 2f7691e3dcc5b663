"""Cost-balanced packing of token ids into sequences of a fixed length.

Each piece of a document costs ``linear * n + quadratic * n**2`` (attention within the
piece). Documents longer than a sequence fill whole sequences first. The rests are
taken in descending cost, and each goes to the sequence with the lowest cost so far
that has room; what does not fit there is cut off and goes on as a piece of its own.
A group gets just as many sequences as its ids need, so less than one sequence of a
group stays empty.

Groups are runs of documents within one input split, bounded in ids, so nothing is
shuffled, no task holds more than a group, and a lost task makes the same pieces again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab.llm.tokens import CHUNK_BYTES, encoder
from matchlab.llm.words import chunks

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
GROUP_TOKENS = 3_000_000


def place(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths."""
    pieces, number, rests = [], 0, []
    for doc, n in enumerate(lengths.tolist()):
        for at in range(0, n - n % size, size):
            pieces.append((doc, at, size, number, 0))
            number += 1
        if n % size:
            rests.append((n % size, doc, n - n % size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    used = [0] * -(-sum(r[0] for r in rests) // size)
    heap = [(0.0, i) for i in range(len(used))]
    for n, doc, start in rests:
        while n:
            cost, i = heapq.heappop(heap)
            part = min(n, size - used[i])
            pieces.append((doc, start, part, number + i, used[i]))
            used[i] += part
            if used[i] < size:
                heapq.heappush(heap, (cost + linear * part + quadratic * part * part, i))
            n, start = n - part, start + part
    return pieces


def pack(
    docs: DataFrame, vocabulary: str, size: int = 1024, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row for each piece: its place in its document and in its sequence, cost and ids.

    ``sequence_id`` is unique over the table; offsets in a sequence run without gaps.
    A null or empty text is the end id alone; a null id stays null; equal rows are
    packed each. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def flush(doc_ids, ids, counts, number):
        doc_ids, ids, counts = pa.chunked_array(doc_ids).combine_chunks(), np.concatenate(ids), np.concatenate(counts)
        pieces = np.array(place(counts, size, linear, quadratic), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        at = (np.cumsum(counts) - counts)[doc] + start
        raw = ids.astype("<u4").tobytes()
        body = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
        batch = pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(counts[doc]),
                pa.array(number + sequence), pa.array(offset),
                pa.array(linear * length + quadratic * length.astype(float) ** 2), pa.array(body, pa.binary()),
            ],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids"],
        )
        return batch, number + int(sequence.max()) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        number = TaskContext.get().partitionId() << 40
        doc_ids, ids, counts, held = [], [], [], 0
        for part in chunks(batches, "text", CHUNK_BYTES):
            got, offsets = encode(part.column("text"), end_id)
            doc_ids.append(part.column("doc_id"))
            ids.append(got)
            counts.append(np.diff(offsets))
            held += len(got)
            if held >= group_tokens:
                batch, number = flush(doc_ids, ids, counts, number)
                yield batch
                doc_ids, ids, counts, held = [], [], [], 0
        if held:
            batch, number = flush(doc_ids, ids, counts, number)
            yield batch

    return rows.mapInArrow(task, SCHEMA)
