"""Token ids in seekable files: independent zstandard frames and a trailing seek table.

A file holds one range of document ids in ascending order. Its layout is the public
seekable zstandard format, so any zstandard reader also gets the plain ids:

* frames of ``frame_tokens`` ids (little-endian unsigned 32-bit), each readable alone;
* a skippable frame with the document index: id and number of ids of each document;
* a skippable frame with the seek table: for each frame its packed size, its plain size
  and the low 32 bits of the xxh64 of its plain bytes.

A reader takes the seek table and the index from the end of the file, then only the
frames that hold the documents it was asked for, and checks each against its checksum.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlab.llm.storage import locate, new_file
from matchlab.llm.tokens import CHUNK_BYTES, encoder
from matchlab.llm.words import chunks

# Fixed values of the format.
INDEX_MAGIC = 0x184D2A5D
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_TOKENS = 1 << 16


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class _Writer:
    """Writes one file; holds one frame's ids and the index."""

    def __init__(self, stream, frame_tokens: int):
        self.stream, self.size = stream, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=1)
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        self.table: list[tuple[int, int, int]] = []

    def add(self, ids: np.ndarray) -> None:
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.size:
            ids = np.concatenate(self.wait)
            whole = len(ids) - len(ids) % self.size
            for at in range(0, whole, self.size):
                self._frame(ids[at : at + self.size])
            self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.table.append((len(packed), len(raw), _checksum(raw)))

    def close(self, doc_ids: pa.Array, counts: np.ndarray) -> None:
        if self.waiting:
            self._frame(np.concatenate(self.wait))
        sink = pa.BufferOutputStream()
        index = pa.table({"doc_id": doc_ids, "n_tokens": pa.array(counts, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        raw = self.packer.compress(sink.getvalue().to_pybytes())
        body = struct.pack("<I", _checksum(raw)) + raw
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        self.table.append((8 + len(body), 0, _checksum(b"")))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


class TokenFile:
    """Reads one file; ``ids(first, last)`` unpacks only the frames in between."""

    def __init__(self, path: str):
        system, name = locate(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.ends = np.cumsum(self.plain // 4)
        body = self.file.read_at(int(self.packed[-1]), int(self.at[-2]))[8:]
        if struct.unpack("<I", body[:4])[0] != _checksum(body[4:]):
            raise ValueError(f"{path}: the index does not match its checksum")
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body[4:])).read_all()
        self.path, self._last = path, (-1, None)

    def frame(self, number: int) -> np.ndarray:
        if self._last[0] != number:
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.packed[number]), int(self.at[number])))
            if len(raw) != self.plain[number] or _checksum(raw) != self.sums[number]:
                raise ValueError(f"{self.path}: frame {number} does not match its checksum")
            self._last = (number, np.frombuffer(raw, "<u4"))
        return self._last[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        parts, at = [], first
        while at < last:
            number = int(np.searchsorted(self.ends, at, side="right"))
            low = int(self.ends[number] - self.plain[number] // 4)
            parts.append(self.frame(number)[at - low : last - low])
            at = int(self.ends[number])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int | None = 0, frame_tokens: int = FRAME_TOKENS,
) -> DataFrame:
    """Encode every text and write the ids in ascending id order; returns the list of files.

    Each task sorts one range of ids on disk, encodes while it streams, and holds one
    frame. A null text is empty, a null id sorts first, rows with the same id are all
    written, ordered by text. Other columns are ignored. An empty table writes no file.
    The list of files (``folder/files``) has one row a file with the number of ids
    before it, so positions over the whole corpus need no pass over the documents.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        number, path = TaskContext.get().partitionId(), None
        doc_ids, counts = [], []
        parts = chunks(batches, "text", CHUNK_BYTES)
        part = next(parts, None)
        if part is None:
            return
        path = f"{folder}/data/tokens-{number:06d}.zst"
        with new_file(path) as stream:
            writer = _Writer(stream, frame_tokens)
            while part is not None:
                ids, offsets = encode(part.column("text"), end_id)
                writer.add(ids)
                doc_ids.append(part.column("doc_id"))
                counts.append(np.diff(offsets))
                part = next(parts, None)
            counts = np.concatenate(counts)
            writer.close(pa.chunked_array(doc_ids).combine_chunks(), counts)
        yield pa.RecordBatch.from_pydict(
            {"file": [number], "path": [path], "n_docs": [len(counts)], "n_tokens": [int(counts.sum())]},
            schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    spark = docs.sparkSession
    rows.mapInArrow(task, "file long, path string, n_docs long, n_tokens long").write.parquet(f"{folder}/written")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema("file long, path string, n_docs long, n_tokens long").parquet(f"{folder}/written")
    files = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files.coalesce(1).write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


_READ = "doc_id long, start long, n_tokens long, ids binary"


def _read(path: str, start: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Documents of a file in order; ``wanted`` are places in its index."""
    source = TokenFile(path)
    try:
        doc_ids = source.index.column("doc_id").combine_chunks()
        counts = source.index.column("n_tokens").to_numpy()
        first = np.cumsum(counts) - counts
        places = np.arange(len(counts)) if wanted is None else wanted
        at = 0
        while at < len(places):
            end, size = at, 0
            while end < len(places) and (end == at or size + counts[places[end]] <= 1 << 20):
                size += counts[places[end]]
                end += 1
            some = places[at:end]
            ids = [source.ids(int(first[i]), int(first[i] + counts[i])).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(some)), pa.array(start + first[some]), pa.array(counts[some]), pa.array(ids, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            at = end
    finally:
        source.close()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: id, ids before it in the corpus, number of ids, the ids as bytes."""
    files = spark.read.parquet(f"{folder}/files")

    def task(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                yield from _read(path, start, None)

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(task, _READ)


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Only the documents whose id is in ``wanted``; other frames stay packed.

    Each file's index is joined with the wanted ids; a file is read by one task, which
    unpacks the frames that hold its documents. A null id is never found.
    """
    files = spark.read.parquet(f"{folder}/files")

    def index(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                source = TokenFile(path)
                doc_ids = source.index.column("doc_id").combine_chunks()
                source.close()
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array([start] * n, pa.int64()), doc_ids, pa.array(range(n), pa.int64())],
                    ["path", "start", "doc_id", "place"],
                )

    places = files.select("path", "start").repartition(max(1, files.count())).mapInArrow(index, "path string, start long, doc_id long, place long")
    ids = wanted.select(F.col(id_column).cast("long").alias("doc_id")).distinct()
    found = places.join(ids, "doc_id", "left_semi").groupBy("path", "start").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def task(batches):
        for batch in batches:
            for path, start, places in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "places"))):
                yield from _read(path, start, np.array(places, np.int64))

    return found.mapInArrow(task, _READ)
