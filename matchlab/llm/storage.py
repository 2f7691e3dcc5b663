"""Files on the shared folder, from inside tasks, and memory-mapped sorted hash arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyarrow import fs

from matchlab.llm.words import mix


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``path``, a URI or a plain local path."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@contextmanager
def new_file(path: str) -> Iterator:
    """Write a file that appears under its name only when it is whole.

    A task that runs twice writes the same bytes under another name first, so a
    reader never meets half a file.
    """
    system, name = locate(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft) as stream:
            yield stream
        system.move(draft, name)
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise


def remove(path: str) -> None:
    """Delete a folder of intermediate files that nothing reads any more."""
    system, name = locate(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file as a memory map.

    A file of a local or mounted folder is mapped in place. From another store it is
    first copied to an unnamed temporary file, which goes with the map.
    """
    system, name = locate(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.size == 0:
        return np.zeros(0, np.uint8)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, np.uint8, "r")
    with tempfile.TemporaryFile() as copy:
        with system.open_input_stream(name) as source:
            while block := source.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


class HashArrays:
    """Sorted 64-bit keys with value columns, in shards by the keys' top bits.

    One shard holds its keys, then each value column, as plain little-endian arrays.
    """

    def __init__(self, folder: str, bits: int, columns: dict[str, str]):
        self.folder, self.bits, self.columns = folder, bits, dict(columns)
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return {"folder": self.folder, "bits": self.bits, "columns": self.columns, "_open": {}}

    def path(self, shard: int) -> str:
        return f"{self.folder}/shard-{shard:06d}.bin"

    def write(self, shard: int, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
        with new_file(self.path(shard)) as stream:
            stream.write(keys.astype("<u8").tobytes())
            for name, kind in self.columns.items():
                stream.write(values[name].astype(kind).tobytes())

    def shard(self, number: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Keys and columns of a shard; a shard that nobody wrote is empty."""
        known = self._open.get(number)
        if known is None:
            try:
                raw = mapped(self.path(number))
            except FileNotFoundError:
                raw = np.zeros(0, np.uint8)
            width = 8 + sum(np.dtype(k).itemsize for k in self.columns.values())
            n = len(raw) // width
            keys, at, columns = raw[: 8 * n].view("<u8"), 8 * n, {}
            for name, kind in self.columns.items():
                size = n * np.dtype(kind).itemsize
                columns[name] = raw[at : at + size].view(kind)
                at += size
            known = self._open[number] = (keys, columns)
        return known

    def find(self, keys: np.ndarray, names: tuple[str, ...] | None = None) -> tuple:
        """(found, {column: values}) for sorted distinct keys; 0 where a key is unknown."""
        names = tuple(self.columns) if names is None else names
        found = np.zeros(len(keys), bool)
        out = {n: np.zeros(len(keys), self.columns[n]) for n in names}
        out["place"] = np.zeros(len(keys), np.int64)
        edges = np.searchsorted(shard_of(keys, self.bits), np.arange((1 << self.bits) + 1))
        for number in np.flatnonzero(np.diff(edges)):
            low, high = edges[number], edges[number + 1]
            have, columns = self.shard(int(number))
            if not len(have):
                continue
            at = np.searchsorted(have, keys[low:high])
            at[at == len(have)] = 0
            hit = have[at] == keys[low:high]
            found[low:high] = hit
            out["place"][low:high] = np.where(hit, at, 0)
            for n in names:
                out[n][low:high] = np.where(hit, columns[n][at], 0)
        return found, out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of a key: its top bits, so shards in order are keys in order."""
    if bits == 0:
        return np.zeros(len(keys), np.int64)
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One key for two ids below 2**32; ``unmix`` gives both back."""
    return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
