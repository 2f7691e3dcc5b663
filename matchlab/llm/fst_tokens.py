"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is turned into a deterministic transducer over bytes. Its
transitions are annotated with the change they make to the number of tokens, so the
count of a text is the sum along its path and no ids are made.

*States.* After a prefix of a word, a later token can only begin at those places from
which the bytes up to here spell the beginning of some token. For each such place a
state keeps the node of the vocabulary's trie, the last token of the prefix that ends
there, and how many tokens that prefix has more or fewer than the one read so far. The
next byte moves every node on; of the tokens that end with it exactly one follows the
last token at its place in an encoding, which gives the new count. States are finite in
number and are compiled when a text first needs them.

*Words.* Where the vocabulary's pattern starts a new word depends on the kinds of a few
neighbouring characters; there the transducer goes back to its first state.

*Chunks.* A batch of texts is cut into chunks of equal size that are all run at once. The
map of a chunk takes an entry state to an exit state and counts. Each is evaluated at
the state that the bytes before it lead to. The prefix scan then composes the maps: where
the exit of one is not the entry its successor was evaluated at, the map is extended by
that entry, up to the place where both paths meet again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab.llm.words import chunks, text_buffers

BATCH_BYTES = 4 << 20
CHUNK = 512
WARM_UP = 64
#: A worker forgets all compiled states between two batches beyond this number.
MOST_STATES = 600_000

_NONE = -1
_SHIFT, _ZERO = 16, 1 << 15
_FACTOR = np.int64(0x9E3779B97F4A7C15 - (1 << 64))

# Kinds of characters in the vocabulary's pattern.
_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4, 5
_APOSTROPHE = 0x27


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, with its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Numbers by number, looked up for whole arrays: open addressing in two arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, _NONE, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR).view(np.uint64) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, indices of unknown keys)."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = self.values[slot]
        apart = np.flatnonzero(held != keys)
        if not len(apart):
            return out, apart
        mask = len(self.keys) - 1
        unknown = []
        at = slot[apart]
        while len(apart):
            held = self.keys[at]
            hit = held == keys[apart]
            out[apart[hit]] = self.values[at[hit]]
            empty = held == _NONE
            unknown.append(apart[empty])
            go = ~(hit | empty)
            apart, at = apart[go], (at[go] + 1) & mask
        return out, np.concatenate(unknown)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != _NONE
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(self.bits + 1)
        self.n += len(keys)
        mask, at = len(self.keys) - 1, self._slots(keys)
        while len(keys):
            free = self.keys[at] == _NONE
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & mask


class Transducer:
    """The compiled part of a vocabulary's transducer; state 0 begins a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, before = parts["model"], parts["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or parts["normalizer"] or any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        ):
            raise ValueError(f"{path} is no byte-level BPE vocabulary without options")
        self.specials = []
        for token in parts["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"{path}: added token {token['content']!r} has options")
            self.specials.append(token["content"])
        letters = _byte_letters()
        vocabulary = model["vocab"]
        added = set(self.specials)
        self.bytes_of = {n: bytes(letters[c] for c in t) for t, n in vocabulary.items() if t not in added}
        self.byte_token = {b[0]: n for n, b in self.bytes_of.items() if len(b) == 1}
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.edges: dict[int, int] = {}  # node * 256 + byte: node
        self.token_at: list[int] = [_NONE]
        for number, spelt in self.bytes_of.items():
            node = 0
            for byte in spelt:
                node = self.edges.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(_NONE)
            self.token_at[node] = number
        self.inner = {edge >> 8 for edge in self.edges}
        self.kinds = np.zeros(0x110000, np.uint8)
        self.follows: dict[tuple[int, int], bool] = {}
        self._probe = None
        self.forget()

    def forget(self) -> None:
        first = pack("3i", 0, _NONE, 0)
        self.chains, self.numbers, self.table = [first], {first: 0}, Table()
        self.follows.clear()

    # States and transitions

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of one word, given the tokens of its bytes."""
        while len(symbols) > 1:
            best = min(((self.merges[pair][0], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [self.merges[symbols[i], symbols[i + 1]][1]]
        return symbols

    def may_follow(self, left: int, right: int) -> bool:
        """True if both stay as they are where their bytes meet."""
        known = self.follows.get((left, right))
        if known is None:
            spelt = self.bytes_of[left] + self.bytes_of[right]
            known = self.follows[left, right] = self.merged([self.byte_token[b] for b in spelt]) == [left, right]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count)."""
        chain = self.chains[state]
        flat = unpack(f"{len(chain) // 4}i", chain)
        kept, found = [], None
        for i in range(0, len(flat), 3):
            node, last, more = flat[i : i + 3]
            node = self.edges.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if found is None and token != _NONE and (last == _NONE or self.may_follow(last, token)):
                found = (token, more + 1)
            if node in self.inner:
                kept.append((node, last, more))
        token, change = found
        flat = [x for node, last, more in kept for x in (node, last, more - change)] + [0, token, 0]
        chain = pack(f"{len(flat)}i", *flat)
        number = self.numbers.get(chain)
        if number is None:
            number = self.numbers[chain] = len(self.chains)
            self.chains.append(chain)
        return number, change

    def move(self, keys: np.ndarray) -> np.ndarray:
        """(next state << 16) + 2**15 + change, for each state * 256 + byte."""
        out, unknown = self.table.find(keys)
        if len(unknown):
            fresh, which = np.unique(keys[unknown], return_inverse=True)
            made = [self.compile(k >> 8, k & 255) for k in fresh.tolist()]
            values = np.array([(s << _SHIFT) + _ZERO + c for s, c in made], np.int64)
            self.table.add(fresh, values)
            out[unknown] = values[which]
        return out

    # Words

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Kinds of code points, asked from the vocabulary's own splitter when first met."""
        out = self.kinds[points]
        if not out.all():
            if self._probe is None:
                from tokenizers.pre_tokenizers import ByteLevel

                self._probe = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
            for point in np.unique(points[out == 0]).tolist():
                self.kinds[point] = next(
                    (k for c, k in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)) if len(self._probe(c + chr(point))) == 1),
                    _SPACE if point == 0x20 else _WHITE,
                )
            out = self.kinds[points]
        return out

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True at each byte that begins a word."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.int32)
        wide = np.flatnonzero(lead >= 0x80)
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        a, w = lead[wide], at[wide]
        b, c, d = (padded[w + i] & 0x3F for i in (1, 2, 3))
        points = lead
        points[wide] = np.where(
            a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d)
        )
        n = len(at)
        kind = np.zeros(n + 4, np.uint8)  # beyond the end of all texts: no kind
        kind[:n] = self._kinds(points)
        point = np.zeros(n + 4, np.int32)
        point[:n] = points
        first = np.zeros(n + 4, bool)
        first[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
        first[n] = True
        k, last = kind[:n], first[1 : n + 1]
        before = np.where(first[:n], 0, np.concatenate([[0], kind[: n - 1]]))
        after = np.where(last, 0, kind[1 : n + 1])
        white, white_before = (k == _SPACE) | (k == _WHITE), (before == _SPACE) | (before == _WHITE)
        ends_run = white & white_before & (after > _WHITE)
        out = np.zeros(n + 4, bool)
        out[:n] = first[:n] | (white & ~white_before) | ends_run | (~white & (before != _SPACE) & (before != k))
        # An apostrophe that begins a word takes the letters of a contraction with it.
        mark = np.flatnonzero((point[:n] == _APOSTROPHE) & out[:n])
        mark = mark[~first[mark + 1]]
        one = mark[np.isin(point[mark + 1], [ord(c) for c in "stmd"])]
        two = mark[~first[mark + 2]]
        pair = point[two + 1] << 8 | point[two + 2]
        two = two[np.isin(pair, [ord(c) << 8 | ord(d) for c, d in ("re", "ve", "ll")])]
        for taken, size in ((one, 1), (two, 2)):
            out[taken + 1] = False
            out[taken + 1 + size] = True
        found = np.zeros(len(data), bool)
        found[at[out[:n]]] = True
        return found

    # Running texts

    def _run(self, data: np.ndarray, keep: np.ndarray, state: np.ndarray, changes: np.ndarray | None) -> np.ndarray:
        """Exit states of chunks that are the columns of ``data``; ``keep`` is 0 where a word begins, else -1."""
        for i in range(len(data)):
            moved = self.move((state & keep[i]) << 8 | data[i])
            state = moved >> _SHIFT
            if changes is not None:
                changes[i] = (moved & (2 * _ZERO - 1)) - _ZERO
        return state

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null is an empty text. No special strings in texts."""
        data, offsets = text_buffers(texts)
        n = len(data)
        if not n:
            return np.zeros(len(texts), np.int64)
        if len(self.chains) > MOST_STATES:
            self.forget()
        size = min(CHUNK, max(64, n // 64))
        lanes = -(-n // size)
        padded = np.zeros(lanes * size, np.int64)
        padded[:n] = data
        keep = np.zeros(lanes * size, np.int64)
        keep[:n] = self.begins(data, offsets).astype(np.int64) - 1
        columns, keeps = (np.ascontiguousarray(x.reshape(lanes, size).T) for x in (padded, keep))
        # The bytes before a chunk say where it is entered.
        warm = min(WARM_UP, size)
        entry = np.zeros(lanes, np.int64)
        entry[1:] = self._run(columns[size - warm :, :-1], keeps[size - warm :, :-1], entry[1:], None)
        changes = np.zeros((size, lanes), np.int16)
        leave = self._run(columns, keeps, entry, changes)
        changes = np.ascontiguousarray(changes.T).reshape(-1)
        self._compose(padded, keep, entry, leave, changes, size)
        sums = np.concatenate([[0], np.cumsum(changes[:n], dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def _compose(self, data, keep, entry, leave, changes, size) -> None:
        """Extend the maps of chunks that were entered otherwise than their predecessor is left."""
        lane, state, lanes = 0, None, len(entry)
        wrong = set(np.flatnonzero(leave[:-1] != entry[1:]) + 1)
        for start in sorted(wrong):
            if start < lane:
                continue
            lane, state = start, int(leave[start - 1])
            while lane < lanes and state != entry[lane]:
                for at in range(lane * size, (lane + 1) * size):
                    moved = int(self.move(np.array([(state & int(keep[at])) << 8 | int(data[at])]))[0])
                    state = moved >> _SHIFT
                    changes[at] = (moved & (2 * _ZERO - 1)) - _ZERO
                entry[lane], leave[lane] = -1, state
                lane += 1

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text as the vocabulary's library counts them, special strings included."""
        if not self.specials:
            return self.counts(texts)
        values = texts.to_pylist()
        special = [i for i, t in enumerate(values) if t and any(s in t for s in self.specials)]
        if not special:
            return self.counts(texts)
        parts, owner, extra = [], [], np.zeros(len(values), np.int64)
        for i in special:
            pieces = _without(values[i], self.specials)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
            values[i] = ""
        out = self.counts(pa.array(values, pa.string())) + extra
        np.add.at(out, owner, self.counts(pa.array(parts, pa.string())))
        return out


def _without(text: str, specials: list[str]) -> list[str]:
    """What lies between the leftmost, longest special strings of a text."""
    out, at = [], 0
    while True:
        found = [(text.find(s, at), -len(s), s) for s in specials if text.find(s, at) >= 0]
        if not found:
            return [*out, text[at:]]
        place, _, special = min(found)
        out.append(text[at:place])
        at = place + len(special)


_known: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer, with all states it has compiled so far."""
    if path not in _known:
        _known[path] = Transducer(path)
    return _known[path]


def token_counts(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024
) -> DataFrame:
    """One row for each row: ``id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is a byte-level BPE file that workers can read; other kinds are refused.
    Counts are those of the tokenizers library without added begin or end tokens; special
    strings inside a text count as their token. A null text is empty and has no tokens. Null
    ids stay null, repeated rows give equal rows, other columns are ignored; an empty table
    gives an empty result. Nothing is shuffled.
    """
    if not os.path.isfile(vocabulary):
        raise FileNotFoundError(vocabulary)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for part in chunks(batches, "text", BATCH_BYTES):
            column = part.column("text")
            _, offsets = text_buffers(column)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(offsets)), pa.array(machine.count(column))], ["id", "n_bytes", "n_tokens"]
            )

    counted = rows.mapInArrow(task, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
