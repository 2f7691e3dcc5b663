"""Token ids of whole text columns with a public byte-level BPE vocabulary.

The vocabulary splits a text before it merges bytes, and never joins a character
that is no white space with white space after it. So a text may be cut before every
run of white space, each distinct piece is encoded once, and the ids of the pieces
in order are the ids of the text. Only the tokenizers library encodes.

The pattern of the ``ByteLevel`` splitter also ends a run of letters at every other
character (a contraction begins with its apostrophe). Under it texts are cut after a
letter of the common alphabets before an ASCII sign or digit too, so that a word is one
piece whatever follows it, and a space with letters needs no pattern to be split.
"""

from __future__ import annotations

import codecs
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from matchlab.llm.words import _SEPARATOR, text_buffers

CHUNK_BYTES = 6 << 20
KEPT_PIECES = 800_000

# Letters of one or two bytes (Latin, Greek, Cyrillic).
_ALPHABETS = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x47F)]
_LETTER = np.zeros(0x800, bool)
for _first, _last in _ALPHABETS:
    _LETTER[_first : _last + 1] = True
_TWO = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8\xd0\xd1][\x80-\xbf]|\xc9[\x80-\x8f]|\xce[\x91-\xa1\xa3-\xbf]|\xcf[\x80-\x8e]"
# Characters that no white space outside ASCII starts with; ASCII signs and digits.
_REST, _SIGNS = rb"[\x00-\x08\x0e-\x1f\x21-\xc1\xc3-\xe0\xe4-\xff]", rb"[\x00-\x08\x0e-\x1f\x21-\x40\x5b-\x60\x7b-\x7f]"
# A space and letters; white space and others; a sign up to an ASCII letter.
_PLAIN = re.compile(rb"( (?:[A-Za-z]++|" + _TWO + rb")++)|([ \t-\r]+" + _REST + rb"+)|(" + _SIGNS + _REST + rb"*[A-Za-z])")
_WORD, _SPACED, _SIGN = 1, 2, 3
# White space outside ASCII.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
# A byte opens a piece if it shares a bit with what the byte before it allows. 1: white space
# after others; 2: a sign after an ASCII letter; 4 and 8: a sign and white space after a byte
# outside ASCII, to be looked at.
_OPENS, _AFTER = bytearray(256), bytearray(b"\1" * 128 + b"\15" * 128)
for _byte in range(128):
    _OPENS[_byte] = 9 if _SEPARATOR[_byte] else 0 if _LETTER[_byte] else 6
    _AFTER[_byte] = 0 if _SEPARATOR[_byte] else 3 if _LETTER[_byte] else 1
_known: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The task's encoder for a vocabulary file, kept as long as the worker lives."""
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Metaspace

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are plain text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        splitter = self.tokenizer.pre_tokenizer
        self.by_letters = (
            isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space and self.tokenizer.normalizer is None
        )
        self.after = bytes(_AFTER if self.by_letters else (b & 9 for b in _AFTER))
        # The same model for words written in the vocabulary's characters, each from its space on.
        alphabet = set(ByteLevel.alphabet())
        others = iter(sorted(c for c in alphabet if ord(c) > 255))
        self.characters = "".join(c if (c := chr(b)) in alphabet else next(others) for b in range(256))
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = Metaspace(replacement=self.characters[32], prepend_scheme="never", split=True)
        # Pieces met lately, and those met before them; a piece met again moves up.
        self.fresh: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian bytes."""
        if len(self.fresh) > KEPT_PIECES // 2:
            self.older, self.fresh = self.fresh, {}
        fresh, older = self.fresh, self.older
        coded = list(map(fresh.get, distinct))
        places = [place for place, ids in enumerate(coded) if ids is None]
        unknown = []
        for place in places:
            piece = distinct[place]
            known = older.get(piece)
            if known is None:
                unknown.append(piece)
            else:
                fresh[piece] = known
        self._learn(unknown)
        for place in places:
            coded[place] = fresh[distinct[place]]
        return coded

    def _learn(self, pieces: list[bytes]) -> None:
        kinds = defaultdict(list)
        for piece in pieces:
            hit = _PLAIN.fullmatch(piece)
            kinds[hit and hit.lastindex].append(piece)
        others = kinds[None]
        if self.by_letters:
            self._learn_joined(self.of_words, kinds[_WORD], lambda raw: codecs.charmap_decode(raw, "strict", self.characters)[0])
            self._learn_joined(self.tokenizer, kinds[_SIGN] + kinds[_SPACED])
        else:
            self._learn_joined(self.tokenizer, kinds[_WORD] + kinds[_SPACED])
            others += kinds[_SIGN]
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                self.fresh[piece] = np.array(e.ids, "<u4").tobytes()

    def _learn_joined(self, tokenizer, pieces: list[bytes], decode=bytes.decode) -> None:
        """Pieces that follow each other as in a text; the ids' lengths show where each ends."""
        for at in range(0, len(pieces), 512):
            some = pieces[at : at + 512]
            ids = np.array(tokenizer.encode_batch_fast([decode(b"".join(some))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            stops = 4 * (np.searchsorted(ends, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))) + 1)
            self.fresh.update(zip(some, _cut(ids.tobytes(), np.append(0, stops))))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]].

        A null is an empty text. ``end_id`` is added after every text.
        """
        data, offsets = text_buffers(texts)
        if len(data):
            ids, counts = self._encode(data, offsets)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        out = np.concatenate([[0], np.cumsum(counts)])
        if end_id is not None:
            ids = np.insert(ids, out[1:], np.uint32(end_id))
            out = out + np.arange(len(out))
        return ids, out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        marks = np.frombuffer(raw.translate(_OPENS), np.uint8).copy()
        marks[1:] &= np.frombuffer(raw.translate(self.after), np.uint8)[:-1]
        marks[0] = 1
        opens = (marks & 3) != 0
        unsure = np.flatnonzero(marks >= 4)
        opens[_after_wide_space(data, unsure[marks[unsure] == 9])] = False
        opens[_after_letter(data, unsure[marks[unsure] == 4])] = True
        starts = offsets[:-1]
        opens[starts[starts < len(data)]] = True
        at = np.flatnonzero(opens)
        bounds = np.append(at, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        _, ends, raw = pieces.dictionary.buffers()
        distinct = _cut(raw.to_pybytes(), np.frombuffer(ends, np.int32, len(pieces.dictionary) + 1))
        coded = self._ids(distinct)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        which = pieces.indices.to_numpy()
        length = sizes[which]
        ends = np.cumsum(length)
        first = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.repeat(first - (ends - length), length) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return ids, np.diff(upto)


def _cut(raw: bytes, bounds: np.ndarray) -> list[bytes]:
    """The stretches of ``raw`` between neighbouring bounds."""
    at = bounds.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` that follow a white space outside ASCII: no cut there."""
    bad = np.zeros(len(at), bool)
    for code in _WIDE_SPACES:
        same = at >= len(code)
        for i, byte in enumerate(reversed(code)):
            same &= data[np.maximum(at - 1 - i, 0)] == byte
        bad |= same
    return at[bad]


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` that follow a letter of two bytes."""
    lead = data[at - 2]
    code = (lead & 0x1F).astype(np.int64) << 6 | data[at - 1] & 0x3F
    return at[(lead >= 0xC2) & (lead < 0xE0) & _LETTER[code]]
