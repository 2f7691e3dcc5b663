"""Importance resampling, token counts by transducer and spelling variants against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlab.llm import fst_tokens, resampling, spelling
from matchlab.llm.crc import add_byte, crc32
from matchlab.llm.queries import VOCABULARY
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_checksums():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    spans = [(a, a + rng.choice([0, 1, 2, 7, 47, 48, 49, 300])) for a in (rng.randrange(4000) for _ in range(300))]
    start, end = (np.array(x) for x in zip(*spans))
    first = np.array([rng.randrange(1 << 32) for _ in spans], np.uint32)
    flat = np.frombuffer(data, np.uint8)
    assert crc32(flat, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert crc32(flat, start, end, first).tolist() == [zlib.crc32(data[a:b], int(v)) for (a, b), v in zip(spans, first)]
    assert add_byte(first, 0x20).tolist() == [zlib.crc32(b" ", int(v)) for v in first]


# Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, n):
    words = WORD.findall((text or "").translate(brute.LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _resampled(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for text in texts for f in _features(text, n)) for texts in ([t for _, t in rows], target))
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)
    }
    out = []
    for ident, text in rows:
        found = _features(text, n)
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if ident is not None:
            h = int(hashlib.sha256(f"2024:{ident}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([ident, len(_features(text, 1)), len(found), weight, score, None])
    pool = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for place, row in enumerate(pool[: len(pool) * percent // 100], 1):
        row[5] = place
    return out


def _plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


TARGET = [None, "", "w1 w2 w3\nw4 the É a b c d", "W7 w7 w8-w9, w10"]


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (3, 97)])
def test_resample(spark, docs, n, buckets):
    rows = [(i, t) for i, t in enumerate(brute.texts())]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TARGET)], "item_id long, text string, bucket string")
    got = resampling.resample(docs, target, n=n, buckets=buckets, percent=30, least_words=5)
    assert _plain(got.collect()) == _plain(_resampled(rows, TARGET, n, buckets, 30, 5))


def test_resample_repeated_rows_and_null_ids(spark, monkeypatch):
    """Copies of a row have ranks of their own, also when they come in several blocks and lines are frequent."""
    monkeypatch.setattr(resampling, "_COPIES", 3)
    monkeypatch.setattr(resampling, "FREQUENT", 4)
    line = "w1 w2 w3 w4 w5"
    rows = [(5, f"{line}\n{line}\n\nw{9}")] * 10 + [(i % 7, f"{line}\n{line} w{i}") for i in range(40)] + [(None, line)] * 4 + [(8, line)] * 2
    target = spark.createDataFrame([(line,)], "text string")
    got = resampling.resample(brute.documents(spark, rows), target, n=2, buckets=50, percent=60, least_words=5)
    assert _plain(got.collect()) == _plain(_resampled(rows, [line], 2, 50, 60, 5))


def test_resample_empty(spark, docs, none):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).collect() == []
    rows = [(i, t) for i, t in enumerate(brute.texts())]
    got = resampling.resample(docs, target, percent=50, least_words=1)
    assert _plain(got.collect()) == _plain(_resampled(rows, [], 1, 10_000, 50, 1))


def test_lines_are_counted_once(spark):
    rows = [(i, "a b\nc d\n" + "a b\n" * 3) for i in range(20)]
    lines = resampling._lines(spark.createDataFrame(rows, "id long, text string"), 1, 100)
    assert sorted((r.times, r.n_words) for r in lines.collect()) == [(20, 2), (80, 2)]


# Token counts

PIECES = (
    "a b the ing tion ' 's 're 'll 'v 'r 'd don't 1 22 ! ... é ü 中文 日本 🙂 ß İ ² ٣ े <|endoftext|> <| 'S aaaa ‍ \x1c \x85".split(" ")
    + [" ", "  ", "\n", "\t", " ", "　", "\xa0", " th", "    ", "\r\n", "\x0b"]
)


def _texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(1500)]
    letters = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    return [None, "", *out, "a" * 5000, " " * 3000 + "x", "ab" * 3000, "\n" * 1000, "中" * 3000, letters, "<|endoftext|>" * 3]


def test_transducer_counts_like_the_library():
    encode = Tokenizer.from_file(VOCABULARY).encode
    texts = _texts()
    got = fst_tokens.Transducer(VOCABULARY).count(pa.array(texts, pa.string())).tolist()
    assert got == [len(encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_transducer_repairs_wrong_entries(monkeypatch):
    """Without bytes to warm up on, every chunk inside a word is entered wrongly at first."""
    monkeypatch.setattr(fst_tokens, "WARM_UP", 1)
    monkeypatch.setattr(fst_tokens, "MOST_STATES", 50)
    encode = Tokenizer.from_file(VOCABULARY).encode
    machine = fst_tokens.Transducer(VOCABULARY)
    for text in ("a" * 4001, "abcdefghij" * 700, "".join(random.Random(2).choice("etaoin") for _ in range(9000))):
        assert machine.count(pa.array([text, "x y"])).tolist() == [len(encode(text).ids), 2]


def test_token_counts(spark, none):
    encode = Tokenizer.from_file(VOCABULARY).encode
    rows = [(i if i % 9 else None, t) for i, t in enumerate(_texts()[:300])] * 2 + [(-1, "word " * 2000)]
    got = fst_tokens.token_counts(brute.documents(spark, rows), VOCABULARY)
    want = []
    for ident, text in rows:
        n = len(encode(text or "", add_special_tokens=False).ids)
        want.append((ident, len((text or "").encode()), n, n > 1024))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert _plain(got.collect()) == _plain(want)
    assert fst_tokens.token_counts(none, VOCABULARY).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        fst_tokens.Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_table():
    rng = np.random.default_rng(1)
    table, keys = fst_tokens.Table(4), np.unique(rng.integers(0, 1 << 40, 5000))
    for part in np.array_split(keys, 7):
        table.add(part, part * 3)
    values, unknown = table.find(keys)
    assert not len(unknown) and (values == keys * 3).all()
    assert len(table.find(np.array([-5, -6]))[1]) == 2


# Spelling variants


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _vocabulary(seed, n, alphabet="abé", low=5, high=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_composition_finds_each_pair_once(seed):
    words = _vocabulary(seed, 150) + (["aaaaaaaaaaaa"] if seed else [])
    words = sorted(set(words) | {"abéab"})
    left, right = spelling.Acceptor(words).near()
    got = [tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())]
    assert sorted(got) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _one_edit(words[i], words[j])]


def test_acceptor_is_minimal():
    assert len(spelling.Acceptor(["bat", "bats", "cat", "cats", "rat", "rats"]).arcs) == 5


def _variants(counts):
    near = {w: [v for v in counts if _one_edit(v, w)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None))
    return out


@pytest.mark.parametrize("partition", [1, 8, 10_000])
def test_near_words_in_partitions_of_any_size(spark, tmp_path, partition):
    rng = random.Random(partition)
    counts = {w: 3 + rng.randrange(40) for w in _vocabulary(7, 250) + ["a" * 300, "a" * 301]}
    path = str(tmp_path / "words")
    spark.createDataFrame(list(counts.items()), "word string, n long").write.parquet(path)
    got = spelling.near_words(spark.read.parquet(path), partition).collect()
    want = {w: (n, near) for w, _, _, n, near, _ in _variants(counts)}
    assert {r.word: (r.n, r.n_near) for r in got} == want and len(got) == len(want)


def _by_hand(rows, one_in=97):
    counts = collections.Counter()
    for ident, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_variants(spark, none):
    rng = random.Random(3)
    words = _vocabulary(1, 60, "abcdeÀ×") + ["Colour", "color", "colours", "straße", "x", "e", "É" * 60]
    rows = [(rng.choice([None, i, 7]), " ".join(rng.choice(words) + rng.choice(["", "-", "1", "日"]) for _ in range(40))) for i in range(300)]
    rows += [(1, None), (2, ""), *rows[:50]]
    counts = _by_hand(rows, 7)
    got = spelling.spelling_variants(brute.documents(spark, rows), one_in=7, partition=20)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert _plain(got.collect()) == _plain(_variants(counts))
    assert spelling.spelling_variants(none).collect() == []


def test_chains_of_forms(spark):
    chain = ["abcde" + "f" * i for i in range(12)]
    rows = [(i, f"{w} " * (3 * 2**i)) for i, w in enumerate(chain)]
    got = {r.word: r.root for r in spelling.spelling_variants(brute.documents(spark, rows), one_in=10**9).collect()}
    assert set(got) == set(chain) and set(got.values()) == {chain[-1]}
