"""Training passages that copy or paraphrase test items: rare seeds, then alignment.

1. The n-grams of the items are counted in the documents. Those that occur nowhere tell
   nothing. A rare one is a seed: few documents hold it, or few pairs of a document and an
   item share it. Where a block of an item has no rare one, the rarest that occurs is. So
   every block of an item keeps a seed, and a phrase that many items share proposes nothing.
2. A document's n-grams are looked up among the seeds, which workers map into memory as
   sorted hash arrays. The hits of an item propose stretches of the document.
3. A stretch that holds too few of the item's words, in any order, cannot reach the
   share and is passed over. Smith-Waterman alignment scores the others against the
   whole item; edited words, gaps and insertions cost, and the score is a share of a
   perfect copy's.

No document is shuffled: its rows are made where it is read. An item's words are stored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab.llm.counting import shard_bits
from matchlab.llm.storage import HashArrays, mapped, new_file, shard_of
from matchlab.llm.words import chunks, cut, mix, windows
from matchlab.session import drop_durable, durable

GRAM = 3
#: A block of an item without a rare n-gram has its rarest one as seed.
BLOCK = 4
#: An n-gram is rare if at most so many documents hold it, as a number or a share of all,
RARE_DOCUMENTS, RARE_SHARE = 100, 1 / 1000
#: or if its documents times its items are at most this share of all documents.
PAIR_SHARE = 1 / 20
SHARE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

_HITS = "item_id long, share double, start long, end long"


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local score, start, end) of ``item`` within ``text``; end exclusive.

    Holds one row of the table. A cell is its score with the place where its alignment
    begins below it, so both move together; gaps within a row are a running maximum.
    """
    unit = 1 << 32
    places = np.arange(len(text) + 1, dtype=np.int64)
    fresh = unit - 1 - places
    slope = -GAP * unit * places
    row, best, end = fresh, 0, 0
    for word in item:
        step = np.where(text == word, MATCH * unit, MISMATCH * unit)
        down = np.maximum(row + GAP * unit, fresh)
        down[1:] = np.maximum(down[1:], row[:-1] + step)
        row = np.maximum(np.maximum.accumulate(down + slope) - slope, fresh)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best // unit, unit - 1 - best % unit, end


def _item_key(item: np.ndarray, body: np.ndarray) -> np.ndarray:
    """One key for an item's id and the hash of its words."""
    return mix(mix(item.view(np.uint64)) + body.view(np.uint64))


def _item_words(items: DataFrame) -> DataFrame:
    """(key, item_id, words): the hashes of an item's words, once for each distinct item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = cut(part.column("text"), plain=True)
            raw, ends = words.hashes().tobytes(), (8 * words.firsts()).tolist()
            bodies = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("item_id"), bodies], ["item_id", "words"])

    cut_ = items.mapInArrow(task, "item_id long, words binary").where(F.octet_length("words") >= 8 * GRAM)
    keyed = cut_.select("item_id", F.xxhash64("words").alias("body"), "words").dropDuplicates(["item_id", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _item_key(batch.column("item_id").to_numpy(), batch.column("body").to_numpy())
            yield batch.append_column("key", pa.array(key.view(np.int64)))

    return keyed.mapInArrow(add, "item_id long, body long, words binary, key long").select("key", "item_id", "words")


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram, key, place) of every n-gram of every item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist()):
                hashes = np.frombuffer(words, np.uint64)
                run, _ = windows(hashes, np.zeros(len(hashes), np.int64), GRAM)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run.view(np.int64)), pa.array(np.full(len(run), key)), pa.array(np.arange(len(run)))], ["gram", "key", "place"]
                )

    return items.mapInArrow(task, "gram long, key long, place long")


def _stored(rows: DataFrame, column: str, bits: int, store) -> int:
    """Run ``store(shard, rows)`` for the rows of each shard of the keys in ``column``; how many rows there were."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def numbered(batches):
        for batch in batches:
            shard = shard_of(batch.column(column).to_numpy().view(np.uint64), bits)
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    def task(key, part):
        store(int(key[0]), part)
        return pd.DataFrame({"n": [len(part)]})

    spread = rows.mapInArrow(numbered, f"{schema}, shard int")
    return spread.groupBy("shard").applyInPandas(task, "n long").agg(F.sum("n")).first()[0] or 0


def _document_counts(docs: DataFrame, grams: HashArrays) -> DataFrame:
    """(gram, docs): in how many documents each n-gram of an item occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for part in chunks(batches, "text"):
            words = cut(part.column("text"), plain=True)
            run, valid = windows(words.hashes(), words.text, GRAM)
            at = np.flatnonzero(valid)
            distinct, which = np.unique(run[at], return_inverse=True)
            found = grams.find(distinct)[0]
            hit = found[which]
            pairs = np.unique(words.text[at][hit] * np.int64(len(distinct)) + which[hit])
            counts = np.bincount(pairs % max(1, len(distinct)), minlength=len(distinct))
            for gram, n in zip(distinct[found].view(np.int64).tolist(), counts[found].tolist()):
                held[gram] = held.get(gram, 0) + n
            if len(held) > 500_000:
                yield _counted(held)
                held = {}
        if held:
            yield _counted(held)

    return docs.select("text").mapInArrow(task, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def _counted(held: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()))], ["gram", "docs"])


def _chosen(grams: DataFrame, counts: DataFrame, documents: int) -> DataFrame:
    """(gram, key, place) of the seeds: rare n-grams that occur, and the rarest of blocks that have none."""
    items = grams.groupBy("gram").agg(F.countDistinct("key").alias("items"))
    rated = grams.join(counts.join(items, "gram"), "gram").withColumn("block", F.expr(f"place div {BLOCK}"))
    pairs = F.col("docs") * F.col("items")
    rare: Column = (F.col("docs") <= max(RARE_DOCUMENTS, documents * RARE_SHARE)) | (pairs <= documents * PAIR_SHARE)
    block = Window.partitionBy("key", "block")  # at most BLOCK rows
    least = F.min(F.struct(pairs.alias("pairs"), F.col("place").alias("place"))).over(block)
    marked = rated.withColumns({"rare": rare, "least": least}).withColumn("any", F.max("rare").over(block))
    return marked.where("rare or (not any and least.place = place)").select("gram", "key", "place")


class _Seeds:
    """Seeds as hash arrays: gram to its places in items, and each item's words, stored once."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.grams = HashArrays(f"{folder}/grams", bits, {"first": "<i8", "n": "<i8"})
        self.places = HashArrays(f"{folder}/places", bits, {"key": "<i8", "place": "<i8"})
        self.items = HashArrays(f"{folder}/items", bits, {"item": "<i8", "first": "<i8", "size": "<i8"})

    def _words_path(self, shard: int) -> str:
        return f"{self.folder}/words/shard-{shard:06d}.bin"

    def write_items(self, shard: int, rows: pd.DataFrame) -> None:
        rows = rows.assign(u=rows["key"].to_numpy().view(np.uint64)).sort_values("u")
        sizes = rows["words"].str.len().to_numpy() // 8
        self.items.write(shard, rows["u"].to_numpy(), {"item": rows["item_id"].to_numpy(), "first": np.cumsum(sizes) - sizes, "size": sizes})
        with new_file(self._words_path(shard)) as stream:
            for words in rows["words"]:
                stream.write(words)

    def write_places(self, shard: int, rows: pd.DataFrame) -> None:
        rows = rows.assign(u=rows["gram"].to_numpy().view(np.uint64)).sort_values(["u", "key", "place"])
        keys, first, n = np.unique(rows["u"].to_numpy(), return_index=True, return_counts=True)
        self.grams.write(shard, keys, {"first": first, "n": n})
        self.places.write(shard, rows["u"].to_numpy(), {"key": rows["key"].to_numpy(), "place": rows["place"].to_numpy()})

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``grams``, item key, place in the item) of every hit."""
        distinct, which = np.unique(grams, return_inverse=True)
        found, got = self.grams.find(distinct)
        n = np.where(found, got["n"], 0)[which]
        index = np.repeat(np.arange(len(grams)), n)
        row = np.repeat(got["first"][which] - (np.cumsum(n) - n), n) + np.arange(len(index))
        shard = shard_of(grams[index], self.bits)
        key, place = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for number in np.unique(shard).tolist():
            at = np.flatnonzero(shard == number)
            own = self.places.shard(number)[1]
            key[at], place[at] = own["key"][row[at]], own["place"][row[at]]
        return index, key, place

    def owners(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Item id, size and first word of sorted distinct item keys."""
        return self.items.find(keys.view(np.uint64))[1]

    def words(self, key: int, first: int, size: int) -> np.ndarray:
        shard = int(shard_of(np.array([key]).view(np.uint64), self.bits)[0])
        if shard not in _mapped.setdefault(self.folder, {}):
            _mapped[self.folder][shard] = mapped(self._words_path(shard)).view("<u8")
        return _mapped[self.folder][shard][first : first + size]


#: Words of items that this worker has mapped, by folder and shard.
_mapped: dict[str, dict[int, np.ndarray]] = {}


def _seeds(docs: DataFrame, items: DataFrame, folder: str) -> _Seeds | None:
    """Write the seeds of ``items`` (item_id, text) chosen by their frequency in ``docs`` (text)."""
    bits = shard_bits(docs.sparkSession)
    seeds = _Seeds(folder, bits)
    items = durable(_item_words(items))
    if not _stored(items, "key", bits, seeds.write_items):
        return None
    grams = durable(_item_grams(items))
    every = HashArrays(f"{folder}/every", bits, {})
    _stored(grams.select("gram").distinct(), "gram", bits, lambda shard, rows: every.write(shard, np.sort(rows["gram"].to_numpy().view(np.uint64)), {}))
    counts = durable(_document_counts(docs, every))
    found = _stored(_chosen(grams, counts, docs.count()), "gram", bits, seeds.write_places)
    for table in (counts, grams, items):
        drop_durable(table)
    return seeds if found else None


def _stretches(at: np.ndarray, place: np.ndarray, size: int, n_words: int, share: float) -> list[tuple[int, int]]:
    """Parts of a document that may hold an item, from where its seeds were hit."""
    # So many words can be inserted before the rest of a perfect copy falls below the share.
    slack = int((1 - share) * MATCH * size / -GAP) + 2
    out: list[list[int]] = []
    for start in np.unique(at - place).tolist():
        low, high = max(start - slack, 0), min(start + size + slack, n_words)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _found(part: pa.RecordBatch, seeds: _Seeds, share: float):
    """(text, item, share, start, end) of each item's best copy in each text."""
    words = cut(part.column("text"), plain=True)
    hashes, first, counts = words.hashes(), words.firsts(), words.counts()
    run, valid = windows(hashes, words.text, GRAM)
    at = np.flatnonzero(valid)
    index, key, place = seeds.hits(run[at])
    if not len(index):
        return
    at = at[index]
    text = words.text[at]
    order = np.lexsort((key.view(np.uint64), text))
    text, at, key, place = text[order], (at - first[text])[order], key[order], place[order]
    distinct, which = np.unique(key.view(np.uint64), return_inverse=True)
    own = seeds.owners(distinct)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(text) != 0) | (np.diff(which) != 0)
    low = np.flatnonzero(fresh)
    high = np.append(low, len(order))[1:]
    # A text with fewer words than the share asks for holds no copy.
    long_enough = counts[text[low]] >= share * own["size"][which[low]]
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(low[long_enough].tolist(), high[long_enough].tolist()):
        t, w = int(text[a]), which[a]
        item = int(own["item"][w])
        body = seeds.words(int(key[a]), int(own["first"][w]), int(own["size"][w]))
        around = hashes[first[t] : first[t + 1]]
        for start, end in _stretches(at[a:b], place[a:b], len(body), int(counts[t]), share):
            # No alignment matches more words of the item than the stretch holds at all.
            if np.count_nonzero(np.isin(body, around[start:end])) < share * len(body):
                continue
            score, from_, to = align(body, around[start:end])
            reached = score / (MATCH * len(body))
            if score >= share * MATCH * len(body) and ((t, item) not in best or reached > best[t, item][0]):
                best[t, item] = (reached, start + from_, start + to)
    for owner, found in best.items():
        yield (*owner, *found)


def _prepared(docs: DataFrame, items: DataFrame, folder: str, text_column: str, item_column: str, item_text: str) -> _Seeds | None:
    wanted = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    return _seeds(docs.select(F.col(text_column).alias("text")), wanted, folder)


def contaminated(
    docs: DataFrame, items: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", share: float = SHARE,
) -> DataFrame:
    """One row for each document and item it copies: ``doc_id, item_id, share, start, end``.

    ``share`` is the alignment's part of a perfect copy's score, at least the limit;
    ``start`` and ``end`` are the words of the document it spans. Words here are runs of
    letters, digits and characters outside ASCII, compared in lower case. Documents without a hit give no row. A copy is found
    if a seed of its item survives in it: any three words in a row that are rare, or the
    rarest of a block of ``BLOCK`` where none are.
    Items of fewer than three words, null texts and items without id match nothing;
    repeated items and rows count each; a null document id stays null. Extra columns are
    ignored. ``folder`` lies on the shared store and receives the seeds.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    seeds = _prepared(docs, items, folder, text_column, item_column, item_text)
    schema = f"doc_id long, {_HITS}"
    if seeds is None:
        return docs.sparkSession.createDataFrame([], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hits = list(_found(part, seeds, share))
            if hits:
                text, *rest = zip(*hits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), *map(pa.array, rest)],
                    ["doc_id", "item_id", "share", "start", "end"],
                )

    return rows.mapInArrow(task, schema)


def clean(
    docs: DataFrame, items: DataFrame, folder: str, text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", share: float = SHARE,
) -> DataFrame:
    """The rows of ``docs``, all columns, that copy no item."""
    seeds = _prepared(docs, items, folder, text_column, item_column, item_text)
    if seeds is None:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.col(text_column).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            keep = np.ones(part.num_rows, bool)
            keep[[hit[0] for hit in _found(part, seeds, share)]] = False
            yield part.select(["own"]).filter(pa.array(keep))

    own = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(task, f"own struct<{own}>").select(*(F.col("own")[c].alias(c) for c in docs.columns))
