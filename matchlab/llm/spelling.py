"""Words that differ by one edit, by composing acceptors.

The vocabulary is a minimal acceptor A, E a transducer that makes exactly one edit. A pair
of near words is an accepted path of A o E o A. A path starts on the diagonal, where both
words have been the same so far, leaves it with its edit, and then both sides read the same
rest. So the pairs split by the diagonal state at which the edit is made.

1. From the initial state the diagonal is unfolded breadth first. The edits at the states
   passed are found by equal rests: words with one place left open meet in a small group.
2. Below a depth the diagonal states are partitions. A partition of bounded size is
   enumerated by one task: the minimal acceptor of its words, and for each of its states the
   common rests of what follows two of its arcs (replacement) or an arc and the state itself
   (insertion). Rests are numbered by rank, so pairs are ranges of numbers.
3. A partition beyond the bound is unfolded further, twice as deep each time.

An edit in a run of equal letters is told at its last place only, so each pair is met once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab.llm.crc import crc32
from matchlab.llm.words import chunks, text_buffers
from matchlab.session import drop_durable, durable

LETTERS = 5
TIMES = 3
RATIO = 2
ONE_IN = 97
#: Words of one partition that a task enumerates at most.
PARTITION = 10_000
#: Partitions beyond that are named by broadcast up to this many, else by a shuffled join.
MOST_BROADCAST = 100_000
_HELD = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# Vocabulary


def _words(ids: list[str], texts: pa.Array, one_in: int, letters: int) -> pa.Array:
    """All words of some texts, every ``one_in``-th (by checksum) with one letter left out."""
    raw, offsets = text_buffers(texts)
    data = _LOWER[raw]
    wide = raw == 0xC3  # leads U+00C0 to U+00FF, and nothing else
    inside = _LETTER[raw] | wide
    inside[1:] |= wide[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    value = crc32(data, start, end, prefix[text])
    hit = value % np.uint32(one_in) == 0
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    whole = ~hit & (points[end] - points[start] >= letters)
    edited = []
    for i in np.flatnonzero(hit).tolist():
        run = data[start[i] : end[i]].tobytes().decode()
        at = int(value[i]) % len(run)
        if len(run) > letters:
            edited.append(run[:at] + run[at + 1 :])
    size = (end - start)[whole]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.repeat(start[whole] - bounds[:-1], size) + np.arange(bounds[-1])
    plain = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(data[place]))
    return pa.chunked_array([plain, pa.array(edited, pa.large_string())])


def vocabulary(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", one_in: int = ONE_IN, letters: int = LETTERS,
    times: int = TIMES,
) -> DataFrame:
    """(word, n): every word of ``letters`` letters or more that occurs ``times`` times or more."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))

    def total(parts: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return summed.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(100_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in chunks(batches, "text"):
            found = pc.value_counts(_words(part.column("id").to_pylist(), part.column("text"), one_in, letters))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size > _HELD:
                held = [total(held)]
                size = held[0].num_rows
                if size > _HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(total(held))

    counted = rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= times)


# The composition within one partition


class Acceptor:
    """The minimal acceptor of sorted distinct words.

    ``arcs[s]`` maps a letter to (state, words before those of that arc); a state's words are
    numbered in order, the empty rest first. Arcs lead to states of smaller number.
    """

    def __init__(self, words: list[str], skip: int = 0):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, list]] = [(False, [])]
        previous = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((previous[len(path) - 1], self._state(known, final, arcs)))

        for word in words:
            word = word[skip:]
            common, most = 0, min(len(word), len(previous))
            while common < most and word[common] == previous[common]:
                common += 1
            close(common)
            path += [(False, []) for _ in range(len(word) - common)]
            path[-1] = (True, path[-1][1])
            previous = word
        close(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict, final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        number = known.get(key)
        if number is None:
            number = known[key] = len(self.arcs)
            before, numbered = int(final), {}
            for letter, target in arcs:
                numbered[letter] = (target, before)
                before += self.size[target]
            self.final.append(final)
            self.arcs.append(numbered)
            self.size.append(before)
        return number

    def common(self, left: int, right: int) -> list[tuple[int, int, int]]:
        """(rank from left, rank from right, how many in a row) of the rests of both states."""
        out, stack = [], [(left, right, 0, 0)]
        while stack:
            a, b, x, y = stack.pop()
            if a == b:
                out.append((x, y, self.size[a]))
                continue
            if self.final[a] and self.final[b]:
                out.append((x, y, 1))
            one, other = self.arcs[a], self.arcs[b]
            for letter in one.keys() & other.keys():
                s, i = one[letter]
                t, j = other[letter]
                stack.append((s, t, x + i, y + j))
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all pairs of accepted words one edit apart, each pair once."""
        kept: list[np.ndarray | None] = []
        memo: dict[tuple[int, int], list] = {}

        def common(a: int, b: int) -> list:
            if a > b:
                return [(y, x, n) for x, y, n in common(b, a)]
            if (a, b) not in memo:
                memo[a, b] = self.common(a, b)
            return memo[a, b]

        none = np.zeros((0, 3), np.int64)
        for state, arcs in enumerate(self.arcs):
            own = []
            items = list(arcs.items())
            for i, (letter, (s, x)) in enumerate(items):
                for _, (t, y) in items[i + 1 :]:
                    own += [(x + a, y + b, n) for a, b, n in common(s, t)]
                # One letter more: the rest after it is a rest of this state that begins otherwise.
                if self.final[s] and self.final[state]:
                    own.append((x, 0, 1))
                after = self.arcs[s]
                for other, (t, y) in items:
                    if other != letter and other in after:
                        r, z = after[other]
                        own += [(x + z + a, y + b, n) for a, b, n in common(r, t)]
            below = [kept[s] + np.array([x, x, 0]) for s, x in arcs.values() if len(kept[s])]
            if own:
                below.append(np.array(own, np.int64))
            kept.append(np.concatenate(below) if below else none)
        found = kept[self.start]
        count = found[:, 2]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(found[:, 0], count) + step, np.repeat(found[:, 1], count) + step


_NEAR = "word string, n long, n_near long, best struct<less: long, form: string>"


def _enumerated(words: list[str], times: np.ndarray, skip: int) -> pa.RecordBatch:
    """Near words of one partition: for each word how many, and the most frequent of them."""
    left, right = Acceptor(words, skip).near()
    one, other = np.concatenate([left, right]), np.concatenate([right, left])
    # Places by falling count, then in the words' own order.
    order = np.lexsort((np.arange(len(words)), -times))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, one, place[other])
    near = np.bincount(one, minlength=len(words))
    at = np.flatnonzero(near)
    form = order[best[at]]
    names = pa.array(words, pa.string())
    chosen = pa.StructArray.from_arrays([pa.array(-times[form]), names.take(pa.array(form))], ["less", "form"])
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(at)), pa.array(times[at]), pa.array(near[at]), chosen], ["word", "n", "n_near", "best"]
    )


def _composed(words: DataFrame, depth: int) -> DataFrame:
    """Pairs whose words share their first ``depth`` letters, partition by partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, names, times = None, [], []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if word[:depth] != prefix:
                    if len(names) > 1:
                        yield _enumerated(names, np.array(times), depth)
                    prefix, names, times = word[:depth], [], []
                names.append(word)
                times.append(n)
        if len(names) > 1:
            yield _enumerated(names, np.array(times), depth)

    dealt = words.repartition("prefix").sortWithinPartitions("word")
    return dealt.select("word", "n").mapInArrow(task, _NEAR)


# The composition from the initial state on


def _unfolded(words: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs whose edit is made after ``low`` to ``high`` - 1 common letters.

    A word meets others where one of its letters is left open, or a gap is opened. A group
    holds words that differ in that one letter alone, so no more than there are letters.
    """
    length = F.char_length("word")

    def gap(head: Column, rest: Column, last: Column, inserted: bool) -> Column:
        return F.struct(F.concat(head, F.lit("\0"), rest).alias("key"), last.alias("last"), F.lit(inserted).alias("inserted"))

    def after(j: Column) -> Column:
        return F.substring(F.col("word"), j + 1, length)

    def opened(j: Column) -> Column:
        head, letter = F.substring(F.col("word"), F.lit(1), j), F.substring(F.col("word"), j + 1, F.lit(1))
        replaced = gap(head, after(j + 1), F.substring(F.col("word"), j + 2, F.lit(1)) != letter, False)
        return F.array(F.when(length > j, replaced), gap(head, after(j), F.lit(False), True))

    places = F.when(length >= low, F.sequence(F.lit(low), F.least(length, F.lit(high - 1))))
    holes = F.array_compact(F.flatten(F.transform(places, opened)))
    rows = words.select("word", "n", F.explode(holes).alias("o")).select("word", "n", "o.*")
    member = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), "last", "inserted")
    groups = rows.groupBy("key").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)

    def others(m):
        meets = lambda x: F.when(m["inserted"], x["last"]).otherwise(F.when(x["inserted"], m["last"]).otherwise(True))
        return F.transform(
            F.filter("all", lambda x: (x["form"] != m["form"]) & meets(x)),
            lambda x: F.struct(x["less"].alias("less"), x["form"].alias("form")),
        )

    each = groups.select("all", F.explode("all").alias("m")).withColumn("near", others(F.col("m")))
    return each.where(F.size("near") > 0).select(
        F.col("m.form").alias("word"), (-F.col("m.less")).alias("n"), F.size("near").cast("long").alias("n_near"),
        F.array_min("near").alias("best"),
    )


def near_words(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """``word, n`` with ``n_near`` and ``best``: the near words' number and the most frequent of them.

    ``words`` is a written table of distinct words.
    """
    parts = [words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, form: string>").alias("best"))]
    open_, low, step = words, 0, 2
    while True:
        parts.append(_unfolded(open_, low, low + step))
        low += step
        step = low if low > 2 else 2
        open_ = open_.where(F.char_length("word") >= low).withColumn("prefix", F.substring("word", 1, low))
        large = durable(open_.groupBy("prefix").count().where(F.col("count") > partition).select("prefix"))
        many = large.count()
        if not many:
            parts.append(_composed(open_, low))
            break
        named = F.broadcast(large) if many <= MOST_BROADCAST else large
        parts.append(_composed(open_.join(named, "prefix", "left_anti"), low))
        open_ = durable(open_.join(named, "prefix", "left_semi").select("word", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _rooted(forms: DataFrame) -> DataFrame:
    """``word, form`` with the last form of each chain as ``root``, by pointer doubling.

    A form is more frequent than its word, so chains end; each round doubles the links behind.
    """
    chains = durable(forms.select("word", F.col("form").alias("to")))
    while True:
        ahead = chains.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = durable(
            chains.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        )
        drop_durable(chains)
        chains, ended = moved.select("word", "to"), moved.where("moved").isEmpty()
        if ended:
            return chains.withColumnRenamed("to", "root")


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", one_in: int = ONE_IN, letters: int = LETTERS,
    times: int = TIMES, ratio: int = RATIO, partition: int = PARTITION,
) -> DataFrame:
    """One row for each word: ``word, form, root, n, n_near, form_n``.

    Words are runs of Latin letters, A-Z lowered, of ``letters`` letters or more that occur
    ``times`` times or more. ``form`` is the most frequent near word (ties: the first in code
    point order) if it is ``ratio`` times as frequent or more, else null; ``root`` is the last
    form along forms. Null texts have no words; a null id counts as an empty one; repeated rows count again; other
    columns are ignored; an empty table gives an empty result.
    """
    words = durable(vocabulary(docs, id_column, text_column, one_in, letters, times))
    near = near_words(words, partition)
    best = -F.col("best.less")
    good = F.coalesce(best >= ratio * F.col("n"), F.lit(False))
    formed = durable(
        near.select(
            "word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, best).alias("form_n")
        )
    )
    drop_durable(words)
    roots = _rooted(formed.where("form is not null"))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
