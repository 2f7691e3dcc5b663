"""Absent-player names matched to squad names within a team.

Exact key first, then the most similar squad name at or above the cutoff, then
the first squad name that contains the other or is contained in it.  Pairs are
found through equality on text pieces, so a large squad is never compared name
by name.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlab import constants as C
from matchlab.functions.text import nfc_name_key
from matchlab.session import durable


PIECES_FROM = 0.7
#: Names of up to ``NEAR_CHARS`` characters first meet through what is left of both without
#: at most ``NEAR`` characters; ``EMIT_NAMES`` names at a time become rows.
NEAR, NEAR_CHARS, EMIT_NAMES = 2, 40, 512


@F.pandas_udf(T.DoubleType())
def similarity(candidate: pd.Series, name: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two names."""
    return pd.Series(
        [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(candidate, name)]
    )


# Not to be repeated for the filter on its result.
similarity = similarity.asNondeterministic()


def _plan(la: int, lb: int, cutoff: float) -> tuple[int, int] | None:
    """Most unmatched characters each name may have at this cutoff, or None."""
    matched = math.ceil(cutoff * (la + lb) / 2 - 1e-9)
    if matched > min(la, lb):
        return None
    return la - matched, lb - matched


def _segments(lb: int, edits: int) -> list[tuple[int, int]]:
    """Cut a name of length lb into edits + 1 pieces of nearly equal size."""
    size, longer = divmod(lb, edits + 1)
    bounds, start = [], 0
    for i in range(edits + 1):
        length = size + (1 if i < longer else 0)
        bounds.append((start, length))
        start += length
    return bounds


def _pieces(name: str, cutoff: float, is_candidate: bool, others: set[int] | None = None) -> set[str]:
    """Keys two names share whenever their ratio reaches the cutoff.

    ``others`` are the lengths of the names to meet, any length without it.

    With at most ``e`` unmatched characters, cutting the candidate into e + 1
    pieces leaves one piece untouched; it stands in the other name, shifted by
    no more than the unmatched characters before it.
    """
    own, keys = len(name), set()
    reach = (2 - cutoff) / cutoff
    for other in range(max(1, math.floor(own / reach)), math.ceil(own * reach) + 1):
        if others is not None and other not in others:
            continue
        la, lb = (other, own) if is_candidate else (own, other)
        plan = _plan(la, lb, cutoff)
        if plan is None:
            continue
        ua, ub = plan
        for start, length in _segments(lb, ua + ub):
            spots = (
                (start,)
                if is_candidate
                else range(max(0, start - ub), min(la - length, start + ua) + 1)
            )
            for spot in spots:
                keys.add(f"{la},{lb},{start}:{name[spot:spot + length]}")
    return keys


def _without(name: str, n: int) -> set[str]:
    """The name without any n of its characters."""
    return {"".join(kept) for kept in combinations(name, len(name) - n)} if n < len(name) else set()


def _near_keys(name: str, cutoff: float, is_candidate: bool, others: set[int]) -> set[str]:
    """Keys two different names share if one to ``NEAR`` characters of both together are unmatched.

    A key is what is left without them, with the number taken from either name.
    """
    own, keys = len(name), set()
    for mine in range(NEAR + 1):
        for theirs in range(NEAR + 1 - mine):
            other = own - mine + theirs
            la, lb = (other, own) if is_candidate else (own, other)
            plan = _plan(la, lb, cutoff) if other in others else None
            taken = (theirs, mine) if is_candidate else (mine, theirs)
            if plan is not None and mine + theirs and min(la, lb) and taken[0] <= plan[0] and taken[1] <= plan[1]:
                keys.update(f"{taken[0]},{taken[1]}:{rest}" for rest in _without(name, mine))
    return keys


def _key_rows(df: DataFrame, others: DataFrame, keys_of: Callable, cutoff: float, is_candidate: bool) -> DataFrame:
    """(team, name_key, piece): the keys of each name that names of ``others``' lengths can share."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), EMIT_NAMES):
                part = batch[at : at + EMIT_NAMES]
                pieces = [
                    list(keys_of(n, cutoff, is_candidate, set(lengths)))
                    for n, lengths in zip(part["name_key"], part["_lengths"])
                ]
                yield part[["team", "name_key"]].assign(piece=pieces).explode("piece").dropna(subset=["piece"])

    rows = df.select("team", "name_key").join(_lengths(others, "name_key"), "team")
    return rows.mapInPandas(emit, "team string, name_key string, piece string")


def _alike(own: DataFrame, theirs: DataFrame, cutoff: float) -> DataFrame:
    """(team, name_key, best): ratio and key of the most similar candidate of each name that shares a piece."""
    pairs = (
        own.join(theirs.withColumnRenamed("name_key", "cand_key"), ["team", "piece"])
        .select("team", "name_key", "cand_key")
        .distinct()
        .withColumn("ratio", similarity("cand_key", "name_key"))
        .filter(F.col("ratio") >= cutoff)
    )
    return pairs.groupBy("team", "name_key").agg(F.max(F.struct("ratio", "cand_key")).alias("best"))


def _most_similar(left: DataFrame, cand: DataFrame, cutoff: float) -> DataFrame:
    """(team, name_key, cand_key): the most similar candidate at or above the cutoff, the last key of equal ones.

    First the candidates that differ by at most ``NEAR`` characters.  With more of them
    unmatched, a name of n characters has no ratio above 2n / (2n + ``NEAR`` + 1): names
    found above it are settled, the others meet all candidates through longer pieces.
    """
    short = F.length("name_key") <= NEAR_CHARS
    asked, near_cand = left.where(short), cand.where(F.length("name_key") <= NEAR_CHARS + NEAR)
    near = _alike(
        _key_rows(asked, near_cand, _near_keys, cutoff, False),
        _key_rows(near_cand, asked, _near_keys, cutoff, True), cutoff,
    )
    n = F.length("name_key")
    settled = durable(near.where(F.col("best.ratio") > 2 * n / (2 * n + NEAR + 1)))
    rest = left.join(settled, ["team", "name_key"], "left_anti")
    if cutoff >= PIECES_FROM:
        own, theirs = _key_rows(rest, cand, _pieces, cutoff, False), _key_rows(cand, rest, _pieces, cutoff, True)
    else:
        own, theirs = _letter_rows(rest), _letter_rows(cand)
    return settled.unionByName(_alike(own, theirs, cutoff)).select("team", "name_key", F.col("best.cand_key").alias("cand_key"))


def _letter_rows(df: DataFrame) -> DataFrame:
    """One row per name and different character: names with any ratio above 0 share one."""
    letters = F.array_distinct(F.split("name_key", ""))
    return df.select("team", "name_key", F.explode(letters).alias("piece")).filter("piece <> ''")


def _lengths(df: DataFrame, name: str) -> DataFrame:
    """(team, _lengths): the different lengths of a team's names, no more than the longest name has."""
    return df.groupBy("team").agg(F.array_sort(F.collect_set(F.length(name))).alias("_lengths"))


def _substrings(name: Column, lengths: Column) -> Column:
    """Every substring of a name that has one of the given lengths."""
    size = F.length(name)
    fitting = F.filter(lengths, lambda n: (n > 0) & (n <= size))
    return F.array_distinct(
        F.flatten(
            F.transform(
                fitting,
                lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(name, i, n)),
            )
        )
    )


def fuzzy_name_match(
    absent: DataFrame,
    squads: DataFrame,
    cutoff: float = C.NAME_MATCH_CUTOFF,
) -> DataFrame:
    """(team, absent_name, pos, player_name, how): squad name of each absent name, null if none.

    ``absent`` has team, absent_name, pos; ``squads`` team, player_name, pos.  Below
    a cutoff of ``PIECES_FROM`` no longer piece need survive in both names, so
    names of a team that share a character are compared.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff must lie in (0, 1]")
    key = lambda c: nfc_name_key(F.col(c))
    listed = absent.withColumn("name_key", key("absent_name"))
    # Tables that several steps read are written once: the plans below stay small.
    roster = durable(
        squads.withColumn("cand_key", key("player_name"))
        .groupBy("team", "cand_key")
        .agg(F.min_by("player_name", "pos").alias("player_name"), F.min("pos").alias("cand_pos"))
    )
    asked = listed.select("team", "name_key").distinct()
    exact = durable(asked.join(
        roster.select("team", F.col("cand_key").alias("name_key"), "player_name"),
        ["team", "name_key"], "left",
    ))
    hit = exact.filter("player_name is not null").withColumn("how", F.lit("exact"))
    left = exact.filter("player_name is null").drop("player_name")
    # From here on only squads with an open name matter.
    roster = roster.join(left.select("team").distinct(), "team", "left_semi")

    close = durable(_most_similar(left, roster.select("team", F.col("cand_key").alias("name_key")), cutoff))
    close = close.join(roster.drop("cand_pos"), ["team", "cand_key"]).select(
        "team", "name_key", "player_name", F.lit("similar").alias("how")
    )
    left = durable(left.join(close, ["team", "name_key"], "left_anti"))

    # First squad name holding the absent name: one row per team and substring.
    holds = (
        roster.join(_lengths(left, "name_key"), "team")
        .select(
            "team", "player_name", "cand_pos",
            F.explode(_substrings(F.col("cand_key"), F.col("_lengths"))).alias("name_key"),
        )
        .groupBy("team", "name_key")
        .agg(F.min(F.struct("cand_pos", "player_name")).alias("c"))
    )
    inside = (
        left.join(_lengths(roster, "cand_key"), "team")
        .select("team", "name_key", F.explode(_substrings(F.col("name_key"), F.col("_lengths"))).alias("cand_key"))
        .join(roster, ["team", "cand_key"])
        .groupBy("team", "name_key")
        .agg(F.min(F.struct("cand_pos", "player_name")).alias("c"))
    )
    part = (
        left.join(holds, ["team", "name_key"])
        .unionByName(inside)
        .groupBy("team", "name_key")
        .agg(F.min("c")["player_name"].alias("player_name"))
        .withColumn("how", F.lit("part"))
    )
    found = durable(hit.unionByName(close).unionByName(part))
    return listed.join(found, ["team", "name_key"], "left").select(
        "team", "absent_name", "pos", "player_name", "how"
    )
