"""Name keys, feed value parsers and text cleaning (Columns)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlab import constants as C


SPACES = r"(?U)\s+"  # all Unicode white space


@F.pandas_udf(T.StringType())
def _nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


# What ``html.unescape`` takes for a reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decoded(references: pa.Array) -> pa.Array:
    """Each character reference decoded; a kind that repeats is decoded once a batch."""
    kinds = references.flatten().dictionary_encode()
    plain = pa.array([html.unescape(s) for s in kinds.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(references), 0)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(ends, plain.take(kinds.indices), mask=references.is_null())


def _unescape(text: Column) -> Column:
    """Character references decoded; only the references cross to Python, not the texts around them."""
    references = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    between = F.split(text, REFERENCE, -1)
    # One text more than there are references.
    decoded = F.zip_with(between, _decoded(references), lambda t, r: F.concat(t, F.coalesce(r, F.lit(""))))
    return F.array_join(decoded, "")


def nfc_name_key(name: Column, strip_notes: bool = False) -> Column:
    """Lower-case, trimmed, NFC-normalised player name.

    ``strip_notes`` also drops "(...)" annotations (rosters carry them, goal
    lists do not).  Plain ASCII names have one form only: nothing of them goes
    through Python.
    """
    text = F.regexp_replace(name, r"\s*\([^)]*\)", "") if strip_notes else name
    key = F.lower(F.trim(text))
    return F.coalesce(_nfc(F.when(key.rlike(r"[^\x00-\x7F]"), key)), key)


def odds_name_key(name: Column) -> Column:
    """Lower, "&" to "and", punctuation dropped, spaces squeezed."""
    text = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def alias_team(name: Column, feed: str) -> Column:
    """Canonical team name; each feed has its own fixed alias map."""
    if feed == "wiki":
        name = F.trim(F.regexp_replace(name, r"\[.*?\]", ""))
    if feed == "odds":
        name = F.lower(name)
    aliases = C.TEAM_ALIASES[feed]
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def is_bracket_slot(name: Column) -> Column:
    """"1A", "W73", "3A/B/C": a bracket slot, not a team."""
    return F.coalesce(name, F.lit("")).rlike(C.PLACEHOLDER_PATTERN)


def is_placeholder_words(name: Column) -> Column:
    lowered = F.lower(name)
    hit = F.lit(False)
    for word in C.PLACEHOLDER_WORDS:
        hit = hit | lowered.contains(word)
    return hit


def parse_score(raw: Column) -> Column:
    """Struct(home, away) of "2-1" or "2–1 (aet)"; nulls when there is no score."""
    text = F.trim(F.regexp_replace(F.trim(raw), r"\(.*?\)", ""))
    pattern = r"^([0-9]+)\s*[–-]\s*([0-9]+)$"

    def part(i: int) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i).cast("int"))

    return F.struct(part(1).alias("home"), part(2).alias("away"))


def knockout_stage(match_date: Column, stage: Column | None) -> Column:
    """Stage label decides; only a blank or bare "group" label falls back to the date."""
    by_date = match_date >= F.lit(C.CURRENT_KNOCKOUT_START).cast("date")
    if stage is None:
        return by_date
    label = F.lower(F.trim(F.coalesce(stage, F.lit(""))))
    return (
        F.when(label.isin("", "group"), by_date)
        .when(label.startswith("group"), F.lit(False))
        .otherwise(F.lit(True))
    )


def kickoff_utc(day: Column, time: Column) -> Column:
    """Naive UTC kickoff of "2026-06-11" and "13:00 UTC-6"; midnight without a time."""
    clock = F.trim(F.coalesce(time, F.lit("")))
    timed = clock.rlike(C.KICKOFF_PATTERN)

    def part(i: int) -> Column:
        return F.when(timed, F.regexp_extract(clock, C.KICKOFF_PATTERN, i).cast("int"))

    midnight = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    shift = F.make_dt_interval(
        F.lit(0), F.coalesce(part(1) - part(3), F.lit(0)), F.coalesce(part(2), F.lit(0))
    )
    return midnight + shift


def iso_to_utc(raw: Column) -> Column:
    """ISO-8601 text with or without an offset to a naive UTC timestamp; null if unreadable.

    The same in any session time zone: a text with an offset is an instant, one
    without is taken as UTC.
    """
    instant = F.unix_micros(F.try_to_timestamp(raw))
    utc = F.timestamp_add("MICROSECOND", instant, F.lit("1970-01-01").cast("timestamp_ntz"))
    zoned = raw.rlike(r"(?i)\d:\d\d.*(z|utc|gmt|[+-]\d{1,2}(:?\d\d)?)\s*$")
    return F.when(zoned, utc).otherwise(raw.try_cast("timestamp_ntz"))


def strip_code_fence(text: Column) -> Column:
    pattern = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"
    trimmed = F.trim(text)
    fenced = trimmed.rlike(pattern)
    return F.when(fenced, F.regexp_extract(trimmed, pattern, 1)).otherwise(text)


def clean_html(text: Column, entities: bool = True) -> Column:
    """Tags to spaces, entities decoded, white space squeezed."""
    plain = F.regexp_replace(text, r"<[^>]+>", " ")
    if entities:
        plain = F.when(plain.contains("&"), _unescape(plain)).otherwise(plain)
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def article_body(html_text: Column, max_chars: int | None = None) -> Column:
    """Readable paragraphs of a page joined by spaces, whole unless ``max_chars`` is given.

    Paragraphs are split by the same ``<p>`` pattern everywhere.  Entities are
    decoded in one pass over the joined page rather than per paragraph: a
    control character marks the paragraph borders meanwhile.
    """
    border = "\u0001"
    raw = F.regexp_extract_all(html_text, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.regexp_replace(F.array_join(raw, border), rf"<[^>{border}]+>", " ")
    plain = F.when(plain.contains("&"), _unescape(plain)).otherwise(plain)
    pieces = F.transform(
        F.split(plain, border), lambda p: F.trim(F.regexp_replace(p, SPACES, " "))
    )

    def wanted(p: Column) -> Column:
        lowered = F.lower(p)
        ok = (F.length(p) >= C.PARAGRAPH_MIN_CHARS) & ~p.startswith("BBC")
        ok = ok & ~lowered.startswith("play ")
        for words in C.BOILERPLATE_WORDS:
            ok = ok & ~lowered.contains(words)
        return ok

    body = F.array_join(F.filter(pieces, wanted), " ")
    return body if max_chars is None else F.substring(body, 1, max_chars)


def has_body_domain(url: Column) -> Column:
    hit = F.lit(False)
    for domain in C.BODY_DOMAINS:
        hit = hit | url.contains(domain)
    return hit


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term in a text."""
    without = F.replace(text, term, F.lit(""))
    return ((F.length(text) - F.length(without)) / F.length(term)).cast("int")


_CORRUPT = "_corrupt_record"
SIGNAL_JSON = T.StructType(
    [
        T.StructField("form_score", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("key_absences", T.ArrayType(T.StringType())),
        T.StructField("morale_signals", T.ArrayType(T.StringType())),
        T.StructField("tactical_notes", T.StringType()),
        T.StructField("performance_context", T.StringType()),
        T.StructField(_CORRUPT, T.StringType()),
    ]
)


def validate_signal(raw: Column) -> Column:
    """Struct of a raw model answer: numbers clamped, unreadable numbers 0, blanks dropped."""
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    answer = F.from_json(strip_code_fence(raw), SIGNAL_JSON, options)

    def number(name: str, low: float) -> Column:
        value = F.coalesce(answer[name].try_cast("double"), F.lit(0.0))
        value = F.when(F.isnan(value), 0.0).otherwise(value)
        return F.greatest(F.lit(low), F.least(F.lit(1.0), value)).alias(name)

    def items(name: str) -> Column:
        kept = F.filter(answer[name], lambda x: F.coalesce(x, F.lit("")) != "")
        return F.coalesce(kept, F.array().cast("array<string>")).alias(name)

    def words(name: str) -> Column:
        return F.trim(F.coalesce(answer[name], F.lit(""))).alias(name)

    return F.struct(
        number("form_score", -1.0),
        number("confidence", 0.0),
        items("key_absences"),
        items("morale_signals"),
        words("tactical_notes"),
        words("performance_context"),
        (answer.isNull() | answer[_CORRUPT].isNotNull()).alias("unreadable"),
    )


def squad_position(raw: Column) -> Column:
    """GK, DF, MF or FW: exact label first, then the first listed prefix; else null."""
    key = F.lower(F.trim(raw))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, position in C.POSITIONS.items():
        chain = chain.when(key == label, position)
    for label, position in C.POSITIONS.items():
        chain = chain.when(key.startswith(label), position)
    return chain


def squad_age(raw: Column) -> Column:
    """"... (aged 35)", else the first whole number in 14..50, else 0."""
    aged = r"(?i)aged\s+([0-9]+)"
    numbers = F.transform(
        F.regexp_extract_all(raw, F.lit(r"\b([0-9]{1,3})\b"), F.lit(1)), lambda x: x.cast("int")
    )
    plausible = F.filter(numbers, lambda n: n.between(14, 50))
    return (
        F.when(raw.rlike(aged), F.regexp_extract(raw, aged, 1).cast("int"))
        .when(F.size(plausible) > 0, F.get(plausible, F.lit(0)))
        .otherwise(F.lit(0))
    )


def squad_caps(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text.rlike(r"^[0-9]+$"), text.cast("int")).otherwise(F.lit(0))
