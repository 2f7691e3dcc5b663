"""Secret scans against a ledger of content-addressed texts.

Every version of a text is addressed by the SHA-256 of its bytes (its blob). The
ledger remembers which rule versions have seen a blob and what they found; a scan
reads only blob and rule-version pairs that are not in it, and each blob once however
many paths hold it. Findings are then joined back to all paths. Only DataFrame
functions run on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value`` is the group whose length must reach ``least``.

    Matches of ``pattern`` are leftmost and do not overlap; the rest is dropped after
    matching. A change of a rule needs a new version.
    """

    kind: str
    pattern: str
    least: int = 0
    value: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values. A run of one class of characters may carry its least length in the
# pattern: a shorter run holds no longer one.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
_KEY_HEAD = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
# All up to the END line, unless another line of five dashes comes first. Only header lines hold dashes.
_KEY_TO_END = r"[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z ]{0,30}PRIVATE KEY-----"
# A key without its end: header lines, base64 lines, and what begins the line after them; of
# indented lines, all words up to the next other sign. No group repeats without a limit, as
# Java's matcher needs stack for each turn; runs of one class need none.
_KEY_LINES = (
    r"(?:(?:\\[rn]|\s){1,40}[A-Z][A-Za-z-]{2,20}:\x20[^\s\\]+){0,10}(?:\\[rn]|[\s>|]){0,40}[A-Za-z0-9+/=]{20,}"
    r"(?:(?:\\[rn]|[\r\n]){1,4}[\x20\t>|]+[A-Za-z0-9+/=]{19,}[A-Za-z0-9+/=\\\s>|]*[A-Za-z0-9+/=]|[A-Za-z0-9+/=\\\r\n]*[A-Za-z0-9+/=])?"
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", _KEY_HEAD + rf"(?:{_KEY_TO_END}|{_KEY_LINES})?", version=2),
)
RULES = BASE_RULES + MORE_RULES

_FOUND = "array<struct<start:bigint,end:bigint,rule:string>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


_BLOCK = 256


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _in_blocks(values: Column, use) -> Column:
    """``use`` of the values in blocks of ``_BLOCK``.

    An array or string that grows by one element a step is copied in each; within blocks
    that cost is bounded, so a text of many matches takes time in proportion to them.
    """
    def cut(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / _BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK)))

    return _once(values, lambda v: _once(cut(v), use))


def _before(values: Column, join) -> Column:
    """For each value, what ``join`` makes of all values before it, from 0."""

    def step(done: Column, v: Column) -> Column:
        return F.struct(join(done["all"], v).alias("all"), F.concat(done["out"], F.array(done["all"])).alias("out"))

    none = F.array().cast("array<bigint>")
    return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("all"), none.alias("out")), step)["out"]


def _spans(text: Column, rule: Rule) -> Column:
    """(start, end, rule) of a rule's matches in code points; end exclusive.

    Matching with the text before each match, from where the last one ended, gives
    the places: they are the lengths so far.
    """
    chained = F.lit(rf"\G((?s:.*?))({rule.pattern})")
    parts = [F.regexp_extract_all(text, chained, F.lit(1)).alias("gap"), F.regexp_extract_all(text, chained, F.lit(2)).alias("hit")]
    parts.append(F.regexp_extract_all(text, chained, F.lit(2 + rule.value)).alias("value"))
    none = F.array().cast(_FOUND)

    def lengths(x: Column) -> Column:
        good = F.char_length(x["value"]) >= rule.least
        return F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), good.alias("good"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["hit"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.key).alias("rule")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(done["found"], one)).otherwise(done["found"]).alias("found"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step)["found"]

    def walked(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["hit"]))
        return F.flatten(F.zip_with(blocks, _before(sizes, lambda n, size: n + size), placed))

    return F.when(text.rlike(rule.pattern), _in_blocks(F.transform(F.arrays_zip(*parts), lengths), walked)).otherwise(none)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules that have seen it, what they found), one row for each scan of a blob."""
    return spark.read.schema(f"blob string, rules array<string>, found {_FOUND}").parquet(ledger)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """Scan what the ledger has not seen, add it to the ledger, and return the ledger.

    A null text is the empty blob. Repeated texts are one blob, read by one task.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    blobs = versions.select(blob_of(F.col(text_column)).alias("blob"), text.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if _exists(spark, ledger):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        blobs = blobs.withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    else:
        blobs = blobs.withColumn("rules", wanted)
    none = F.array().cast(_FOUND)
    found = F.concat(*(F.when(F.array_contains("rules", r.key), _spans(F.col("body"), r)).otherwise(none) for r in rules))
    blobs.select("blob", "rules", found.alias("found")).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The rows of ``versions`` with ``secrets``: (start, end, kind) by start, then rule order.

    Every row stays, also repeated rows and rows without text or finding. A column
    called ``secrets`` is replaced.
    """
    order = F.array(*(F.lit(r.key) for r in rules))
    hits = ledger.select("blob", F.explode("found").alias("hit")).where(F.array_contains(order, F.col("hit.rule")))
    hits = hits.groupBy("blob").agg(
        F.sort_array(
            F.collect_set(
                F.struct(
                    F.col("hit.start").alias("start"), F.array_position(order, F.col("hit.rule")).alias("rank"),
                    F.col("hit.end").alias("end"), F.substring_index("hit.rule", "@", 1).alias("kind"),
                )
            )
        ).alias("hits")
    )
    own = [c for c in versions.columns if c != "secrets"]
    spans = F.transform(F.coalesce("hits", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")),
                        lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["kind"].alias("kind")))
    left = versions.select(F.struct(*own).alias("own"), blob_of(F.col(text_column)).alias("blob"))
    joined = left.join(hits, "blob", "left").withColumn("secrets", spans)
    return joined.select(*(F.col("own")[c].alias(c) for c in own), "secrets")


def masked(text: Column, secrets: Column, mask: str = "<secret>") -> Column:
    """The text with every found span replaced by ``mask``; spans that meet are one.

    Each block of spans works on its own stretch of the text, up to the last end in it.
    """

    def last_end(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda n, s: F.greatest(n, s["end"]))

    def piece(body: Column, start: Column, length: Column) -> Column:
        return F.substring(body, start.cast("int") + 1, F.greatest(length, F.lit(0)).cast("int"))

    def walked(block: Column, first: Column) -> Column:
        def walk(body: Column) -> Column:
            def step(done: Column, s: Column) -> Column:
                before = piece(body, done["at"] - first, s["start"] - done["at"])
                out = F.when(s["start"] >= done["at"], F.concat(done["out"], before, F.lit(mask))).otherwise(done["out"])
                return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

            return F.aggregate(block, F.struct(first.alias("at"), F.lit("").alias("out")), step)["out"]

        return _once(piece(text, first, last_end(block) - first), walk)

    def whole(blocks: Column) -> Column:
        ends = F.transform(blocks, last_end)
        parts = F.zip_with(blocks, _before(ends, F.greatest), walked)
        return F.concat(F.array_join(parts, ""), piece(text, F.array_max(ends), F.char_length(text)))

    return F.when(F.size(secrets) > 0, _in_blocks(secrets, whole)).otherwise(text)


def without_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_column: str = "text", count_column: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with every secret in the text masked.

    ``count_column``, if there is one, gets the new number of code points where a text
    changes.
    """
    found = findings(docs.select(F.struct(*docs.columns).alias("own"), F.col(text_column).alias("body")), scan(docs, ledger, rules, text_column), rules, "body")
    hit, text = F.size("secrets") > 0, masked(F.col("body"), F.col("secrets"))
    columns = []
    for name in docs.columns:
        value = F.col("own")[name]
        if name == text_column:
            value = text
        elif name == count_column:
            value = F.when(hit, F.char_length(text)).otherwise(value).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return found.select(*columns)
