"""News articles: which team they are about, de-duplication, top lists, match reports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions import text as X
from matchlab.functions.once import with_once
from matchlab.session import drop_durable, durable

TERMS_A_PASS = 100_000


def _mentions(title: Column, plain: Column, terms: Mapping[str, tuple[str, ...]]) -> Column:
    """(team, in_title) of the teams that two lower-case texts are about.

    All terms are rows of a multi-pattern automaton (one for every ``TERMS_A_PASS``
    terms), built once a task, so a text is read once however many terms there are. Of the
    occurrences of one term only those that do not overlap an earlier one count.
    Empty terms match nothing.
    """
    listed = [(team, word.lower()) for team, words in terms.items() for word in words if word]
    kind = pa.list_(pa.struct([("team", pa.string()), ("in_title", pa.bool_())]))

    def automata() -> list[ahocorasick.Automaton]:
        made = []
        for at in range(0, len(listed), TERMS_A_PASS):
            owners: dict[str, list[str]] = {}
            for team, word in listed[at : at + TERMS_A_PASS]:
                owners.setdefault(word, []).append(team)
            tree = ahocorasick.Automaton()
            for word, teams in owners.items():
                tree.add_word(word, (word, teams))
            tree.make_automaton()
            made.append(tree)
        return made

    def about(trees: list[ahocorasick.Automaton], title: str | None, plain: str | None) -> list[dict]:
        named = {team for tree in trees for _, (_, teams) in tree.iter(title or "") for team in teams}
        counts: dict[str, int] = {}
        for tree in trees:
            free: dict[str, int] = {}  # where the next occurrence of a term may start
            for end, (word, teams) in tree.iter(plain or ""):
                if end + 1 - len(word) >= free.get(word, 0):
                    free[word] = end + 1
                    for team in teams:
                        counts[team] = counts.get(team, 0) + 1
        often = (team for team, n in counts.items() if n >= 2 and team not in named)
        return [{"team": t, "in_title": True} for t in named] + [{"team": t, "in_title": False} for t in often]

    def task(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trees = automata()
        for titles, plains in batches:
            rows = zip(titles.to_pylist(), plains.to_pylist())
            yield pa.array([about(trees, one, other) for one, other in rows], kind)

    # Marked as not deterministic so that no filter above repeats it.
    found = F.arrow_udf(task, "array<struct<team:string,in_title:boolean>>").asNondeterministic()
    return found(title, plain)


def team_article_match(
    articles: DataFrame, terms: Mapping[str, tuple[str, ...]] = C.SEARCH_TERMS
) -> DataFrame:
    """Article rows per team they are about, with ``in_title``.

    A team's term in the title is enough; otherwise its terms must occur at
    least twice in the plain description (overlapping terms count each).  The
    articles are read once for any number of terms; rows appear only for hits.
    Columns called ``team`` or ``in_title`` are replaced.
    """
    own = [c for c in articles.columns if c not in ("team", "in_title")]
    plain = F.lower(X.clean_html(F.col("description")))
    rows = articles.select(*own, _mentions(F.lower("title"), plain, terms).alias("_found"))
    return rows.select(*own, F.explode("_found").alias("_h")).select(*own, "_h.team", "_h.in_title")


def fingerprint(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """Digest of title and description in lower case: same article, other address.

    With ``max_chars`` only their first characters decide.
    """
    parts = F.concat(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    if max_chars is not None:
        parts = F.substring(parts, 1, max_chars)
    return F.sha2(F.lower(parts), 256)


DEDUPE_ROUNDS = 2
_PLACE = ("pos", "link", "fingerprint", "id")


def _with_firsts(rows: DataFrame) -> DataFrame:
    """Each open article beside the earliest one of its link and of its fingerprint."""
    place = F.struct(*_PLACE)
    by_link = rows.groupBy("team", "link").agg(F.min(place).alias("_link_first"))
    by_print = rows.groupBy("team", "fingerprint").agg(F.min(place).alias("_print_first"))
    return rows.join(by_link, ["team", "link"]).join(by_print, ["team", "fingerprint"])


def _chains(rows: DataFrame) -> DataFrame:
    """Articles with one earlier open neighbour at most, as (id, parent, odd, going).

    An article that is second of its link and first of its fingerprint, or the other
    way round, is kept exactly if that one neighbour, its parent, is not.
    """
    ranked = _with_firsts(rows)
    place = F.struct(*_PLACE)
    leads_link, leads_print = F.col("id") == F.col("_link_first.id"), F.col("id") == F.col("_print_first.id")
    link_second = ranked.where(~leads_link).groupBy("team", "link").agg(F.min(place)["id"].alias("_link_next"))
    print_second = ranked.where(~leads_print).groupBy("team", "fingerprint").agg(F.min(place)["id"].alias("_print_next"))
    both = ranked.join(link_second, ["team", "link"], "left").join(print_second, ["team", "fingerprint"], "left")
    parent = F.when(leads_print & (F.col("_link_next") == F.col("id")), F.col("_link_first.id")).when(
        leads_link & (F.col("_print_next") == F.col("id")), F.col("_print_first.id")
    )
    nodes = both.select("id", parent.alias("parent"), (leads_link & leads_print).alias("root"))
    return nodes.where("root or parent is not null").select("id", "parent", (~F.col("root")).alias("odd"), (~F.col("root")).alias("going"))


def _kept_in_chains(rows: DataFrame) -> DataFrame:
    """Ids of the open articles that chains of single dependencies decide to keep.

    Pointer jumping: each round a node takes over its parent's parent and adds up the
    parity, so a chain of n articles takes log n rounds.  A chain that hangs on an
    article of several dependencies stays open.
    """
    nodes = durable(_chains(rows))
    while not (going := nodes.where("going")).isEmpty():
        up = nodes.select(F.col("id").alias("parent"), F.col("parent").alias("_up"), F.col("odd").alias("_odd"), F.col("going").alias("_going"))
        jumped = going.join(up, "parent", "left").select(
            "id",
            F.when(F.col("_going").isNull(), F.col("parent")).otherwise(F.col("_up")).alias("parent"),
            (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
            F.coalesce("_going", F.lit(False)).alias("going"),
        )
        before, nodes = nodes, durable(nodes.where("not going").unionByName(jumped))
        drop_durable(before)
    return nodes.where("parent is null and not odd").select("id")


def dedupe_articles(matched: DataFrame) -> DataFrame:
    """Keep an article of a team unless an earlier kept one has its link or fingerprint.

    ``matched`` has team, pos, link, fingerprint (and more); rows without a link,
    team or place are dropped, a missing fingerprint is an empty one; on equal
    places the smaller link, then fingerprint, comes first.  Copies of a (link,
    fingerprint) pair fall together in a map-side aggregate.  Then rounds of aggregates
    decide the rest: an article that is the earliest of both its link and its
    fingerprint is kept, and those it shadows are dropped.  After ``DEDUPE_ROUNDS``
    such rounds each round also decides whole chains of articles that wait for
    one other only.  Every round decides the earliest article of each
    connected group, and none reads a group in one task.
    """
    rows = matched.filter((F.coalesce("link", F.lit("")) != "") & F.col("team").isNotNull() & F.col("pos").isNotNull())
    rows = rows.withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    keys = rows.groupBy("team", "link", "fingerprint").agg(F.min("pos").alias("pos"))
    open_rows, kept = durable(keys.withColumn("id", F.monotonically_increasing_id())), []
    while not kept or not open_rows.isEmpty():
        if len(kept) < DEDUPE_ROUNDS:
            leads = (F.col("id") == F.col("_link_first.id")) & (F.col("id") == F.col("_print_first.id"))
            winners = _with_firsts(open_rows).where(leads).select(open_rows.columns)
        else:
            winners = open_rows.join(_kept_in_chains(open_rows), "id", "left_semi").select(open_rows.columns)
        winners = durable(winners)
        kept.append(winners)
        before, open_rows = open_rows, durable(
            open_rows.join(winners.select("team", "link"), ["team", "link"], "left_anti").join(
                winners.select("team", "fingerprint"), ["team", "fingerprint"], "left_anti"
            )
        )
        drop_durable(before)
    named = ["team", "pos", "link", "fingerprint"]
    return rows.join(reduce(DataFrame.unionByName, kept).select(*named), named, "left_semi")


def top_articles(articles: DataFrame, n: int = C.TEAM_ARTICLES) -> DataFrame:
    """First n articles per team with ``rank``: title hits first, then feed priority and place."""
    order = Window.partitionBy("team").orderBy(F.desc("in_title"), "feed_prio", "pos")
    return articles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def body_or_summary(articles: DataFrame) -> DataFrame:
    """Add ``text``: the page body when long enough, else title and description; blanks dropped."""
    summary = X.clean_html(F.concat("title", F.lit(". "), "description"))
    body = F.coalesce("body", F.lit(""))
    long_enough = (F.length(body) >= C.BODY_MIN_CHARS) & X.has_body_domain(F.col("link"))
    text = F.when(long_enough, body).otherwise(summary)
    return with_once(articles.withColumn("_text", text), "text", F.col("_text")).drop("_text").filter(
        F.length("text") > 0
    )


def interleave_match_news(
    fixtures: DataFrame, ranked: DataFrame, n: int = C.MATCH_ARTICLES
) -> DataFrame:
    """Articles of a fixture, home and away in turn, each address once, at most n.

    ``ranked`` comes from :func:`top_articles` with ``max(2, n // 2)`` per team,
    so the group of one fixture holds no more than that from each side.
    """
    per_team = max(2, n // 2)
    sides = F.explode(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.lit(0).alias("side")),
            F.struct(F.col("away_team").alias("team"), F.lit(1).alias("side")),
        )
    ).alias("s")
    rows = (
        fixtures.select("match_id", sides)
        .select("match_id", "s.*")
        .join(ranked.filter(F.col("rank") <= per_team), "team")
    )
    turn = F.struct("rank", "side")
    once = rows.groupBy("match_id", "link").agg(
        F.min(turn).alias("turn"), F.min_by("pos", turn).alias("pos")
    )
    order = Window.partitionBy("match_id").orderBy("turn")
    return (
        once.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("match_id", "place", "link", "pos")
    )


def match_report_filter(
    team_matches: DataFrame,
    articles: DataFrame,
    terms: Mapping[str, tuple[str, ...]] = C.SEARCH_TERMS,
    days: int = C.REPORT_WINDOW_DAYS,
    max_chars: int | None = None,
) -> DataFrame:
    """Reports of a team's matches: published within ``days``, team in the title, body not empty.

    Bodies stay whole unless ``max_chars`` is given.

    ``team_matches`` has team, match_id, match_date; ``articles`` title, url,
    published (timestamp), body_html.  An article names the few match dates it
    can belong to, so matches and articles meet by equality.
    """

    day = F.to_date("published")
    body = X.clean_html(F.col("body_html"))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    named = articles.drop("team").withColumn("_found", _mentions(F.lower("title"), F.lit(None).cast("string"), terms))
    rows = named.withColumn("team", F.explode("_found.team")).withColumn("_body", body).drop("body_html", "_found")
    rows = (
        with_once(rows, "body", F.col("_body"))
        .drop("_body")
        .filter(F.length("body") > 0)
        .withColumn("match_date", F.explode(F.sequence(F.date_sub(day, days), day)))
    )
    return team_matches.join(rows, ["team", "match_date"])
