import difflib
import random

import pytest
from pyspark.sql import functions as F

from matchlab.functions import text as X
from matchlab.operators import articles as A
from matchlab.operators import matching as N
from matchlab.operators import signals as S


def apply(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_clean_html_decodes_entities_after_tags(spark):
    out = apply(spark, ["<b>A&nbsp;&amp; B</b>\n<i>&lt;c&gt;</i>", None, "x &eacute;"], X.clean_html)
    assert out == ["A & B <c>", None, "x é"]


def test_article_body_keeps_only_readable_paragraphs(spark):
    long = "The manager said that the team had trained well all week &amp; was ready"
    page = (
        f"<p class='x'>{long}</p><p>short</p><p>BBC {long}</p><p>Play {long}</p>"
        f"<p>{long}, please Subscribe</p><p>{long} a < b\n</p><p>c > d {long}</p>"
    )
    clean = long.replace("&amp;", "&")
    body = apply(spark, [page], X.article_body)[0]
    assert body == f"{clean} {clean} a < b c > d {clean}"
    assert apply(spark, [page], lambda c: X.article_body(c, 50))[0] == clean[:50]


def test_names(spark):
    assert apply(spark, [" José (captain) ", "MBAPPÉ"], lambda c: X.nfc_name_key(c, strip_notes=True)) == ["josé", "mbappé"]
    assert apply(spark, ["Bosnia & Herz., (F.)  X", "Côte d'Ivoire"], X.odds_name_key) == ["bosnia and herz f x", "côte divoire"]
    assert apply(spark, ["USA[a]", "Türkiye", "Spain"], lambda c: X.alias_team(c, "wiki")) == ["United States", "Turkey", "Spain"]


def test_scores_slots_and_kickoffs(spark):
    out = apply(spark, ["2–1 (a.e.t.)", "3 - 0", "Match 7", None], X.parse_score)
    assert [(r["home"], r["away"]) for r in out] == [(2, 1), (3, 0), (None, None), (None, None)]
    assert apply(spark, ["1A", "W73", "3A/B/C/D/F", "Wales", "1AB"], X.is_bracket_slot) == [True, True, True, False, False]
    times = ["13:00 UTC-6", "09:30 UTC+2", "tbd", None]
    out = apply(spark, times, lambda c: X.kickoff_utc(F.lit("2026-06-11"), c).cast("string"))
    assert out == ["2026-06-11 19:00:00", "2026-06-11 07:30:00", "2026-06-11 00:00:00", "2026-06-11 00:00:00"]
    out = apply(spark, ["2026-06-11T18:00:00+02:00", "2026-06-11T18:00:00Z", "soon"], lambda c: X.iso_to_utc(c).cast("string"))
    assert out == ["2026-06-11 16:00:00", "2026-06-11 18:00:00", None]


def test_squad_values(spark):
    assert apply(spark, ["GK", " forward", "Goalie", "Coach"], X.squad_position) == ["GK", "FW", "GK", None]
    assert apply(spark, ["30 March 1987 (aged 35)", "9, then 31", "1987"], X.squad_age) == [35, 31, 0]
    assert apply(spark, ["12", " 7 ", "12 (3)", ""], X.squad_caps) == [12, 7, 0, 0]


def test_signals_are_clamped_and_cleaned(spark):
    raws = [
        '```json\n{"form_score": 3, "confidence": "0.4", "key_absences": ["A", "", null], "tactical_notes": " x "}\n```',
        '{"form_score": "high", "confidence": -2}', "no json", None,
    ]
    out = apply(spark, raws, X.validate_signal)
    assert (out[0]["form_score"], out[0]["confidence"], out[0]["key_absences"], out[0]["tactical_notes"]) == (1.0, 0.4, ["A"], "x")
    assert (out[1]["form_score"], out[1]["confidence"], out[1]["unreadable"]) == (0.0, 0.0, False)
    assert out[2]["unreadable"] and out[3]["unreadable"]


ARTICLES = "pos int, link string, title string, description string, feed_prio int"


def test_article_is_about_a_team_by_title_or_by_two_mentions(spark):
    rows = [
        (1, "a", "Spain win", "", 0), (2, "b", "Cup news", "Spain and the Spanish", 0), (3, "c", "Cup news", "Spain once", 0),
        (4, "d", "Cup news", "<a href='spain spain'>x</a> Spain", 0), (5, "e", "Korea and DR Congo", "", 0),
    ]
    out = A.team_article_match(spark.createDataFrame(rows, ARTICLES)).collect()
    assert {(r["pos"], r["team"], r["in_title"]) for r in out} == {
        (1, "Spain", True), (2, "Spain", False), (5, "South Korea", True), (5, "DR Congo", True),
    }


def greedy(rows):
    kept, links, prints = set(), set(), set()
    for team, pos, link, mark in sorted(rows, key=lambda r: r[1]):
        if link and (team, link) not in links and (team, mark) not in prints:
            links.add((team, link))
            prints.add((team, mark))
            kept.add((team, pos))
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_equals_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("AB"), i, f"l{rng.randrange(25)}", f"f{rng.randrange(25)}") for i in range(200)]
    # A third of all rows are copies of one article; a chain needs several rounds.
    rows += [("A", 1000 + i, "hot", "hot") for i in range(100)]
    rows += [("C", i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "team string, pos int, link string, fingerprint string")
    got = {(r["team"], r["pos"]) for r in A.dedupe_articles(df).collect()}
    assert got == greedy(rows)


def test_dropped_article_does_not_shadow_others(spark):
    rows = [("A", 1, "l1", "f1"), ("A", 2, "l2", "f1"), ("A", 3, "l2", "f2"), ("A", 4, "", "f9")]
    df = spark.createDataFrame(rows, "team string, pos int, link string, fingerprint string")
    assert {r["pos"] for r in A.dedupe_articles(df).collect()} == {1, 3}


def test_interleaving_alternates_and_drops_repeats(spark):
    ranked = spark.createDataFrame(
        [("H", 1, "x", 1), ("H", 2, "y", 2), ("A", 1, "x", 1), ("A", 2, "z", 3)], "team string, rank int, link string, pos int"
    )
    games = spark.createDataFrame([(7, "H", "A")], "match_id int, home_team string, away_team string")
    out = A.interleave_match_news(games, ranked).orderBy("place").collect()
    assert [r["link"] for r in out] == ["x", "y", "z"]


def test_reports_within_two_days_with_the_team_in_the_title(spark):
    games = spark.sql("select 'Spain' team, 1 match_id, date '2026-06-20' match_date")
    rows = [
        ("Spain win", "2026-06-20 23:00:00", "<p>ok</p>"), ("Spain win", "2026-06-22 10:00:00", "late"),
        ("Spain win", "2026-06-23 10:00:00", "too late"), ("Spain win", "2026-06-19 10:00:00", "early"),
        ("France win", "2026-06-20 10:00:00", "other"), ("Spanish joy", "2026-06-20 10:00:00", "<br>"),
    ]
    docs = spark.createDataFrame(rows, "title string, p string, body_html string").select(
        "title", F.col("title").alias("url"), F.col("p").cast("timestamp").alias("published"), "body_html"
    )
    assert {r["body"] for r in A.match_report_filter(games, docs).collect()} == {"ok", "late"}


def test_requests_join_articles_in_rank_order(spark):
    rows = [("A", 2, "two", "u2"), ("A", 1, "one", "u1")]
    r = S.signal_requests(spark.createDataFrame(rows, "team string, rank int, text string, link string")).first()
    assert (r["request"], r["urls"], r["n_articles"]) == ("one\n\n---\n\ntwo", ["u1", "u2"], 2)


def best_by_hand(name, names):
    keys = [n.lower().strip() for n in names]
    name = name.lower().strip()
    if name in keys:
        return names[keys.index(name)]
    close = difflib.get_close_matches(name, keys, n=1, cutoff=0.8)
    if close:
        return names[keys.index(close[0])]
    return next((n for n, k in zip(names, keys) if name in k or k in name), None)


def test_name_matching_equals_comparing_every_pair(spark):
    rng = random.Random(5)
    first = ["Kylian", "Harry", "Luka", "Son", "Jo", "Li", "Ana Maria", "Bruno"]
    last = ["Mbappe", "Kane", "Modric", "Heung-min", "Li", "Oyarzabal", "Fernandes", "Silva"]
    squads = {t: [f"{rng.choice(first)} {rng.choice(last)}" for _ in range(14)] + ["Pele", "Li"] for t in "AB"}
    absent = []
    for team in "AB":
        for name in squads[team] * 3:
            letters = list(name)
            for _ in range(rng.randrange(4)):
                spot = rng.randrange(len(letters))
                letters[spot : spot + rng.randrange(2)] = rng.choice(["", "x", "e", " "])
            absent.append((team, "".join(letters) or "q"))
        absent += [(team, s) for s in ("Kane", "Kylian", "Zzzz", "a", "Harry K", "L", "Luka Modrić Jr")]
    roster = [(t, n, i) for t in "AB" for i, n in enumerate(squads[t])]
    out = N.fuzzy_name_match(
        spark.createDataFrame([(t, n, i) for i, (t, n) in enumerate(absent)], "team string, absent_name string, pos int"),
        spark.createDataFrame(roster, "team string, player_name string, pos int"),
    ).collect()
    got = {r["pos"]: r["player_name"] for r in out}
    expected = {i: best_by_hand(n, squads[t]) for i, (t, n) in enumerate(absent)}
    assert got == expected


def test_pieces_never_miss_a_pair_above_the_cutoff():
    rng = random.Random(3)
    for _ in range(20000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            spot = rng.randrange(len(b) + 1)
            b[spot : spot + rng.randrange(2)] = rng.choice(["", "a", "b", "d"])
        b = "".join(b)
        if b and difflib.SequenceMatcher(None, b, a).ratio() >= 0.8:
            assert N._pieces(a, 0.8, False) & N._pieces(b, 0.8, True), (a, b)
