"""File, payload and value-parser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.contexts import LATE
from matchlab.catalog.grids import CELLS, MARKETS, scored
from matchlab.catalog.registry import query
from matchlab.catalog.views import table, twin, view
from matchlab.functions import grid as G
from matchlab.functions import text as X
from matchlab.operators import context as K
from matchlab.session import scratch_path
from matchlab.sources import feeds as S
from matchlab.sources import results as R


def write_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def results_file(spark, sf):
    """Results as they arrive: text flags, some scores missing, a column more."""
    ident = F.col("match_id")
    m = view(spark, sf, "tb_matches").select(
        "match_id", F.col("match_date").alias("date"), "home_team", "away_team",
        F.when(ident % 11 != 0, F.col("home_score")).alias("home_score"),
        F.when(ident % 13 != 0, F.col("away_score")).alias("away_score"), "tournament",
        F.lit("x").alias("city"),
        F.when(F.col("neutral"), F.when(ident % 2 == 0, "True").otherwise(" true "))
        .otherwise("False").alias("neutral"),
        F.concat(F.lit("Land "), (ident % 9).cast("string")).alias("country"),
    )
    return write_csv(m, "results")


def goals_file(spark, sf):
    g = view(spark, sf, "tb_goals").select(
        F.col("match_date").alias("date"), "home_team", "away_team", "team", "scorer",
        F.when(F.col("goal_minute") % 10 != 0, F.col("goal_minute")).alias("minute"),
        F.when(F.col("own_goal"), "True").otherwise("False").alias("own_goal"),
        F.lit("False").alias("penalty"),
    )
    return write_csv(g, "goals")


@query(
    "load_results",
    twin("tb_goals", LATE.replace("from tb_goals", "from tb_goals where goal_minute % 10 <> 0") + """
    select match_id, match_date, home_team, away_team,
      case when last_minute > 90 then rh else home_score end as home_score,
      case when last_minute > 90 then ra else away_score end as away_score, tournament, neutral,
      concat('Land ', match_id % 9) as country
    from tb_matches left join late using (match_date, home_team, away_team)
    where match_id % 11 <> 0 and match_id % 13 <> 0"""),
)
def load_results(spark, sf):
    return R.load_results(spark, results_file(spark, sf), goals_file(spark, sf))


@query(
    "scan_goalscorers",
    twin("tb_goals", """
    select match_date, team, case when goal_minute % 10 <> 0 then goal_minute end as goal_minute, own_goal,
      count(*) as n from tb_goals group by all"""),
)
def scan_goalscorers(spark, sf):
    df = R.scan_goalscorers(spark, goals_file(spark, sf))
    return df.groupBy("match_date", "team", "goal_minute", "own_goal").agg(F.count("*").alias("n"))


@query(
    "table_cache",
    twin("tb_matches", """
    select cast(year(match_date) as int) as year, count(*) as n, sum(home_score)::bigint as goals
    from tb_matches where match_date >= date '1998-01-01' group by 1"""),
)
def table_cache(spark, sf):
    path = scratch_path(spark, "cache")
    R.save_cache(view(spark, sf, "tb_matches"), path)
    cached = R.load_cache(spark, path).filter("year >= 1998")
    return cached.groupBy("year").agg(F.count("*").alias("n"), F.sum("home_score").alias("goals"))


FEED_NAMES = ["USA", "Korea Republic", "Türkiye", "Côte d'Ivoire", "Czechia", "Bosnia & Herzegovina", "Spain", "IR Iran"]
NAME_SQL = "(['" + "','".join(n.replace("'", "''") for n in FEED_NAMES) + "'])[1 + {k} % 8]"


def feed_name(key):
    return F.element_at(F.array(*[F.lit(n) for n in FEED_NAMES]), (key % 8 + 1).cast("int"))


def _canonical(name: str, nested: bool = True) -> str:
    """SQL for the aliases that occur in the made-up feed names."""
    rest = f"""when 'Korea Republic' then 'South Korea' when 'Türkiye' then 'Turkey'
      when 'Côte d''Ivoire' then 'Ivory Coast' when 'Czechia' then 'Czech Republic' when 'IR Iran' then 'Iran'"""
    return f"""case {name} when 'USA' then 'United States'
      when 'Bosnia & Herzegovina' then 'Bosnia and Herzegovina' {rest if nested else ''} else {name} end"""


@query(
    "canonical_team",
    twin("tb_squads", f"""
    named as (select pos, {NAME_SQL.format(k='pos')} as n from tb_squads)
    select pos, {_canonical('n')} as nested, {_canonical('n', False)} as flat,
      case n when 'USA' then 'United States' when 'Korea Republic' then 'South Korea' when 'IR Iran' then 'Iran'
        when 'Türkiye' then 'Turkey' when 'Czechia' then 'Czech Republic'
        when 'Côte d''Ivoire' then 'Ivory Coast' else n end as wiki,
      lower({_canonical('n')}) as odds from named"""),
)
def canonical_team(spark, sf):
    squads = view(spark, sf, "tb_squads")
    name = feed_name(F.col("pos"))
    noted = F.concat(name, F.lit("[a][12]"))
    return squads.select(
        "pos", X.alias_team(name, "nested").alias("nested"), X.alias_team(name, "flat").alias("flat"),
        X.alias_team(noted, "wiki").alias("wiki"), X.alias_team(name, "odds").alias("odds"),
    )


@query(
    "normalise_fixtures_nested",
    twin("tb_matches", f"""
    select match_id, cast(match_date as timestamp) + to_hours(18) - to_hours(2) as kickoff,
      {_canonical(NAME_SQL.format(k='match_id'))} as home_team, away_team,
      case when match_id % 4 <> 0 then home_score end as home_score,
      case when match_id % 4 <> 0 then away_score end as away_score,
      case when match_id % 5 = 0 then 'Group Stage' else tournament end as stage,
      case when match_id % 6 = 0 then '' else concat('Ground ', match_id % 6) end as venue,
      match_id % 4 in (1, 2, 3) as is_completed from tb_matches"""),
)
def normalise_fixtures_nested(spark, sf):
    ident = F.col("match_id")
    played = ident % 4 != 0
    doc = F.struct(
        F.struct(
            F.concat(F.col("match_date").cast("string"), F.lit("T18:00:00+02:00")).alias("date"),
            F.struct(
                F.element_at(F.array(*map(F.lit, ["NS", "FT", "AET", "PEN"])), (ident % 4 + 1).cast("int"))
                .alias("short")
            ).alias("status"),
            F.struct(
                F.when(ident % 6 != 0, F.concat(F.lit("Ground "), (ident % 6).cast("string"))).alias("name")
            ).alias("venue"),
        ).alias("fixture"),
        F.struct(
            F.struct(feed_name(ident).alias("name")).alias("home"),
            F.struct(F.col("away_team").alias("name")).alias("away"),
        ).alias("teams"),
        F.struct(F.when(ident % 5 != 0, F.col("tournament")).alias("round")).alias("league"),
        F.struct(
            F.struct(
                F.when(played, F.col("home_score")).alias("home"),
                F.when(played, F.col("away_score")).alias("away"),
            ).alias("fulltime")
        ).alias("score"),
        # The final result includes extra time and must not be read.
        F.struct((F.col("home_score") + 7).alias("home"), F.lit(9).alias("away")).alias("goals"),
    )
    payload = view(spark, sf, "tb_matches").select("match_id", F.to_json(doc).alias("payload"))
    return S.normalise_fixtures_nested(payload)


@query(
    "normalise_fixtures_flat",
    twin("tb_matches", f"""
    select match_id, cast(match_date as timestamp)
        + case when match_id % 9 = 0 then to_hours(0) else to_hours(cast(13 + (match_id % 12) as int)) end as kickoff,
      {_canonical(NAME_SQL.format(k='match_id'), False)} as home_team, away_team,
      case when match_id % 4 <> 0 then home_score end as home_score,
      case when match_id % 4 <> 0 then away_score end as away_score,
      case when match_id % 3 = 0 then 'Round of 16' else concat('Group ', pool, ' - Round of 16') end as stage,
      concat('Ground ', match_id % 6) as venue, match_id % 4 <> 0 as is_completed
    from tb_matches where match_id % 7 <> 0"""),
)
def normalise_fixtures_flat(spark, sf):
    ident = F.col("match_id")
    slots = F.element_at(F.array(*map(F.lit, ["1A", "W73", "3A/B/C/D/F"])), (ident % 3 + 1).cast("int"))
    venue = F.concat(F.lit("Ground "), (ident % 6).cast("string"))
    base = dict(
        date=F.col("match_date").cast("string"),
        time=F.when(ident % 9 != 0, F.concat(F.lit("13:00 UTC-"), (ident % 12).cast("string"))),
        team1=F.when(ident % 7 == 0, slots).otherwise(feed_name(ident)),
        team2=F.col("away_team"),
        round=F.lit("Round of 16"),
        group=F.when(ident % 3 != 0, F.concat(F.lit("Group "), F.col("pool").cast("string"))),
        score=F.when(ident % 4 != 0, F.struct(F.array("home_score", "away_score").alias("ft"))),
    )

    def doc(ground):
        return F.to_json(F.struct(*[c.alias(n) for n, c in base.items()], ground.alias("ground")))

    # Half of the feed names the ground, the other half describes it.
    payload = F.when(ident % 2 == 0, doc(venue)).otherwise(doc(F.struct(venue.alias("name"))))
    rows = view(spark, sf, "tb_matches").select("match_id", payload.alias("payload"))
    return S.normalise_fixtures_flat(rows)


@query(
    "source_fallback",
    twin("tb_matches", "select match_id, home_team, away_team from tb_matches"),
)
def source_fallback(spark, sf):
    rows = view(spark, sf, "tb_matches").select("match_id", "home_team", "away_team")
    names = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("match_id"), F.col("n_name").alias("home_team"),
        F.col("n_name").alias("away_team"),
    )
    return S.source_fallback([rows.filter("match_id < 0"), rows, names])


@query(
    "best_odds",
    twin("tb_quotes", """
    events as (select match_id, bookmaker, max(price_home) as h, max(price_draw) as d, max(price_away) as a
      from tb_quotes group by 1, 2)
    select match_id, max(h) as odds_home, max(case when match_id % 5 <> 0 then d end) as odds_draw,
      max(a) as odds_away from events where match_id % 17 <> 0 group by match_id"""),
)
def best_odds(spark, sf):
    ident = F.col("match_id")

    def outcome(name, price):
        return F.struct(F.lit(name).alias("name"), price.alias("price"))

    def listed(name, less_home, less_away, draw):
        prices = F.array(
            outcome("Home", F.when(ident % 17 != 0, F.col("price_home") - less_home)),
            outcome("Draw", draw),
            outcome("Away", F.col("price_away") - less_away),
        )
        markets = F.array(
            F.struct(F.lit("totals").alias("key"), other.alias("outcomes")),
            F.struct(F.lit("h2h").alias("key"), prices.alias("outcomes")),
        )
        return F.struct(F.concat("bookmaker", F.lit(name)).alias("key"), markets.alias("markets"))

    other = F.array(outcome("Home", F.lit(99.0)), outcome("Away", F.lit(99.0)))
    draw = F.when(ident % 5 != 0, F.col("price_draw"))
    # One document per quote, of two bookmakers, neither best at everything; other markets must be passed over.
    doc = F.struct(
        F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"),
        F.lit("2026-06-11T18:00:00Z").alias("commence_time"),
        F.array(
            listed("-1", 0.0, 0.25, F.lit(None).cast("double")), listed("-2", 0.5, 0.0, draw),
        ).alias("bookmakers"),
    )
    payload = view(spark, sf, "tb_quotes").select("match_id", F.to_json(doc).alias("payload"))
    best = S.event_best_odds(payload)
    return best.groupBy("match_id").agg(
        *[F.max(f"odds_{o}").alias(f"odds_{o}") for o in ("home", "draw", "away")]
    )


@query(
    "normalise_injuries",
    twin("tb_squads", f"""
    raw as (select c_custkey as pos, {_canonical(NAME_SQL.format(k='c_custkey'))} as team,
      concat('Player ', c_custkey % 300) as player_name, c_mktsegment,
      case when c_custkey % 10 <> 0 then date '2026-06-01' + cast(c_custkey % 40 as int) end as d from customer)
    select team, player_name, min(pos) as pos from raw
    where c_mktsegment in ('BUILDING', 'MACHINERY') and (d is null or d >= date '2026-06-15') and pos % 23 <> 0
    group by 1, 2"""),
)
def normalise_injuries(spark, sf):
    key = F.col("c_custkey")
    day = F.date_add(F.lit("2026-06-01").cast("date"), (key % 40).cast("int")).cast("string")
    doc = F.struct(
        F.struct(
            F.when(key % 10 == 0, F.lit("soon")).otherwise(F.concat(day, F.lit("T00:00:00Z"))).alias("date")
        ).alias("fixture"),
        F.struct(feed_name(key).alias("name")).alias("team"),
        F.struct(
            F.when(key % 23 == 0, "").otherwise(F.concat(F.lit("Player "), (key % 300).cast("string"))).alias("name")
        ).alias("player"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Injury")
        .when(F.col("c_mktsegment") == "MACHINERY", "Suspension").otherwise("Doubt").alias("type"),
    )
    payload = table(spark, sf, "customer").select(key.alias("pos"), F.to_json(doc).alias("payload"))
    return S.normalise_injuries(payload, F.lit("2026-06-15 00:00:00").cast("timestamp_ntz"))


RAW_POSITIONS = ["GK", "Defender", "mf ", "Striker", "FWD", "Coach", "LB", "goalie"]


@query(
    "normalise_squads",
    twin("tb_squads", """
    raw as (select *, (['GK', 'DF', 'MF', 'FW', 'FW', null, 'DF', 'GK'])[1 + pos % 8] as position from tb_squads)
    select team, player_name, position, club, pos, cast(case pos % 4 when 0 then 18 + pos % 20 when 1 then 30
        when 2 then 0 else 44 end as int) as age, case when pos % 5 = 0 then 0 else caps end as caps
    from raw where position is not null and pos % 19 <> 0"""),
)
def normalise_squads(spark, sf):
    pos = F.col("pos")
    age = (
        F.when(pos % 4 == 0, F.concat(F.lit("30 March 1987 (aged "), (18 + pos % 20).cast("string"), F.lit(")")))
        .when(pos % 4 == 1, "30 March 1987").when(pos % 4 == 2, "unknown, 60 or 9")
        .otherwise("born 99, now 44 or 45")
    )
    raw = view(spark, sf, "tb_squads").select(
        "team", F.when(pos % 19 == 0, "Player").otherwise(F.concat(F.lit(" "), "player_name")).alias("player_name"),
        F.element_at(F.array(*map(F.lit, RAW_POSITIONS)), (pos % 8 + 1).cast("int")).alias("position"),
        "club", F.lit(None).cast("string").alias("club_country"), age.alias("age"),
        F.when(pos % 5 == 0, "12 (3)").otherwise(F.col("caps").cast("string")).alias("caps"), "pos",
    )
    return S.normalise_squads(raw).drop("club_country")


@query(
    "export_predictions",
    twin("tb_matches tb_params", CELLS + MARKETS + """
    select match_date as date, home_team, away_team, count(*) as n, round(sum(home_win), 5) as prob_home,
      round(sum(draw), 5) as prob_draw, round(sum(away_win), 5) as prob_away,
      round(sum(over_2_5), 5) as over_2_5, round(sum(btts_yes), 5) as btts_yes
    from tb_matches join markets using (match_id)
    where tournament = 'UEFA Euro' and match_date >= date '1999-01-01' group by 1, 2, 3"""),
)
def export_predictions(spark, sf):
    path = scratch_path(spark, "export")
    wanted, _ = K.complement_split(G.with_markets(scored(spark, sf)), "UEFA Euro", "1999-01-01")
    R.export_predictions(wanted, path)
    schema = (
        "date date, home_team string, away_team string, prob_home double, prob_draw double, "
        "prob_away double, over_2_5 double, btts_yes double"
    )
    written = spark.read.schema(schema).option("header", True).csv(path)
    return written.groupBy("date", "home_team", "away_team").agg(
        F.count("*").alias("n"),
        *[F.round(F.sum(c), 5).alias(c) for c in ("prob_home", "prob_draw", "prob_away", "over_2_5", "btts_yes")],
    )


@query(
    "form_log_append",
    twin("tb_ticks", """
    select cast(ts as date) as log_date, 2 * count(*) as n, round(sum(2 * value), 4) as form_score
    from events group by 1"""),
)
def form_log_append(spark, sf):
    path = scratch_path(spark, "log")
    signals = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("team"), F.col("value").alias("form_score"),
        F.lit(0.5).alias("confidence"), F.array(F.lit("x")).alias("key_absences"),
        F.lit("").alias("performance_context"), F.lit(1).alias("n_articles"), "ts",
    )
    for _ in range(2):
        R.append_form_log(signals, path, F.col("ts"))
    written = spark.read.schema("team string, form_score double, log_date date").json(path)
    return written.groupBy("log_date").agg(
        F.count("*").alias("n"), F.round(F.sum("form_score"), 4).alias("form_score")
    )


@query(
    "bracket_placeholder_filter",
    twin("tb_squads", """
    named as (select pos, case pos % 6 when 0 then concat(pos % 3 + 1, 'A') when 1 then concat('W', pos)
      when 2 then concat('3', 'A/B/C') when 3 then concat('Winner Group ', pos) when 4 then concat('1A', pos)
      else player_name end as name from tb_squads)
    select pos, regexp_matches(name, '^([0-9][A-Z]|[WL][0-9]+|[0-9][A-Z](/[A-Z])+)$') as slot,
      regexp_matches(lower(name), 'winner|runner-up|runner up|3rd|third|loser|tbd|to be determined') as words
    from named"""),
)
def bracket_placeholder_filter(spark, sf):
    name = F.expr("""case pos % 6 when 0 then concat(pos % 3 + 1, 'A') when 1 then concat('W', pos)
      when 2 then concat('3', 'A/B/C') when 3 then concat('Winner Group ', pos) when 4 then concat('1A', pos)
      else player_name end""")
    return view(spark, sf, "tb_squads").select(
        "pos", X.is_bracket_slot(name).alias("slot"), X.is_placeholder_words(name).alias("words")
    )


@query(
    "parse_score",
    twin("tb_matches", """
    select match_id, case when match_id % 5 <> 4 then home_score end as home,
      case when match_id % 5 <> 4 then away_score end as away from tb_matches"""),
)
def parse_score(spark, sf):
    raw = F.expr("""case match_id % 5 when 0 then concat(home_score, '-', away_score)
      when 1 then concat(' ', home_score, ' – ', away_score, ' ')
      when 2 then concat(home_score, '–', away_score, ' (a.e.t.)')
      when 3 then concat(home_score, '-', away_score, ' (4-3 p)') else concat('Match ', match_id) end""")
    df = view(spark, sf, "tb_matches").select("match_id", X.parse_score(raw).alias("s"))
    return df.select("match_id", "s.home", "s.away")


@query(
    "kickoff_utc",
    twin("tb_matches", """
    select match_id, cast(match_date as timestamp) + case when match_id % 4 = 0 then to_hours(0)
      else to_hours(cast(match_id % 24 as int)) + to_minutes(30) - to_hours(cast(match_id % 13 - 6 as int)) end
      as kickoff from tb_matches"""),
)
def kickoff_utc(spark, sf):
    offset = F.col("match_id") % 13 - 6
    sign = F.when(offset < 0, F.lit("")).otherwise(F.lit("+"))
    clock = F.concat(
        (F.col("match_id") % 24).cast("string"), F.lit(":30 UTC"), sign, offset.cast("string")
    )
    time = F.when(F.col("match_id") % 4 != 0, clock).otherwise("later")
    return view(spark, sf, "tb_matches").select(
        "match_id", X.kickoff_utc(F.col("match_date").cast("string"), time).alias("kickoff")
    )


@query(
    "iso_to_utc",
    twin("tb_matches", """
    select match_id, case match_id % 4 when 0 then cast(match_date as timestamp) + to_hours(15)
      when 1 then cast(match_date as timestamp) + to_hours(20) when 2 then cast(match_date as timestamp) + to_hours(18)
      end as utc from tb_matches"""),
)
def iso_to_utc(spark, sf):
    raw = F.expr("""concat(cast(match_date as string), case match_id % 4 when 0 then 'T18:00:00+03:00'
      when 1 then 'T18:00:00-02:00' when 2 then 'T18:00:00' else ' sometime' end)""")
    return view(spark, sf, "tb_matches").select("match_id", X.iso_to_utc(raw).alias("utc"))


@query(
    "nfc_name_key",
    twin("tb_squads", """
    select pos, lower(trim(player_name)) as plain, lower(concat('josé ', player_name)) as accented from tb_squads"""),
)
def nfc_name_key(spark, sf):
    # The accent arrives as a combining mark and must come out as one letter.
    split_accent = F.concat(F.lit("José "), "player_name", F.lit(" (captain)"))
    return view(spark, sf, "tb_squads").select(
        "pos", X.nfc_name_key(F.concat(F.lit(" "), "player_name")).alias("plain"),
        X.nfc_name_key(split_accent, strip_notes=True).alias("accented"),
    )


@query(
    "strip_code_fence",
    twin("tb_ticks", "select event_id, props as body from events"),
)
def strip_code_fence(spark, sf):
    fence = "```"
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(f"{fence}json\n"), "props", F.lit(f"\n{fence}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit(f"{fence}\n"), "props", F.lit(f"\n{fence} \n")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", X.strip_code_fence(text).alias("body"))


@query(
    "validate_signal",
    twin("tb_ticks", """
    k as (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)
    select event_id, case when event_id % 10 = 0 then 0 else greatest(-1, least(1, k / 40.0 - 1)) end::double as form_score,
      least(1, k / 50.0)::double as confidence, case when k % 2 = 0 then 'A,B' else 'A' end as absences,
      concat('notes ', k) as notes, event_id % 20 = 7 as unreadable from k"""),
)
def validate_signal(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    score = F.when(F.col("event_id") % 10 == 0, "high").otherwise((k / 40.0 - 1).cast("string"))
    doc = F.to_json(
        F.struct(
            score.alias("form_score"), (k / 50.0).alias("confidence"),
            F.when(k % 2 == 0, F.array(F.lit("A"), F.lit(""), F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit(None)))
            .alias("key_absences"),
            F.concat(F.lit("  notes "), k.cast("string")).alias("tactical_notes"),
        )
    )
    events = table(spark, sf, "events").select(
        "event_id", X.validate_signal(doc).alias("s"), F.col("event_id") % 20 == 7,
        X.validate_signal(F.when(F.col("event_id") % 20 == 7, F.lit("no json")).otherwise(doc)).alias("t"),
    )
    return events.select(
        "event_id", "s.form_score", "s.confidence", F.array_join("s.key_absences", ",").alias("absences"),
        F.col("s.tactical_notes").alias("notes"), "t.unreadable",
    )


@query(
    "clean_html",
    twin("tb_ticks", r"""
    plain as (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as t from pages),
    named as (select page_id, replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"') as t from plain)
    select page_id, md5(trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'),
      '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))) as digest from named"""),
)
def clean_html(spark, sf):
    """Tags, entities and white space of whole pages; the twin knows the entities that occur in them."""
    text = X.clean_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(text).alias("digest"))
