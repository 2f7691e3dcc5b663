"""Landed JSON payloads of schedule, price and absence feeds, one document per row."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions import text as X
from matchlab.functions.once import with_once

NESTED_FIXTURE = (
    "fixture struct<id:bigint,date:string,status:struct<short:string>,venue:struct<name:string>>,"
    "teams struct<home:struct<name:string>,away:struct<name:string>>,"
    "league struct<round:string>,"
    "score struct<fulltime:struct<home:int,away:int>>,"
    "goals struct<home:int,away:int>"
)
FLAT_FIXTURE = (
    "num bigint, date string, time string, team1 string, team2 string, round string, "
    "`group` string, ground string, score struct<ft:array<int>>"
)
EVENT_ODDS = (
    "id string, home_team string, away_team string, commence_time string, "
    "bookmakers array<struct<key:string,markets:array<struct<key:string,"
    "outcomes:array<struct<name:string,price:double>>>>>>"
)
ABSENCE = (
    "fixture struct<date:string>, team struct<name:string>, player struct<name:string>, type string"
)


def _parsed(payload: DataFrame, column: str, schema: str) -> DataFrame:
    return with_once(payload, "j", F.from_json(column, schema)).drop(column)


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


def normalise_fixtures_nested(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Nested fixture documents to schedule rows, with the 90-minute score."""
    j = _parsed(payload, column, NESTED_FIXTURE)
    kept = [c for c in payload.columns if c != column]
    return j.select(
        *kept,
        X.iso_to_utc(F.col("j.fixture.date")).alias("kickoff"),
        X.alias_team(_text("j.teams.home.name"), "nested").alias("home_team"),
        X.alias_team(_text("j.teams.away.name"), "nested").alias("away_team"),
        F.col("j.score.fulltime.home").alias("home_score"),
        F.col("j.score.fulltime.away").alias("away_score"),
        F.coalesce("j.league.round", F.lit("Group Stage")).alias("stage"),
        _text("j.fixture.venue.name").alias("venue"),
        F.coalesce(F.col("j.fixture.status.short").isin(*C.FINISHED_STATUSES), F.lit(False)).alias(
            "is_completed"
        ),
    )


def normalise_fixtures_flat(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Flat fixture documents to schedule rows; bracket slots are left out."""
    j = _parsed(payload, column, FLAT_FIXTURE)
    kept = [c for c in payload.columns if c != column]
    home, away = _text("j.team1"), _text("j.team2")
    full = F.size("j.score.ft") == 2
    group, round_name = _text("j.group"), _text("j.round")
    # A venue is a plain text or a document with a name.
    venue = F.coalesce(F.get_json_object("j.ground", "$.name"), F.col("j.ground"), F.lit(""))
    return j.filter(~X.is_bracket_slot(home) & ~X.is_bracket_slot(away)).select(
        *kept,
        X.kickoff_utc(F.col("j.date"), F.col("j.time")).alias("kickoff"),
        X.alias_team(home, "flat").alias("home_team"),
        X.alias_team(away, "flat").alias("away_team"),
        F.when(full, F.get("j.score.ft", F.lit(0))).alias("home_score"),
        F.when(full, F.get("j.score.ft", F.lit(1))).alias("away_score"),
        F.when(group != "", F.concat_ws(" - ", group, round_name)).otherwise(round_name).alias("stage"),
        venue.alias("venue"),
        F.coalesce(full, F.lit(False)).alias("is_completed"),
    )


def source_fallback(sources: list[DataFrame]) -> DataFrame:
    """Rows of the first source, in order of preference, that has any.

    A source is only probed for one row, and only the one that is taken is read.
    """
    return next((df for df in sources if not df.isEmpty()), sources[-1])


def event_best_odds(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Best 1X2 price of each event document, read inside the row without a shuffle."""
    j = _parsed(payload, column, EVENT_ODDS)
    kept = [c for c in payload.columns if c != column]
    markets = F.flatten(
        F.transform("j.bookmakers", lambda b: F.filter(b["markets"], lambda m: m["key"] == "h2h"))
    )
    outcomes = F.flatten(F.transform(markets, lambda m: m["outcomes"]))
    rows = with_once(j, "_o", outcomes)

    def best(name: Column) -> Column:
        hits = F.filter("_o", lambda o: o["name"] == name)
        return F.array_max(F.transform(hits, lambda o: o["price"]))

    home, draw, away = best(F.col("j.home_team")), best(F.lit("Draw")), best(F.col("j.away_team"))
    prices = F.struct(
        home.alias("odds_home"), F.when(draw > 0, draw).alias("odds_draw"), away.alias("odds_away")
    )
    priced = with_once(rows, "_p", prices).filter((F.col("_p.odds_home") > 0) & (F.col("_p.odds_away") > 0))
    return priced.select(
        *kept, "j.home_team", "j.away_team", F.col("j.commence_time").alias("commence_time"), "_p.*"
    )


def normalise_injuries(payload: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """(team, player_name, pos): absences for matches not yet past, each player once per team.

    ``payload`` carries pos, its place in the feed.  A date that cannot be read
    does not drop the record.
    """
    j = _parsed(payload, column, ABSENCE)
    when = X.iso_to_utc(F.col("j.fixture.date"))
    rows = j.select(
        "pos", when.alias("_when"), F.col("j.type").alias("_type"),
        X.alias_team(_text("j.team.name"), "nested").alias("team"),
        _text("j.player.name").alias("player_name"),
    ).filter(
        (F.col("_when").isNull() | (F.col("_when") >= now))
        & F.col("_type").isin(*C.ABSENCE_TYPES)
        & (F.col("team") != "") & (F.col("player_name") != "")
    )
    return rows.groupBy("team", "player_name").agg(F.min("pos").alias("pos"))


def normalise_squads(raw: DataFrame) -> DataFrame:
    """Typed roster rows; blank names and unknown positions are left out.

    ``raw`` has team, player_name, position, club, club_country, age, caps as text.
    """
    name = F.trim("player_name")
    rows = with_once(raw.withColumn("player_name", name), "position", X.squad_position(F.col("position")))
    usable = (F.col("player_name") != "") & ~F.lower("player_name").isin("nan", "player", "name")
    return rows.filter(usable & F.col("position").isNotNull()).withColumns(
        {
            "club": F.trim("club"),
            "club_country": F.trim(_text("club_country")),
            "age": F.coalesce(X.squad_age(F.col("age")), F.lit(0)),
            "caps": F.coalesce(X.squad_caps(F.col("caps")), F.lit(0)),
        }
    )
