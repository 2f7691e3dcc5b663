"""Per-team features that may only use what happened strictly before a match.

Several matches may share a date, so every "before" is a matter of dates, never
of row positions.  Work per team is therefore done on team-days: a team-day
keeps at most the last ``n`` matches of its date, cut while the rows are still
spread over the map tasks.  A window over one team then sees no more rows than
the calendar has days, however many matches the team played.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C


def points(goals_for: Column, goals_against: Column) -> Column:
    return (
        F.when(goals_for > goals_against, 3).when(goals_for == goals_against, 1).otherwise(0)
    )


def team_long_form(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each side's view."""

    def side(team: str, other: str, is_home: bool) -> Column:
        fields = [
            F.col(f"{team}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(is_home).alias("is_home"),
            F.col(f"{team}_score").alias("gf"),
            F.col(f"{other}_score").alias("ga"),
            points(F.col(f"{team}_score"), F.col(f"{other}_score")).alias("pts"),
        ]
        if f"elo_{other}_pre" in matches.columns:
            fields.append(F.col(f"elo_{other}_pre").alias("opp_rating"))
        return F.struct(*fields)

    sides = F.explode(F.array(side("home", "away", True), side("away", "home", False)))
    extra = [c for c in ("stage",) if c in matches.columns]
    return matches.select("match_id", "match_date", *extra, sides.alias("side")).select(
        "match_id", "match_date", *extra, "side.*"
    )


def _side_rows(matches: DataFrame) -> DataFrame:
    sides = F.explode(F.array("home_team", "away_team")).alias("team")
    return matches.select("match_id", "match_date", sides)


def _days(matches: DataFrame, n: int) -> DataFrame:
    """One row per team and date with that date's last ``n`` matches in order."""
    long = team_long_form(matches)
    latest = Window.partitionBy("team", "match_date").orderBy(F.desc("match_id"))
    kept = long.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n)
    item = F.struct("match_id", "gf", "ga", "pts", "opp_rating", "is_home")
    return kept.groupBy("team", "match_date").agg(F.sort_array(F.collect_list(item)).alias("day"))


def team_days(matches: DataFrame, n: int | None = None, rest: bool = True) -> DataFrame:
    """(team, match_date), with ``rest`` also (first_match, gap) and with ``n`` (history).

    ``gap`` counts days since the team's previous playing date; ``history`` holds
    its last n matches strictly before the date.  Both come from one ordering of
    the team-days: n preceding team-days always hold the n preceding matches.
    """
    history = None if n is None else _days(matches, n)
    if rest or history is None:
        days = _side_rows(matches).groupBy("team", "match_date").agg(
            F.min("match_id").alias("first_match")
        )
        if history is not None:
            # Both aggregates are spread by team and date already: no further shuffle.
            days = days.join(history, ["team", "match_date"])
    else:
        days = history
    order = Window.partitionBy("team").orderBy("match_date")
    columns: dict[str, Column] = {}
    if rest:
        gap = F.datediff("match_date", F.lag("match_date").over(order)).cast("double")
        columns |= {"first_match": F.col("first_match"), "gap": gap}
    if n is not None:
        columns["history"] = _last(n, F.collect_list("day").over(order.rowsBetween(-n, -1)))
    return days.select("team", "match_date", *[c.alias(name) for name, c in columns.items()])


def with_team_days(
    matches: DataFrame,
    rest: bool = True,
    form: int | None = None,
    sequence: int | None = None,
) -> DataFrame:
    """Add rest days, form aggregates and form sequences with one join per side.

    rest_days_*: null for a team's first match, 0 for a later match of a date.
    form_*_*: over the last ``form`` matches.  home_seq / away_seq: ``sequence``
    x 5 values.  A team never meets itself.
    """
    n = max(form or 0, sequence or 0) or None
    days = team_days(matches, n, rest)
    columns: dict[str, Column] = {}
    if rest:
        columns |= {"_first": F.col("first_match"), "_gap": F.col("gap")}
    if form:
        columns |= form_aggregates(_last(form, F.array("history")))
    if sequence:
        columns["_seq"] = form_sequence(_last(sequence, F.array("history")), sequence)
    lookup = days.select("team", "match_date", *[c.alias(name) for name, c in columns.items()])
    out = matches
    for side in ("home", "away"):
        renamed = {name: f"{name}_{side}" for name in columns} | {"team": f"{side}_team"}
        out = out.join(
            lookup.withColumnsRenamed(renamed), [f"{side}_team", "match_date"], "left"
        )
        if rest:
            first = F.col("match_id") == F.col(f"_first_{side}")
            value = F.when(first, F.col(f"_gap_{side}")).otherwise(F.lit(0.0))
            out = out.withColumn(f"rest_days_{side}", value).drop(f"_first_{side}", f"_gap_{side}")
        if sequence:
            out = out.withColumnRenamed(f"_seq_{side}", f"{side}_seq")
    return out


def rest_days(matches: DataFrame) -> DataFrame:
    """Add rest_days_home and rest_days_away."""
    return with_team_days(matches)


def _last(n: int, arrays: Column) -> Column:
    flat = F.flatten(arrays)
    return F.slice(flat, F.greatest(F.size(flat) - n + 1, F.lit(1)), n)


def history_asof(matches: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """Add ``history`` to probes (team, as_of): the last n matches strictly before as_of.

    Probe dates need not be playing dates.  Probes are reduced to distinct
    team-dates before they meet the timeline, and joined back afterwards.
    """
    inclusive = Window.partitionBy("team").orderBy("match_date").rowsBetween(-(n - 1), 0)
    real = _days(matches, n).select(
        "team", "match_date", _last(n, F.collect_list("day").over(inclusive)).alias("upto")
    )
    asked = probes.select("team", F.col("as_of").alias("match_date")).distinct()
    empty = asked.withColumn("upto", F.lit(None).cast(real.schema["upto"].dataType))
    day = F.datediff(F.col("match_date"), F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("team").orderBy("_day").rangeBetween(
        Window.unboundedPreceding, -1
    )
    joined = (
        real.unionByName(empty)
        .withColumn("_day", day)
        .withColumn("_asked", F.col("upto").isNull())
        .withColumn("history", F.last("upto", ignorenulls=True).over(before))
        .filter("_asked")
        .select("team", F.col("match_date").alias("as_of"), "history")
    )
    return probes.join(joined, ["team", "as_of"], "left")


def form_sequence(history: Column, n: int = C.SEQUENCE_LENGTH) -> Column:
    """``array<array<float>>`` n x 5, oldest first, zero rows in front."""
    rows = F.transform(
        F.coalesce(history, F.array().cast(_HISTORY)),
        lambda m: F.array(
            m["gf"].cast("float"), m["ga"].cast("float"), m["pts"].cast("float"),
            (m["opp_rating"] / C.FORM_RATING_SCALE).cast("float"), m["is_home"].cast("float"),
        ),
    )
    zero = F.array(*[F.lit(0.0).cast("float")] * C.FORM_FEATURES)
    return F.concat(F.array_repeat(zero, F.lit(n) - F.size(rows)), rows)


_HISTORY = (
    "array<struct<match_id:bigint,gf:int,ga:int,pts:int,opp_rating:double,is_home:boolean>>"
)


def form_aggregates(history: Column) -> dict[str, Column]:
    """form_gf, form_ga, form_pts, form_opp_elo (means) and form_n_played; zeros if none."""
    played = F.coalesce(F.size(history), F.lit(0))
    played = F.when(history.isNull(), 0).otherwise(played)

    def mean(field: str) -> Column:
        total = F.aggregate(
            history, F.lit(0.0), lambda acc, m: acc + m[field].cast("double")
        )
        return F.when(played > 0, total / played).otherwise(F.lit(0.0))

    return {
        "form_gf": mean("gf"),
        "form_ga": mean("ga"),
        "form_pts": mean("pts"),
        "form_opp_elo": mean("opp_rating"),
        "form_n_played": played.cast("double"),
    }


def match_form(matches: DataFrame, n: int = C.AGGREGATE_LENGTH) -> DataFrame:
    """Add form_*_home and form_*_away over the last n matches of each side."""
    return with_team_days(matches, rest=False, form=n)


def match_sequences(matches: DataFrame, n: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """Add home_seq and away_seq, the n x 5 form sequences of both sides."""
    return with_team_days(matches, rest=False, sequence=n)


def numbered_team_matches(matches: DataFrame) -> DataFrame:
    """Long form with ``seq`` (1 = first) and ``n_matches`` per team.

    Counts per team-day are added up along the calendar, and only the matches of
    one day are ranked in one group, so a busy team is not ranked in one task.
    """
    long = team_long_form(matches)
    days = long.groupBy("team", "match_date").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("team").orderBy("match_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy("team")
    days = days.select(
        "team", "match_date",
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n_matches"),
    )
    within = Window.partitionBy("team", "match_date").orderBy("match_id")
    return (
        long.withColumn("_rank", F.row_number().over(within))
        .join(days, ["team", "match_date"])
        .withColumn("seq", (F.col("_before") + F.col("_rank")).cast("bigint"))
        .drop("_before", "_rank")
    )


def chronological_blocks(matches: DataFrame) -> DataFrame:
    """One labelled line per team and match: number, opponent, date, round, result."""
    rows = numbered_team_matches(matches)
    word = (
        F.when(F.col("gf") > F.col("ga"), "won")
        .when(F.col("gf") == F.col("ga"), "drew")
        .otherwise("lost")
    )
    stage = F.col("stage") if "stage" in rows.columns else F.lit(None).cast("string")
    stage = F.when(F.coalesce(stage, F.lit("")) == "", "round unknown").otherwise(stage)
    header = F.concat(
        F.lit("=== Match "), F.col("seq").cast("string"), F.lit(" of "),
        F.col("n_matches").cast("string"), F.lit(" — vs "), F.col("opponent"),
        F.lit(" ("), F.col("match_date").cast("string"), F.lit("), "), stage, F.lit(", "),
        F.col("team"), F.lit(" "), word, F.lit(" "), F.col("gf").cast("string"), F.lit("-"),
        F.col("ga").cast("string"), F.lit(" ==="),
    )
    return rows.select(
        "team", "match_id", "match_date", "opponent", "seq", "n_matches",
        word.alias("result"), header.alias("header"),
    )
