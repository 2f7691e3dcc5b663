"""Match context: weights, knockout and host flags, upcoming rows, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.text import knockout_stage
from matchlab.operators import ratings, squads, timeline


def is_current(df_or_none: DataFrame | None = None) -> Column:
    """Match of the tournament being predicted."""
    started = F.col("match_date") >= F.lit(C.CURRENT_START).cast("date")
    return (F.col("tournament") == C.CURRENT_TOURNAMENT) & started


def drop_current(matches: DataFrame) -> DataFrame:
    return matches.filter(~F.coalesce(is_current(), F.lit(False)))


def latest_date(matches: DataFrame) -> Column:
    """The last match date as a scalar subquery: one tiny aggregate, no join."""
    return matches.select(F.max("match_date")).scalar()


def days_before_latest(matches: DataFrame) -> Column:
    return F.greatest(F.datediff(latest_date(matches), F.col("match_date")), F.lit(0))


def sample_weight(matches: DataFrame, boost: float = C.CURRENT_BOOST) -> DataFrame:
    """Add sample_weight: tournament base x recency x boost, relative to this frame's last date."""
    base = F.when(F.col("tournament") == C.FRIENDLY, C.FRIENDLY_WEIGHT).otherwise(1.0)
    recency = F.pow(F.lit(0.5), days_before_latest(matches) / C.RECENCY_HALF_LIFE_DAYS)
    lift = F.when(is_current(), float(boost)).otherwise(1.0)
    return matches.withColumn("sample_weight", base * recency * lift)


def recency_weight(matches: DataFrame, per_day: float = C.DECAY_PER_DAY) -> DataFrame:
    """Add weight = exp(-per_day * days before the last match)."""
    age = F.datediff(latest_date(matches), F.col("match_date"))
    return matches.withColumn("weight", F.exp(-per_day * age))


def match_flags(matches: DataFrame) -> DataFrame:
    """Add elo_diff, is_knockout (any major tournament), is_host_home, is_host_away."""
    return matches.withColumns(
        {
            "elo_diff": F.col("elo_home_pre") - F.col("elo_away_pre"),
            "is_knockout": F.col("tournament").isin(*C.MAJOR_TOURNAMENTS),
            "is_host_home": F.col("home_team").isin(*C.HOSTS),
            "is_host_away": F.col("away_team").isin(*C.HOSTS),
        }
    )


def derive_context(
    matches: DataFrame,
    squad_features: DataFrame | None = None,
    form: int | None = None,
    sequence: int | None = None,
) -> DataFrame:
    """Rated matches with rest days, flags, sample weight and squad features.

    ``form`` and ``sequence`` ask for form columns too: they ride on the same
    joins as the rest days.
    """
    timed = timeline.with_team_days(matches, form=form, sequence=sequence)
    return squads.join_squad_features(sample_weight(match_flags(timed)), squad_features)


def upcoming_matches(
    schedule: DataFrame, next_only: bool = False, window_minutes: int = C.NEXT_WINDOW_MINUTES
) -> DataFrame:
    """Matches not yet played; ``next_only`` keeps those near the earliest kickoff."""
    open_matches = schedule.filter(~F.col("is_completed"))
    if not next_only:
        return open_matches
    first = open_matches.select(F.min("kickoff")).scalar()
    return open_matches.filter(
        F.col("kickoff") <= first + F.make_dt_interval(mins=F.lit(window_minutes))
    )


def due_notifications(
    schedule: DataFrame, now: Column, notice_minutes: int = C.NOTICE_MINUTES
) -> DataFrame:
    """Open matches with the time their notice is due, where that time is still ahead."""
    fire = F.col("kickoff") - F.make_dt_interval(mins=F.lit(notice_minutes))
    return schedule.filter(~F.col("is_completed")).withColumn("fire_at", fire).filter(
        F.col("fire_at") > now
    )


def train_val_split(matches: DataFrame, months: int = C.VALIDATION_MONTHS):
    """(train, validation): validation is the last months, but current matches always train."""
    cutoff = F.add_months(latest_date(matches), -months)
    recent = F.col("match_date") >= cutoff
    current = F.coalesce(is_current(), F.lit(False))
    return matches.filter(~recent | current), matches.filter(recent & ~current)


def complement_split(matches: DataFrame, tournament: str | None = None, since: str | None = None):
    """(predict, train): rows that pass the filters, and all others."""
    wanted = F.lit(True)
    if tournament is not None:
        wanted = wanted & (F.col("tournament") == tournament)
    if since is not None:
        wanted = wanted & (F.col("match_date") >= F.lit(since).cast("date"))
    wanted = F.coalesce(wanted, F.lit(False))
    return matches.filter(wanted), matches.filter(~wanted)


def _current_columns(rows: DataFrame, knockout: Column) -> DataFrame:
    return rows.withColumns(
        {
            "tournament": F.lit(C.CURRENT_TOURNAMENT),
            "neutral": F.lit(True),
            "country": F.lit(C.CURRENT_COUNTRY),
            "rest_days_home": F.lit(C.UPCOMING_REST_DAYS),
            "rest_days_away": F.lit(C.UPCOMING_REST_DAYS),
            "is_knockout": knockout,
            "is_host_home": F.col("home_team").isin(*C.HOSTS),
            "is_host_away": F.col("away_team").isin(*C.HOSTS),
            "sample_weight": F.lit(1.0),
        }
    )


def upcoming_feature_rows(
    schedule: DataFrame, latest: DataFrame, squad_features: DataFrame | None = None
) -> DataFrame:
    """Schedule rows with every column the models read; scores are placeholders."""
    rows = ratings.with_latest_rating(schedule, latest)
    rows = _current_columns(rows, F.lit(False)).withColumns(
        {
            "elo_diff": F.col("elo_home_pre") - F.col("elo_away_pre"),
            "home_score": F.lit(0),
            "away_score": F.lit(0),
        }
    )
    return squads.join_squad_features(rows, squad_features, year=C.CURRENT_YEAR)


def inject_completed(
    history: DataFrame,
    completed: DataFrame,
    squad_features: DataFrame | None = None,
    pool: str | None = None,
    rated: bool = True,
    **options,
) -> DataFrame:
    """History plus the current tournament's finished matches, with the same columns.

    ``rated`` asks for the ratings of the new matches, carried on from the history.

    ``sample_weight`` of the new rows is a placeholder of 1: recompute it over
    the merged frame, whose last date has moved.
    """
    day = F.coalesce("match_date", F.lit(C.CURRENT_FIRST_MATCH).cast("date"))
    rows = completed.withColumn("match_date", day)
    stage = F.col("stage") if "stage" in completed.columns else None
    rows = _current_columns(rows, knockout_stage(F.col("match_date"), stage))
    if rated:
        rows = ratings.extend_ratings(history, rows, pool, **options)
    rows = squads.join_squad_features(rows, squad_features, year=C.CURRENT_YEAR)
    shared = [c for c in rows.columns if c in history.columns]
    return history.unionByName(rows.select(*shared), allowMissingColumns=True)


def chronological(matches: DataFrame, source: str | None = None) -> DataFrame:
    """Total order by date; on a tie earlier sources, then smaller ids, come first."""
    keys = ["match_date", *([source] if source else []), "match_id"]
    return matches.orderBy(*keys)
