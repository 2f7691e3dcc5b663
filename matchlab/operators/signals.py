"""Requests to and answers from an external text model, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions import adjust as A
from matchlab.functions import text as X
from matchlab.functions.grid import with_expected_goals, with_markets, with_outcome_probs, with_score_grid


def signal_requests(articles: DataFrame) -> DataFrame:
    """(team, request, urls, n_articles) from ranked articles (team, rank, text, link).

    Articles come from a top list, so a team's group is a handful of rows.
    """
    listed = F.sort_array(F.collect_list(F.struct("rank", "text", "link"))).alias("_l")
    return articles.groupBy("team").agg(listed).select(
        "team",
        F.array_join(F.transform("_l", lambda s: s["text"]), C.BLOCK_SEPARATOR).alias("request"),
        F.transform("_l", lambda s: s["link"]).alias("urls"),
        F.size("_l").alias("n_articles"),
    )


def signal_responses(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Validated signal per request; neutral with the reason kept where there is none.

    ``answers`` has team, raw and error.
    """
    rows = requests.join(answers, "team", "left").withColumn("_s", X.validate_signal(F.col("raw")))
    failed = F.col("error").isNotNull() | F.col("_s.unreadable")
    reason = F.coalesce(
        "error",
        F.when(F.col("raw").isNull(), F.lit("no answer")).when(
            F.col("_s.unreadable"), F.lit("unreadable answer")
        ),
    )
    none = F.array().cast("array<string>")

    def value(name: str, neutral: Column) -> Column:
        return F.when(failed, neutral).otherwise(F.col(f"_s.{name}")).alias(name)

    return rows.select(
        "team", value("form_score", F.lit(0.0)), value("confidence", F.lit(0.0)),
        value("key_absences", none), value("morale_signals", none),
        value("tactical_notes", F.lit("")), value("performance_context", F.lit("")),
        F.when(failed, none).otherwise(F.col("urls")).alias("sources"),
        F.when(failed, 0).otherwise(F.col("n_articles")).alias("n_articles"),
        reason.alias("error"),
    )


def request_key(team_days: DataFrame, version: int = C.TRAJECTORY_VERSION) -> DataFrame:
    """(team, key): version, team and its sorted match dates.

    Dates are reduced to distinct team-days before they are listed, so a list is
    no longer than the calendar.
    """
    days = team_days.select("team", "match_date").distinct()
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list("match_date")), lambda d: d.cast("string")), ","
    )
    return days.groupBy("team").agg(listed.alias("_d")).select(
        "team", F.concat(F.lit(f"v{version}|"), "team", F.lit("|"), "_d").alias("key")
    )


def work_to_do(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys that have no stored answer yet; failures are never stored, so they come again."""
    return keys.join(cached.select("key"), "key", "left_anti")


def storable(responses: DataFrame) -> DataFrame:
    return responses.filter("error is null")


def _side(matches: DataFrame, table: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
    lookup = table.select(
        F.col("team").alias(f"{side}_team"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return matches.join(lookup, f"{side}_team", "left")


def adjustment_chain(
    predictions: DataFrame,
    losses: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    trajectory: DataFrame | None = None,
) -> DataFrame:
    """Rates adjusted for absences, then news, then trajectory; grid and markets built once.

    ``losses`` is (team, loss); the signals are (team, form_score, confidence).
    A team without a row is left alone.
    """
    rows = predictions.drop(
        "grid", "markets", "prob_home", "prob_draw", "prob_away", "expected_home", "expected_away"
    )
    columns = rows.columns
    for side in ("home", "away"):
        rate = F.col(f"lambda_{side}")
        if losses is not None:
            rows = _side(rows, losses, side, {"loss": "_loss"})
            rate = A.injury_adjust(rate, F.col("_loss"))
        for name, table, factor in (
            ("s", sentiment, A.sentiment_factor), ("t", trajectory, A.trajectory_factor),
        ):
            if table is not None:
                rows = _side(
                    rows, table, side, {"form_score": f"_{name}_score", "confidence": f"_{name}_conf"}
                )
                rate = A.scale_rate(rate, factor(F.col(f"_{name}_score"), F.col(f"_{name}_conf")))
        rows = rows.withColumn(f"lambda_{side}", rate).select(*columns)
    return with_expected_goals(with_outcome_probs(with_markets(with_score_grid(rows))))
