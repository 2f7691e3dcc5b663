"""Whole runs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlab.functions import grid as G
from matchlab.functions import metrics as M
from matchlab.models import ensemble, goal_rates, score_net, trees
from matchlab.operators import bets, context, folds, odds, ratings, signals
from matchlab.session import durable
from matchlab.sources import results

best_prices = odds.best_quotes


def training_set(
    matches: DataFrame, squad_features: DataFrame | None = None, pool: str | None = "pool"
) -> DataFrame:
    """Rated matches with every context column, without the current tournament."""
    rated = ratings.elo_ratings(context.drop_current(matches), pool)
    return context.derive_context(rated, squad_features)


def _scored(predictions: DataFrame, prices: DataFrame | None) -> DataFrame:
    rows = predictions if prices is None else predictions.join(prices, "match_id", "left")
    rows = bets.with_returns(bets.with_selection(rows))
    outcome = M.outcome_class(F.col("home_score"), F.col("away_score"))
    nll = (
        G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score"))
        if "grid" in rows.columns
        else F.lit(None).cast("double")
    )
    return rows.withColumns(
        {"rps": M.rps(F.col("prob_home"), F.col("prob_draw"), outcome), "nll": nll}
    )


def fold_latest_ratings(
    matches: DataFrame, fold_table: DataFrame, home: str, away: str
) -> DataFrame:
    """(fold_idx, team, rating): last rating of each team within each fold's training window.

    One row per team and period is kept first and holds until the next of them.
    """
    rows = folds.training_period(matches, fold_table).select(
        "period", "match_date", "match_id",
        F.explode(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.col(home).alias("rating")),
                F.struct(F.col("away_team").alias("team"), F.col(away).alias("rating")),
            )
        ).alias("s"),
    )
    order = F.struct("match_date", "match_id")
    per_period = rows.groupBy("period", "s.team").agg(
        F.max_by("s.rating", order).alias("rating")
    )
    # A rating holds for the folds up to the team's next period; a team has one row per period.
    following = F.lead("period").over(Window.partitionBy("team").orderBy("period"))
    last = fold_table.select(F.max("fold_idx")).scalar()
    held = per_period.withColumn("_until", following).select(
        "team", "rating", F.sequence("period", F.coalesce(F.col("_until") - 1, last)).alias("_f")
    )
    return held.select(F.explode("_f").alias("fold_idx"), "team", "rating")


def score_rating_folds(
    matches: DataFrame, fold_table: DataFrame, latest: DataFrame, prices: DataFrame | None = None
) -> DataFrame:
    """Fold metrics of the rating model; matches with an unseen team drop out."""
    rows = folds.validation_rows(matches.drop("elo_home_pre", "elo_away_pre"), fold_table)
    for side in ("home", "away"):
        lookup = latest.select(
            "fold_idx", F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"elo_{side}_pre")
        )
        rows = rows.join(lookup, ["fold_idx", f"{side}_team"])
    return folds.fold_metrics(_scored(ratings.with_rating_probs(rows), prices))


def backtest(
    matches: DataFrame,
    odds: DataFrame | None = None,
    model: str = "rates",
    tournament: str | None = None,
    start_year: int | None = None,
    pool: str | None = "pool",
    summary: bool = True,
    tree_options: dict | None = None,
    **fit_options,
) -> DataFrame:
    """Walk-forward evaluation of one model, one row per fold and a total row.

    ``model`` is "rates" (attack/defence), "ratings", "trees" or "ensemble" (the
    equal mean of rates and trees).  Ratings run over the full table; tournament
    and year filters come after them.
    """
    if model not in ("rates", "ratings", "trees", "ensemble"):
        raise ValueError(f"unknown model {model!r}")
    kept = matches
    if model != "rates":
        scanned = durable(ratings.rating_scan(matches, pool))
        kept = matches.join(
            scanned.select(
                "match_id", "elo_home_pre", "elo_away_pre", "elo_home_post", "elo_away_post"
            ),
            "match_id",
        )
    if model in ("trees", "ensemble"):
        kept = context.derive_context(kept)
    if tournament is not None:
        kept = kept.filter(F.col("tournament") == tournament)
    if start_year is not None:
        kept = kept.filter(F.year("match_date") >= start_year)
    table = folds.walk_forward_folds(kept)
    if model == "ratings":
        latest = fold_latest_ratings(kept, table, "elo_home_post", "elo_away_post")
        per_fold = score_rating_folds(kept, table, latest, odds)
    else:
        parts = []
        if model in ("rates", "ensemble"):
            teams, scalars = goal_rates.fit(
                goal_rates.fold_stats(kept, table), by=("fold_idx",), **fit_options
            )
            rows = folds.validation_rows(kept, table)
            parts.append(goal_rates.predict(rows, teams, scalars, by=("fold_idx",)))
        if model in ("trees", "ensemble"):
            parts.append(_tree_folds(kept, table, tree_options or {}))
        predicted = parts[0]
        if len(parts) == 2:
            keys = ["fold_idx", "match_id"]
            mean = ensemble.ensemble_grid(parts, keys=keys)
            predicted = predicted.select(*keys, "home_score", "away_score").join(mean, keys)
        per_fold = folds.fold_metrics(_scored(predicted, odds))
    return folds.backtest_summary(per_fold) if summary else per_fold


def _tree_folds(matches: DataFrame, fold_table: DataFrame, options: dict) -> DataFrame:
    """One distributed tree fit per fold, in turn; there are as many as the calendar allows."""
    out = None
    for fold in fold_table.orderBy("fold_idx").collect():
        train = matches.filter(F.col("match_date") < F.lit(fold["train_end"]))
        val = matches.filter(
            (F.col("match_date") >= F.lit(fold["val_start"]))
            & (F.col("match_date") < F.lit(fold["val_end"]))
        ).withColumns({"fold_idx": F.lit(fold["fold_idx"]), "train_end": F.lit(fold["train_end"])})
        val = folds.known_teams_only(val, matches)
        part = trees.fit(train, **options).predict(val)
        out = part if out is None else out.unionByName(part)
    return out


def played(
    history: DataFrame,
    completed: DataFrame | None = None,
    squad_features: DataFrame | None = None,
    pool: str | None = "pool",
    contextual: bool = True,
) -> DataFrame:
    """The rows a model is fitted on before the next matches of the running tournament.

    With ``completed`` the history's own rows of that tournament give way to them;
    sample weights are taken from the last date of the merged rows.  ``contextual``
    adds ratings, rest days, flags and squad features.
    """
    if not contextual:
        if completed is None:
            return history
        return context.inject_completed(context.drop_current(history), completed, pool=pool, rated=False)
    rows = history if completed is None else context.drop_current(history)
    rows = context.derive_context(ratings.elo_ratings(rows, pool), squad_features)
    if completed is not None:
        rows = context.inject_completed(rows, completed, squad_features, pool)
    return durable(context.sample_weight(rows))


def predict_upcoming(
    history: DataFrame,
    schedule: DataFrame,
    prices: DataFrame | None = None,
    losses: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    trajectory: DataFrame | None = None,
    squad_features: DataFrame | None = None,
    pool: str | None = "pool",
    next_only: bool = False,
    model: str = "rates",
    completed: DataFrame | None = None,
    network: tuple[DataFrame, dict] | None = None,
    tree_options: dict | None = None,
    **fit_options,
) -> DataFrame:
    """Upcoming matches with adjusted goal rates, markets and bet selection.

    ``model`` is "rates" (attack/defence), "trees", "network" (``network`` holds its
    vocabulary with vectors, and its weights) or "ensemble", the equal mean of rates,
    trees and, where given, the network.  ``completed`` are finished matches of the
    running tournament; they are put into the history first.  Every row has the latest
    ratings of both sides (``elo_home_pre``, ``elo_away_pre``), whatever the model.  A match of a team that
    the rates model has not seen stays without rates, the team listed in ``unseen``.
    """
    if model not in ("rates", "trees", "network", "ensemble"):
        raise ValueError(f"unknown model {model!r}")
    if model == "network" and network is None:
        raise ValueError("the network needs its vocabulary and weights")
    coming = context.upcoming_matches(schedule, next_only)
    past = played(history, completed, squad_features, pool, contextual=model != "rates")
    latest = ratings.current_ratings(ratings.rating_scan(past, pool))
    latest = latest if pool else latest.select("team", "rating")
    rows = context.upcoming_feature_rows(coming, latest, squad_features)
    parts = []
    if model in ("rates", "ensemble"):
        teams, scalars = goal_rates.fit(goal_rates.sufficient_stats(past), **fit_options)
        parts.append(goal_rates.predict(rows, teams, scalars))
    if model in ("trees", "ensemble"):
        parts.append(trees.fit(past, **(tree_options or {})).predict(rows))
    if network is not None and model in ("network", "ensemble"):
        vocab, weights = network
        tensors = score_net.sequence_tensors(score_net.asof_sequences(rows, past), vocab)
        parts.append(score_net.net_batch_score(tensors, weights))
    if model == "rates":
        (rated,) = parts
    else:
        forecast = ensemble.ensemble_grid(parts) if model == "ensemble" else parts[0]
        names = ["match_id", "lambda_home", "lambda_away", "rho", "grid"]
        rated = rows.join(forecast.select(*names), "match_id")
        if model == "ensemble":
            rated = rated.join(parts[0].select("match_id", "unseen"), "match_id")
    if losses is None and sentiment is None and trajectory is None:
        adjusted = G.with_expected_goals(G.with_outcome_probs(G.with_markets(rated)))
    else:
        adjusted = signals.adjustment_chain(rated, losses, sentiment, trajectory)
    if prices is None:
        return adjusted
    return bets.live_bets(odds.odds_join_swapped(adjusted, prices))


def export_run(
    matches: DataFrame,
    path: str,
    tournament: str | None = None,
    since: str | None = None,
    model: str = "rates",
    tree_options: dict | None = None,
    pool: str | None = "pool",
    **fit_options,
) -> DataFrame:
    """Fit on all matches but the chosen ones, predict those, write the predictions to ``path``.

    ``model`` is "rates", "trees" or "ensemble", their equal mean.
    """
    if model not in ("rates", "trees", "ensemble"):
        raise ValueError(f"unknown model {model!r}")
    rows = matches if model == "rates" else played(matches, pool=pool)
    wanted, train = context.complement_split(rows, tournament, since)
    parts = []
    if model != "trees":
        teams, scalars = goal_rates.fit(goal_rates.sufficient_stats(train), **fit_options)
        parts.append(goal_rates.predict(wanted, teams, scalars))
    if model != "rates":
        parts.append(trees.fit(train, **(tree_options or {})).predict(wanted))
    forecast = ensemble.ensemble_grid(parts) if len(parts) == 2 else parts[0]
    rated = wanted.join(forecast.select("match_id", "grid"), "match_id")
    out = G.with_outcome_probs(G.with_markets(rated))
    results.export_predictions(out, path)
    return out
