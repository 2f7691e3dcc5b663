"""Training tensors and batch scoring of the recurrent score network.

Team embeddings grow with the number of teams, so they are a DataFrame joined by
team; the remaining weights have a fixed size and travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.grid import with_expected_goals, with_outcome_probs, with_score_grid
from matchlab.operators import timeline
from matchlab.operators.folds import all_teams
from matchlab.session import durable

_SQUAD = [f"squad_{f}_{s}" for f in ("top5", "caps", "goals") for s in ("home", "away")]


def team_vocab(matches: DataFrame) -> DataFrame:
    """(team, idx): 1-based place in alphabetical order; 0 is kept for unknown teams.

    Places come from a range-sorted copy: rows per partition are counted, and
    each row adds its offset, so no single task ranks all teams.
    """
    parted = durable(
        all_teams(matches).orderBy("team").withColumn("_id", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parted.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sorted copy.
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        parted.select("team", part.alias("_part"), row.alias("_row"))
        .join(F.broadcast(offsets), "_part")
        .select("team", (F.col("_off") + F.col("_row") + 1).cast("bigint").alias("idx"))
    )


def context_vector(columns: list[str]) -> Column:
    """``array<float>`` of 13 scaled context values; missing rest counts 0 and is not capped."""

    def rest(side: str) -> Column:
        return F.coalesce(f"rest_days_{side}", F.lit(0.0)) / C.REST_SCALE

    squad = [
        F.coalesce(F.col(c), F.lit(0.0)) if c in columns else F.lit(0.0) for c in _SQUAD
    ]
    values = [
        F.col("neutral"), rest("home"), rest("away"), F.col("elo_diff") / C.RATING_SCALE,
        F.col("is_knockout"), F.col("is_host_home"), F.col("is_host_away"), *squad,
    ]
    return F.array(*[v.cast("float") for v in values])


def with_vectors(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(team, idx, vector): the vocabulary with its embeddings (idx, vector), null where there is none."""
    return vocab.join(embeddings.select("idx", "vector"), "idx", "left").select("team", "idx", "vector")


def asof_sequences(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Add home_seq and away_seq of matches still to come, from ``history`` before their date."""
    rows = matches
    for side in ("home", "away"):
        probes = rows.select(F.col(f"{side}_team").alias("team"), F.col("match_date").alias("as_of")).distinct()
        found = timeline.history_asof(history, probes, C.SEQUENCE_LENGTH).select(
            F.col("team").alias(f"{side}_team"), F.col("as_of").alias("match_date"),
            timeline.form_sequence(F.col("history")).alias(f"{side}_seq"),
        )
        rows = rows.join(found, [f"{side}_team", "match_date"], "left")
    return rows


def sequence_tensors(matches: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per match: team indexes, two 10 x 5 sequences, 13 context values.

    If ``vocab`` has a vector for its teams, home_vector and away_vector ride on
    the same joins.
    """
    rows = matches if "home_seq" in matches.columns else timeline.match_sequences(matches)
    rows = rows.withColumn("context", context_vector(rows.columns))
    vectors = []
    for side in ("home", "away"):
        renamed = {"team": f"{side}_team", "idx": f"_{side}", "vector": f"{side}_vector"}
        rows = rows.join(vocab.withColumnsRenamed(renamed), f"{side}_team", "left")
        vectors += [f"{side}_vector"] * ("vector" in vocab.columns)
    return rows.select(
        "match_id", "match_date", "home_team", "away_team", "home_score", "away_score",
        F.coalesce("_home", F.lit(0)).alias("home_idx"),
        F.coalesce("_away", F.lit(0)).alias("away_idx"), "home_seq", "away_seq", "context", *vectors,
        *[c for c in ("sample_weight",) if c in rows.columns],
    )


def _gru(seq: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    hidden = np.zeros((len(seq), C.GRU_HIDDEN))
    for step in range(seq.shape[1]):
        given = seq[:, step] @ w["gru_in"].T + w["gru_in_bias"]
        kept = hidden @ w["gru_hid"].T + w["gru_hid_bias"]
        (ir, iz, inn), (hr, hz, hn) = np.split(given, 3, axis=1), np.split(kept, 3, axis=1)
        reset, update = 1 / (1 + np.exp(-(ir + hr))), 1 / (1 + np.exp(-(iz + hz)))
        fresh = np.tanh(inn + reset * hn)
        hidden = (1 - update) * fresh + update * hidden
    return hidden


def _forward(home, away, home_seq, away_seq, context, w) -> np.ndarray:
    mixed = np.maximum(context @ w["ctx1"].T + w["ctx1_bias"], 0) @ w["ctx2"].T + w["ctx2_bias"]
    fused = np.concatenate([home, away, _gru(home_seq, w), _gru(away_seq, w), mixed], axis=1)
    out = np.maximum(fused @ w["fuse1"].T + w["fuse1_bias"], 0) @ w["fuse2"].T + w["fuse2_bias"]
    rates = np.logaddexp(0, out[:, :2])
    return np.column_stack([rates, C.RHO_SCALE * np.tanh(out[:, 2])])


def net_batch_score(tensors: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(match_id, rates, rho, grid, 1X2, expected goals) of a trained network.

    ``tensors`` carry the teams' vectors; a team without one scores as the zero
    vector of the unknown team.  The width of the vectors is that of the weights.
    """
    width = (weights["fuse1"].shape[1] - 2 * C.GRU_HIDDEN - C.CONTEXT_OUT) // 2
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    fixed = {name: np.asarray(value, dtype="float64") for name, value in weights.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue

            def block(name: str, *shape: int) -> np.ndarray:
                return np.asarray(batch[name].flatten(), dtype="float64").reshape(n, *shape)

            steps = (-1, C.FORM_FEATURES)
            out = _forward(
                block("_home", -1), block("_away", -1), block("_home_steps", *steps),
                block("_away_steps", *steps), block("context", -1), fixed,
            )
            yield pa.RecordBatch.from_arrays(
                [batch["match_id"], *[pa.array(out[:, i]) for i in range(3)]],
                names=["match_id", "lambda_home", "lambda_away", "rho"],
            )

    rated = tensors.select(
        "match_id", F.flatten("home_seq").alias("_home_steps"),
        F.flatten("away_seq").alias("_away_steps"), "context",
        *[F.coalesce(f"{side}_vector", zero).alias(f"_{side}") for side in ("home", "away")],
    ).mapInArrow(score, "match_id bigint, lambda_home double, lambda_away double, rho double")
    return with_expected_goals(with_outcome_probs(with_score_grid(rated)))
