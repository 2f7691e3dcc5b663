"""Attack/defence goal-rate model fitted on sufficient statistics.

The likelihood of a match depends only on (home, away, neutral) and on whether
the score is one of four low ones, so matches are reduced once, by a map-side
aggregate, to weighted counts per pairing.  The fit takes Newton steps, one aggregate
over that table each; teams and parameters stay in DataFrames, and all folds of a
back-test are fitted by the same jobs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.grid import with_outcome_probs, with_score_grid
from matchlab.operators.components import connected_components
from matchlab.operators.context import latest_date
from matchlab.session import drop_durable, durable

_LOW = {"n00": (0, 0), "n10": (1, 0), "n01": (0, 1), "n11": (1, 1)}
_SUMS = ("w", "w_home", "w_away", *_LOW)

#: Parameters of a model that one task solves for; larger models take conjugate gradients.
DENSE = 2048
#: Curvature, relative to a parameter's own, below which a direction is left where it is.
RIDGE = 1e-10
#: Share of the largest curvature below which a parameter does not delay the end of a fit.
NEGLIGIBLE = 1e-9
#: Log rate of a side without goals: so low that no other parameter gains by lowering it further.
HELD = -40.0


def sufficient_stats(
    matches: DataFrame,
    keys: tuple[str, ...] = (),
    weight: Column | None = None,
    per_day: float = C.DECAY_PER_DAY,
) -> DataFrame:
    """Weighted sums per (keys, home_team, away_team, neutral).

    Without ``weight`` a match counts exp(-per_day * days before the last match).
    """
    if weight is None:
        weight = F.exp(-per_day * F.datediff(latest_date(matches), F.col("match_date")))
    home, away = F.col("home_score"), F.col("away_score")
    rows = matches.withColumn("_w", weight)
    w = F.col("_w")
    low = [
        F.sum(F.when((home == h) & (away == a), w).otherwise(0.0)).alias(name)
        for name, (h, a) in _LOW.items()
    ]
    return rows.groupBy(*keys, "home_team", "away_team", "neutral").agg(
        F.sum(w).alias("w"), F.sum(w * home).alias("w_home"), F.sum(w * away).alias("w_away"),
        *low,
    )


def fold_stats(matches: DataFrame, folds: DataFrame, per_day: float = C.DECAY_PER_DAY) -> DataFrame:
    """Sufficient statistics of every fold's training window, weighted from its end.

    Matches are first reduced per period (the stretch a fold adds to the window
    of the fold before) and added up along the periods of a pairing, so a fold
    costs one row per pairing it has seen.
    """
    from matchlab.operators.folds import training_period

    ends = folds.select(F.col("fold_idx").alias("period"), F.col("train_end").alias("period_end"))
    span = folds.agg(F.max("train_end").alias("end"), F.max("fold_idx").alias("n")).first()
    end, last = F.lit(span["end"]), F.lit(span["n"])
    rows = training_period(matches, folds).join(F.broadcast(ends), "period")
    age = F.datediff("period_end", "match_date")
    stats = sufficient_stats(rows, ("period", "period_end"), F.exp(-per_day * age))
    # Sums up to a period, all weighted from the last day, hold until the pairing's next period.
    pairing = Window.partitionBy("home_team", "away_team", "neutral").orderBy("period")
    upto = pairing.rowsBetween(Window.unboundedPreceding, 0)
    fade = F.exp(-per_day * F.datediff(end, "period_end"))
    until = F.coalesce(F.lead("period").over(pairing) - 1, last)
    running = stats.select(
        "home_team", "away_team", "neutral", F.col("period"), until.alias("_until"),
        *[F.sum(F.col(c) * fade).over(upto).alias(c) for c in _SUMS],
    )
    spread = running.withColumn("fold_idx", F.explode(F.sequence("period", "_until"))).join(
        F.broadcast(folds.select("fold_idx", "train_end")), "fold_idx"
    )
    lift = F.exp(per_day * F.datediff(end, "train_end"))
    return spread.select(
        "fold_idx", "home_team", "away_team", "neutral", *[(F.col(c) * lift).alias(c) for c in _SUMS]
    )


def _with_rates(
    stats: DataFrame, teams: DataFrame, scalars: DataFrame, by: list[str], how: str = "inner"
) -> DataFrame:
    out = stats
    for side in ("home", "away"):
        lookup = teams.select(
            *by, F.col("team").alias(f"{side}_team"),
            F.col("attack").alias(f"_a_{side}"), F.col("defence").alias(f"_d_{side}"),
        )
        out = out.join(lookup, [*by, f"{side}_team"], how)
    if by:
        # One row per model: bounded by the number of folds.
        out = out.join(F.broadcast(scalars), by)
    else:
        out = out.withColumns(
            {c: scalars.select(c).scalar() for c in ("log_gamma", "rho")}
        )
    lift = F.when(F.col("neutral"), 0.0).otherwise(F.col("log_gamma"))
    return out.withColumns(
        {
            "lh": F.exp(F.col("_a_home") + F.col("_d_away") + lift),
            "la": F.exp(F.col("_a_away") + F.col("_d_home")),
        }
    )


def _factors() -> dict[str, Column]:
    """Low-score factors; one at the floor no longer reacts to the parameters."""
    lh, la, rho = F.col("lh"), F.col("la"), F.col("rho")
    return {"n00": 1 - lh * la * rho, "n10": 1 + la * rho, "n01": 1 + lh * rho, "n11": 1 - rho}


def log_likelihood(rated: DataFrame) -> Column:
    """Weighted log-likelihood up to the factorial terms, which no parameter moves."""
    lh, la = F.col("lh"), F.col("la")
    total = F.col("w_home") * F.log(lh) - F.col("w") * lh + F.col("w_away") * F.log(la) - F.col("w") * la
    for name, factor in _factors().items():
        total = total + F.col(name) * F.log(F.greatest(factor, F.lit(C.LOG_FLOOR)))
    return total


# A pairing's terms as SQL text: built once, analysed quickly in every round.
_FACTORS = {"n00": "1 - lh * la * rho", "n10": "1 + la * rho", "n01": "1 + lh * rho", "n11": "1 - rho"}
# First and second derivatives of each low-score factor in (log lh, log la, rho).
_FIRST = {
    "n00": ("-lh * la * rho", "-lh * la * rho", "-lh * la"), "n10": ("0", "la * rho", "la"),
    "n01": ("lh * rho", "0", "lh"), "n11": ("0", "0", "-1"),
}
_SECOND = {
    "n00": {(0, 0): "-lh * la * rho", (1, 1): "-lh * la * rho", (0, 1): "-lh * la * rho", (0, 2): "-lh * la", (1, 2): "-lh * la"},
    "n10": {(1, 1): "la * rho", (1, 2): "la"}, "n01": {(0, 0): "lh * rho", (0, 2): "lh"}, "n11": {},
}
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _live_terms() -> list[str]:
    """Each factor, and its weighted count divided by it; a factor at the floor no longer reacts."""
    return [f"{f} as f_{n}" for n, f in _FACTORS.items()] + [f"if({f} > {C.LOG_FLOOR}D, {n} / ({f}), 0D) as t_{n}" for n, f in _FACTORS.items()]


def _sums() -> dict[str, str]:
    """Log-likelihood, slopes and negative curvatures of a pairing."""
    out = {
        "ll": "w_home * ln(lh) - w * lh + w_away * ln(la) - w * la"
        + "".join(f" + {n} * ln(greatest(f_{n}, {C.LOG_FLOOR}D))" for n in _FACTORS)
    }
    plain = ("w_home - w * lh", "w_away - w * la", "0D")
    for i in range(3):
        out[f"s{i}"] = plain[i] + "".join(f" + t_{n} * ({_FIRST[n][i]})" for n in _FACTORS if _FIRST[n][i] != "0")
    bent = {(0, 0): "w * lh", (1, 1): "w * la"}
    for i, j in _PAIRS:
        terms = bent.get((i, j), "0D")
        for n in _FACTORS:
            if "0" not in (_FIRST[n][i], _FIRST[n][j]):
                terms += f" + t_{n} * ({_FIRST[n][i]}) * ({_FIRST[n][j]}) / if(f_{n} > {C.LOG_FLOOR}D, f_{n}, 1D)"
            if (i, j) in _SECOND[n]:
                terms += f" - t_{n} * ({_SECOND[n][i, j]})"
        out[f"c{i}{j}"] = terms
    return out


def _entries() -> str:
    """All sums by the parameters they belong to; a parameter is named by a letter and its team."""
    owners = [
        ("concat('a', home_team)", 0), ("concat('d', away_team)", 0), ("if(neutral, null, 'gamma')", 0),
        ("concat('a', away_team)", 1), ("concat('d', home_team)", 1), ("'rho'", 2),
    ]
    rows = [("''", "''", "ll")] + [(p, "''", f"s{i}") for p, i in owners]
    for x, (p, i) in enumerate(owners):
        for q, j in owners[x:]:
            value = f"c{min(i, j)}{max(i, j)}"
            rows.append((f"least({p}, {q})", f"if({p} is null or {q} is null, null, greatest({p}, {q}))", value))
    structs = (f"named_struct('i', {i}, 'j', {j}, 'value', {v})" for i, j, v in rows)
    return f"inline(array({', '.join(structs)}))"


def _moments(rated: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, value): summed log-likelihood (i and j empty), slopes (j empty) and negative curvatures.

    Curvatures are told once for i <= j.
    """
    keys = [*by, "home_team", "away_team", "neutral"]
    # A generator of one row keeps the terms from being copied into every sum that uses them.
    once = lambda values: f"inline(array(struct({', '.join(values)})))"
    sums = _sums()
    rows = rated.selectExpr(*keys, *_SUMS, "lh", "la", "rho", once(_live_terms()))
    rows = rows.selectExpr(*keys, once([f"{v} as {k}" for k, v in sums.items()])).selectExpr(*by, _entries())
    return rows.where("i is not null and j is not null").groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


def _start(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, value): every parameter of every model; all pairings start at the mean goal rate.

    A side without any goal has no finite optimum. Its parameter is held at the floor (``held``).
    """
    sides = F.explode(
        F.array(
            *[
                F.struct(F.concat(F.lit(kind), F.col(f"{side}_team")).alias("i"), F.col(goals).alias("goals"))
                for kind, side, goals in (("a", "home", "w_home"), ("a", "away", "w_away"), ("d", "home", "w_away"), ("d", "away", "w_home"))
            ]
        )
    )
    teams = stats.select(*by, sides.alias("s")).groupBy(*by, F.col("s.i").alias("i")).agg((F.sum("s.goals") <= 0).alias("held"))
    mean = F.sum(F.col("w_home") + F.col("w_away")) / (2 * F.sum("w"))
    means = stats.groupBy(*by).agg(F.log(F.greatest(mean, F.lit(0.1))).alias("mean"))
    if by:
        teams = teams.join(F.broadcast(means), by)
    else:
        teams = teams.withColumn("mean", means.scalar())
    value = F.when(F.col("held"), HELD).when(F.col("i").startswith("d"), F.col("mean")).otherwise(0.0)
    teams = teams.select(*by, "i", value.alias("value"), "held")
    scalars = means.select(*by, F.explode(F.array(F.lit("gamma"), F.lit("rho"))).alias("i"), F.lit(0.0).alias("value"), F.lit(False).alias("held"))
    return teams.unionByName(scalars)


def _parts(state: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(teams with attack and defence, scalars) of a state."""
    of = lambda name: F.max(F.when(F.col("i") == name, F.col("value")))
    kind, team = F.substring("i", 1, 1), F.expr("substring(i, 2)")
    single = F.col("i").isin("gamma", "rho")
    teams = state.where(~single).groupBy(*by, team.alias("team")).agg(
        F.max(F.when(kind == "a", F.col("value"))).alias("attack"), F.max(F.when(kind == "d", F.col("value"))).alias("defence")
    )
    scalars = state.where(single).groupBy(*by).agg(of("gamma").alias("log_gamma"), of("rho").alias("rho"))
    return teams, scalars


#: What a round leaves to the next beside the values: the point and step they come from, how
#: far a step may go, the likelihood at that point.
_CONTROL = "base double, step double, radius double, best double"


def _dense_steps(moments: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """``state`` with Newton steps (``fresh``), one model a task, for models of at most ``DENSE`` parameters."""
    kinds = [f"{c} {state.schema[c].dataType.simpleString()}" for c in by]
    schema = ", ".join([*kinds, f"i string, value double, held boolean, {_CONTROL}, first string, fresh double, c double, reached double"])

    def solve(sums: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop(columns=["move", "first", "_model"], errors="ignore")
        names = pd.Index(own["i"])
        rows, cols, value = names.get_indexer(sums["i"]), names.get_indexer(sums["j"]), sums["value"].to_numpy()
        slope, curve = np.zeros(len(names)), np.zeros((len(names), len(names)))
        first = (rows >= 0) & (sums["j"] == "").to_numpy()
        slope[rows[first]] = value[first]
        both = (rows >= 0) & (cols >= 0)
        curve[rows[both], cols[both]] = curve[cols[both], rows[both]] = value[both]
        at = own["value"].to_numpy()
        at_edge = (names == "rho") & (np.abs(at) >= C.RHO_BOUND) & (at * slope > 0)
        weight = np.where(own["held"].to_numpy(), 0.0, np.diag(curve))
        live = (weight > 0) & ~at_edge
        step = np.zeros(len(names))
        if live.any():
            scale = 1 / np.sqrt(weight[live])
            scaled = curve[np.ix_(live, live)] * scale * scale[:, None]
            # The common shift of attack against defence has no curvature; directions below RIDGE stay where they are.
            ridge = RIDGE
            while True:
                try:
                    low = np.linalg.cholesky(scaled + ridge * np.eye(len(scaled)))
                    break
                except np.linalg.LinAlgError:
                    ridge *= 100
            step[live] = scale * np.linalg.solve(low.T, np.linalg.solve(low, scale * slope[live]))
        reached = value[(sums["i"] == "").to_numpy()].sum()
        # The first team of all that are linked by matches.
        teams, rank = np.unique(names.str[1:], return_inverse=True)
        linked = (curve != 0) & ~names.isin(["gamma", "rho"])[:, None] & ~names.isin(["gamma", "rho"])
        while True:
            least = np.minimum(rank, np.where(linked, rank, len(teams)).min(axis=1))
            if (least == rank).all():
                break
            rank = least
        return own.assign(fresh=step, c=weight, reached=reached, first=teams[rank])

    if not by:
        moments, state = (df.withColumn("_model", F.lit(0)) for df in (moments, state))
    keyed = by or ["_model"]
    return moments.groupBy(*keyed).cogroup(state.groupBy(*keyed)).applyInPandas(solve, schema)


def _in_each(table: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """``table`` with aggregates of each model in every row."""
    totals = [c.alias(k) for k, c in sums.items()]
    if by:
        return table.join(F.broadcast(table.groupBy(*by).agg(*totals)), by)  # one row a model
    one = table.agg(*totals)
    return table.withColumns({k: one.select(k).scalar() for k in sums})


def _conjugate_steps(moments: DataFrame, state: DataFrame, by: list[str], most: int = 200, enough: float = 1e-4) -> DataFrame:
    """``state`` with Newton steps (``fresh``) by conjugate gradients over the table of curvatures.

    Needs no model to fit into a task: a join and an aggregate each, to a relative residual of ``enough``.
    """
    keys = [*by, "i"]
    moments = durable(moments)
    slopes = moments.where("i <> '' and j = ''").select(*keys, F.col("value").alias("slope"))
    off = moments.where("j <> ''")
    diagonal = off.where("i = j and value > 0").select(*keys, F.col("value").alias("c"))
    outward = (F.col("i") == "rho") & (F.abs("value") >= C.RHO_BOUND) & (F.col("value") * F.col("slope") > 0)
    live = state.where("not held").join(slopes, keys).join(diagonal, keys).where(~outward)
    scaled = live.select(*keys, F.sqrt("c").alias("c"), (F.col("slope") / F.sqrt("c")).alias("r"))
    vectors = durable(scaled.select(*keys, "c", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    side = lambda n: vectors.select(*by, F.col("i").alias(n), F.col("c").alias(f"_{n}"))
    matrix = off.where("i <> j").join(side("i"), keys).join(side("j"), [*by, "j"])
    matrix = matrix.select(*keys, "j", (F.col("value") / (F.col("_i") * F.col("_j"))).alias("h"))
    matrix = durable(matrix.unionByName(matrix.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "h")))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    total = vectors.agg(square("r")).first()[0] or 0.0
    for _ in range(most):
        ahead = vectors.select(*by, F.col("i").alias("j"), F.col("p").alias("_p"))
        pulled = matrix.join(ahead, [*by, "j"]).groupBy(*keys).agg(F.sum(F.col("h") * F.col("_p")).alias("_q"))
        rows = vectors.join(pulled, keys, "left").withColumn("q", F.coalesce("_q", F.lit(0.0)) + (1 + RIDGE) * F.col("p"))
        rows = _in_each(rows, by, _rr=square("r"), _pq=F.sum(F.col("p") * F.col("q")))
        ahead_by = F.when(F.col("_pq") > 0, F.col("_rr") / F.col("_pq")).otherwise(0.0)
        rows = rows.withColumns({"x": F.col("x") + ahead_by * F.col("p"), "r": F.col("r") - ahead_by * F.col("q")})
        rows = _in_each(rows, by, _new=square("r"))
        turn = F.when(F.col("_rr") > 0, F.col("_new") / F.col("_rr")).otherwise(0.0)
        before, vectors = vectors, durable(rows.select(*keys, "c", "x", "r", (F.col("r") + turn * F.col("p")).alias("p")))
        drop_durable(before)
        if (vectors.agg(square("r")).first()[0] or 0.0) <= enough**2 * total:
            break
    drop_durable(matrix)
    steps = vectors.select(*keys, (F.col("x") / F.col("c")).alias("fresh"), (F.col("c") * F.col("c")).alias("c"))
    rows = state.drop("move").join(steps, keys, "left").fillna(0.0, ["fresh", "c"])
    told = moments.where("i = ''").select(*by, F.col("value").alias("reached"))
    return rows.join(F.broadcast(told), by) if by else rows.withColumn("reached", told.select("reached").scalar())


def _moved(rows: DataFrame, by: list[str]) -> DataFrame:
    """The state after a round.

    Where the likelihood fell, the last step was too long: a quarter of it is taken from the
    point it started at. Else the round's own step is, within a radius that grows again; all
    parameters of a model move in proportion. ``move`` is the whole step of a parameter that
    carries weight, else 0.
    """
    rows = _in_each(rows, by, most=F.max("c"), long_old=F.max(F.abs("step")), long_new=F.max(F.abs("fresh")))
    worse = F.col("reached") < F.col("best") - 1e-10 * F.abs("best")
    pick = lambda old, new: F.when(worse, old).otherwise(new)
    rows = rows.withColumns(
        {
            "base": pick(F.col("base"), F.col("value")), "step": pick(F.col("step"), F.col("fresh")),
            "longest": pick(F.col("long_old"), F.col("long_new")), "best": pick(F.col("best"), F.col("reached")),
            "radius": pick(F.least("radius", "long_old") / 4, F.least(F.lit(2.0), 2 * F.col("radius"))),
        }
    )
    moved = F.col("base") + F.col("step") * F.least(F.lit(1.0), F.col("radius") / F.greatest("longest", F.lit(1e-300)))
    bounded = F.greatest(F.lit(-C.RHO_BOUND), F.least(F.lit(C.RHO_BOUND), moved))
    weighty = F.col("c") > NEGLIGIBLE * F.col("most")
    return rows.select(
        *by, "i", F.when(F.col("i") == "rho", bounded).otherwise(moved).alias("value"), "held", "base", "step", "radius", "best", "first",
        F.when(weighty, F.abs("step")).otherwise(0.0).alias("move"),
    )


def _first_teams(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, team, first): the first in alphabetical order of the teams that matches link to ``team``."""
    own = lambda side: F.concat_ws("\0", *[F.col(c).cast("string") for c in by], f"{side}_team")
    linked = connected_components(stats.select(own("home").alias("a"), own("away").alias("b")), "a", "b")
    name = lambda c: F.element_at(F.split(c, "\0"), -1)
    keys = [F.split("node", "\0")[at].cast(stats.schema[c].dataType).alias(c) for at, c in enumerate(by)]
    return linked.select(*keys, name("node").alias("team"), name("component").alias("first"))


def fit(
    stats: DataFrame, by: tuple[str, ...] = (), max_sweeps: int = 60, tolerance: float = 1e-5, dense: int = DENSE
) -> tuple[DataFrame, DataFrame]:
    """Maximum-likelihood (teams, scalars) of every model named by ``by``.

    teams: by, team, log_alpha, log_beta, with log_alpha 0 for the first team in alphabetical
    order; of several groups of teams that never met, for the first of each, since no match
    tells how they compare. scalars: by, log_gamma, rho. Newton's method: one aggregate over the
    pairings gives slopes and curvatures of all parameters of all models, then each model's
    step is solved for and shortened where the likelihood falls, in a task where no model has more than ``dense`` parameters, else by
    conjugate gradients over the table of curvatures. Ends after a step that moves no
    parameter that carries weight by more than ``tolerance``; the error left is of its
    square. Raises when ``max_sweeps`` are not enough.

    Parameters with less than ``NEGLIGIBLE`` of the largest weight (teams idle for decades) move
    along but do not delay the end; what no match of weight tells keeps the start, the mean
    rate. A side that never scored, or never conceded, has no finite optimum and is held at
    ``HELD``. No matches give no rows.
    """
    by = list(by)
    stats = durable(stats)
    none = F.lit(None)
    unset = {"base": F.col("value"), "step": F.lit(0.0), "radius": F.lit(1.0), "best": none.cast("double"), "first": none.cast("string")}
    state = durable(_start(stats, by).withColumns(unset | {"move": F.lit(0.0)}))
    most = state.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    worst = 0.0
    for _ in range(max_sweeps if most else 0):
        moments = _moments(_with_rates(stats, *_parts(state, by), by), by)
        rows = _dense_steps(moments, state, by) if most <= dense else _conjugate_steps(moments, state, by)
        before, state = state, durable(_moved(rows, by))
        drop_durable(before)
        worst = state.agg(F.max("move")).first()[0]
        if worst <= tolerance:
            break
    else:
        if most:
            raise RuntimeError(f"not converged after {max_sweeps} steps: the last moved a parameter by {worst:.2g}")
    teams, scalars = _parts(state, by)
    if most <= dense:
        firsts = state.where("i like 'a%'").select(*by, F.expr("substring(i, 2)").alias("team"), "first")
    else:
        firsts = _first_teams(stats, by)
    teams = teams.join(firsts, [*by, "team"])
    reference = teams.where("team = first").select(*by, "first", F.col("attack").alias("_ref"))
    teams = teams.join(reference, [*by, "first"]).select(
        *by, "team", (F.col("attack") - F.col("_ref")).alias("log_alpha"),
        (F.col("defence") + F.col("_ref")).alias("log_beta"),
    )
    out = durable(teams)
    drop_durable(stats)
    return out, scalars


def predict_rates(
    matches: DataFrame, teams: DataFrame, scalars: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add lambda_home, lambda_away, rho and ``unseen``, the teams without parameters.

    A match of such a team stays, without rates.
    """
    fitted = teams.withColumnsRenamed({"log_alpha": "attack", "log_beta": "defence"})
    rated = _with_rates(matches, fitted, scalars, list(by), "left")
    unseen = [F.when(F.col(f"_a_{side}").isNull(), F.col(f"{side}_team")) for side in ("home", "away")]
    return rated.select(
        *matches.columns, F.col("lh").alias("lambda_home"), F.col("la").alias("lambda_away"), "rho",
        F.array_compact(F.array(*unseen)).alias("unseen"),
    )


def predict(
    matches: DataFrame, teams: DataFrame, scalars: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """Rates, score grid and 1X2 probabilities."""
    return with_outcome_probs(with_score_grid(predict_rates(matches, teams, scalars, by)))
