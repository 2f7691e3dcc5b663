"""Attack/defence rates by a generalised linear regression, then rho by a search of its own.

Without the low-score factors the likelihood is a weighted Poisson regression with one
coefficient for each attack, each defence and the home factor. Iteratively reweighted least
squares fits it on sparse one-hot sides of the reduced pairings. Given the rates, rho is the
one root of a falling slope.
"""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.models.goal_rates import _FACTORS, HELD, _first_teams, _with_rates
from matchlab.session import drop_durable, durable

#: Columns of one normal equation that the solver takes.
MOST_FEATURES = 4096
_POINTS = 33

_RHO_SLOPES = {"n00": "-lh * la", "n10": "la", "n01": "lh", "n11": "-1.0D"}


def _sides(stats: DataFrame) -> DataFrame:
    """(attacker, defender, lift, w, goals): the two sides of every pairing that has weight."""
    side = lambda a, d, lift, goals: F.struct(
        F.col(a).alias("attacker"), F.col(d).alias("defender"), lift.alias("lift"), F.col("w"), F.col(goals).alias("goals")
    )
    home = side("home_team", "away_team", F.when(F.col("neutral"), 0.0).otherwise(1.0), "w_home")
    away = side("away_team", "home_team", F.lit(0.0), "w_away")
    return stats.where("w > 0").select(F.inline(F.array(home, away)))


def _rho(rated: DataFrame) -> float:
    """The root of the slope in rho, or the bound it points to: each pass narrows the bracket 32 times.

    Searched where all low-score factors of seen scores are positive; there the slope falls.
    """
    least = "greatest(if(n10 > 0, -1 / la, -1D), if(n01 > 0, -1 / lh, -1D))"
    low, high = rated.agg(F.expr(f"max({least})"), F.expr("min(if(n00 > 0, 1 / (lh * la), 1D))")).first()
    low, high = max(-C.RHO_BOUND, low or -1.0), min(C.RHO_BOUND, high or 1.0)
    terms = [
        f"if(({f.replace('rho', 'r')}) > {C.LOG_FLOOR}D, {n} * ({_RHO_SLOPES[n]}) / ({f.replace('rho', 'r')}), 0D)"
        for n, f in _FACTORS.items()
    ]
    while high - low > 1e-10:
        points = [low + (high - low) * k / (_POINTS - 1) for k in range(_POINTS)]
        each = rated.select("*", F.posexplode(F.array(*map(F.lit, points))).alias("k", "r"))
        slopes = dict(each.groupBy("k").agg(F.sum(F.expr(" + ".join(terms)))).collect())
        falling = [k for k in range(_POINTS) if (slopes.get(k) or 0.0) <= 0]
        if not falling:
            return high
        if falling[0] == 0:
            return low if slopes.get(0) else 0.0
        low, high = points[falling[0] - 1], points[falling[0]]
    return (low + high) / 2


def fit(stats: DataFrame, tolerance: float = 1e-10, max_iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """(teams, scalars) like ``goal_rates.fit`` for one model, rho fitted after the rates.

    ``stats`` are the sums of ``goal_rates.sufficient_stats``. The first team of each group of
    teams linked by matches has log_alpha 0. A side that never scored, or never conceded, is
    held at ``HELD`` and its rows are left out. More than ``MOST_FEATURES`` coefficients are
    refused, and a fit that has not converged raises. No matches give no teams and zeros.
    """
    spark = stats.sparkSession
    stats = durable(stats)
    sides = _sides(stats)
    totals = lambda c: sides.groupBy(F.col(c).alias("team")).agg(F.sum("goals").alias("goals"))
    attack = totals("attacker").join(_first_teams(stats, []), "team")
    named = attack.select(F.concat(F.lit("a"), "team").alias("name"), (F.col("goals") > 0).alias("free"), (F.col("team") == F.col("first")).alias("reference"))
    named = durable(named.unionByName(totals("defender").select(F.concat(F.lit("d"), "team").alias("name"), (F.col("goals") > 0).alias("free"), F.lit(False).alias("reference"))))
    size = named.count() + 1
    if size > MOST_FEATURES:
        raise ValueError(f"{size} coefficients, but the solver takes {MOST_FEATURES}; use goal_rates.fit, which has no such limit")
    # At most MOST_FEATURES rows.
    place = durable(named.where("free and not reference").withColumn("at", F.row_number().over(Window.orderBy("name"))))
    width = place.count() + 1
    at = lambda kind, column: place.select(F.expr("substring(name, 2)").alias(column), F.col("at").alias(f"_{kind}")).where(F.col("name").startswith(kind))
    free = named.where("free").select("name")
    of = lambda kind, column: F.concat(F.lit(kind), F.col(column)) == F.col("name")
    rows = sides.join(free, of("a", "attacker"), "left_semi").join(free, of("d", "defender"), "left_semi")
    rows = rows.join(at("a", "attacker"), "attacker", "left").join(at("d", "defender"), "defender", "left")

    @F.udf(VectorUDT())
    def one_hot(lift, attacker, defender):
        entries = {0: lift} if lift else {}
        return SparseVector(width, entries | {int(i): 1.0 for i in (attacker, defender) if i is not None})

    value = {}
    rows = durable(rows.select(one_hot("lift", "_a", "_d").alias("features"), (F.col("goals") / F.col("w")).alias("label"), "w"))
    if not rows.isEmpty():
        model = GeneralizedLinearRegression(
            family="poisson", link="log", weightCol="w", fitIntercept=False, regParam=0.0, tol=tolerance, maxIter=max_iterations
        ).fit(rows)
        if model.summary.numIterations >= max_iterations:
            raise RuntimeError(f"not converged after {max_iterations} iterations")
        value = dict(enumerate(model.coefficients.toArray().tolist()))
    told = [(r["name"], value.get(r["at"], 0.0)) for r in place.select("name", "at").collect()]
    told = spark.createDataFrame(told, "name string, value double")
    fitted = named.join(F.broadcast(told), "name", "left").select(
        "name", F.when(F.col("free"), F.coalesce("value", F.lit(0.0))).otherwise(HELD).alias("value")
    )
    kind = F.substring("name", 1, 1)
    teams = durable(
        fitted.groupBy(F.expr("substring(name, 2)").alias("team")).agg(
            F.max(F.when(kind == "a", F.col("value"))).alias("log_alpha"), F.max(F.when(kind == "d", F.col("value"))).alias("log_beta")
        )
    )
    scalars = lambda rho: spark.createDataFrame([(value.get(0, 0.0), rho)], "log_gamma double, rho double")
    rated = _with_rates(stats, teams.withColumnsRenamed({"log_alpha": "attack", "log_beta": "defence"}), scalars(0.0), []).drop("rho")
    rated = durable(rated)
    rho = _rho(rated)
    for table in (stats, named, place, rows, rated):
        drop_durable(table)
    return teams, scalars(rho)
