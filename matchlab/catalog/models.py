"""Goal-rate, tree and network model queries, and whole back-tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.catalog.contexts import MAJOR
from matchlab.catalog.evaluation import FOLDS, ROI, folds, rounded
from matchlab.catalog.grids import CELLS, MARKETS
from matchlab.catalog.prices import BETS, CHAIN, LISTED, ODDS, listed, signal_tables
from matchlab.catalog.registry import query
from matchlab.catalog.timelines import ELO, HISTORY, LONG
from matchlab.catalog.views import table, twin, view
from matchlab.functions import text as X
from matchlab.models import goal_rates as G
from matchlab.models import poisson_glm as L
from matchlab.models import score_net as N
from matchlab.models import trees as T
from matchlab.operators import context as K
from matchlab.plans import pipelines as P

LOW = ", ".join(
    f"round(sum(case when home_score = {h} and away_score = {a} then w else 0 end), 6) as n{h}{a}"
    for h, a in ((0, 0), (1, 0), (0, 1), (1, 1))
)


@query(
    "dc_sufficient_stats",
    twin("tb_matches", f"""
    weighted as (select *, exp(-0.0065 * ((select max(match_date) from tb_matches) - match_date)) as w
      from tb_matches)
    select home_team, away_team, neutral, round(sum(w), 6) as w, round(sum(w * home_score), 6) as w_home,
      round(sum(w * away_score), 6) as w_away, {LOW} from weighted group by 1, 2, 3"""),
)
def dc_sufficient_stats(spark, sf):
    df = G.sufficient_stats(view(spark, sf, "tb_matches"))
    sums = ["w", "w_home", "w_away", "n00", "n10", "n01", "n11"]
    return df.select("home_team", "away_team", "neutral", *[F.round(c, 6).alias(c) for c in sums])


@query(
    "dc_fold_stats",
    twin("tb_matches", FOLDS + f""",
    weighted as (select *, exp(-0.0065 * (train_end - match_date)) as w
      from tb_matches join folds on match_date < train_end)
    select fold_idx, home_team, away_team, neutral, round(sum(w), 6) as w, round(sum(w * home_score), 6) as w_home,
      round(sum(w * away_score), 6) as w_away, {LOW} from weighted group by 1, 2, 3, 4"""),
)
def dc_fold_stats(spark, sf):
    df = G.fold_stats(view(spark, sf, "tb_matches"), folds(spark, sf))
    sums = ["w", "w_home", "w_away", "n00", "n10", "n01", "n11"]
    return df.select("fold_idx", "home_team", "away_team", "neutral", *[F.round(c, 6).alias(c) for c in sums])


LOW_SUMS = ", ".join(
    f"sum(case when home_score = {h} and away_score = {a} then w else 0 end) as n{h}{a}"
    for h, a in ((0, 0), (1, 0), (0, 1), (1, 1))
)
# The fit by recursion over half sweeps, all parameters of a model in two lists and two numbers.
# It starts from ``stats`` (fold_idx, pairing, sums); entries -1 and -2 are the scalars.
FIT = """
sides as (select fold_idx, home_team as team from stats union select fold_idx, away_team from stats),
idx as (select *, cast(row_number() over (partition by fold_idx order by team) as int) as i from sides),
met as (select s.*, x.i as h, y.i as a from stats s join idx x on x.fold_idx = s.fold_idx and x.team = home_team
  join idx y on y.fold_idx = s.fold_idx and y.team = away_team),
begun as (select fold_idx, (select count(*) from idx where idx.fold_idx = stats.fold_idx) as n,
    ln(greatest(sum(w_home + w_away) / (2 * sum(w)), 0.1)) as mean from stats group by fold_idx),
fit as (
  select fold_idx, 0 as half, list_transform(range(n), lambda x: 0.0::double) as att,
    list_transform(range(n), lambda x: mean::double) as def, 0.0::double as gamma, 0.0::double as rho, 1e9::double as worst
  from begun
  union all
  select fold_idx, half + 1, case when half % 2 = 0 then vals else att end, case when half % 2 = 1 then vals else def end,
    gamma + coalesce(up_gamma, 0), coalesce(new_rho, rho), case when half % 2 = 0 then gap else greatest(worst, gap) end
  from (
    select fold_idx, half, att, def, gamma, rho, worst,
      list(case when half % 2 = 0 then att[t] else def[t] end + step order by t) filter (t > 0) as vals,
      max(step) filter (t = -1) as up_gamma,
      max(greatest(-0.99, least(0.99, rho + 0.7 * newton))) filter (t = -2) as new_rho, max(gap) as gap
    from (
      select *, case when c > 0 then ln(1 + greatest(s / greatest(c, 1e-12), -0.9)) else 0 end as step,
        case when c > 0 then s / c else 0 end as newton,
        case when c > 0 and s + c > 1e-6 * c then abs(s) / c else 0 end as gap
      from (
        select fold_idx, half, att, def, gamma, rho, worst, e.t as t, sum(e.s) as s, sum(e.c) as c
        from (
          select fold_idx, half, att, def, gamma, rho, worst, unnest(case when half % 2 = 0
            then [{t: h, s: sh, c: w * lh}, {t: a, s: sa, c: w * la}]
            else [{t: a, s: sh, c: w * lh}, {t: h, s: sa, c: w * la},
              {t: -1, s: case when neutral then 0 else sh end, c: case when neutral then 0 else w * lh end},
              {t: -2, s: t00 * (-lh * la) + t10 * la + t01 * lh - t11,
                c: t00 * lh * la * lh * la / f00 + t10 * la * la / f10 + t01 * lh * lh / f01 + t11 / f11}] end) as e
          from (
            select *, w_home - w * lh - t00 * lh * la * rho + t01 * lh * rho as sh,
              w_away - w * la - t00 * lh * la * rho + t10 * la * rho as sa
            from (
              select *, case when f00 > 1e-10 then n00 / f00 else 0 end as t00,
                case when f10 > 1e-10 then n10 / f10 else 0 end as t10,
                case when f01 > 1e-10 then n01 / f01 else 0 end as t01,
                case when f11 > 1e-10 then n11 / f11 else 0 end as t11
              from (
                select *, 1 - lh * la * rho as f00, 1 + la * rho as f10, 1 + lh * rho as f01, 1 - rho as f11
                from (
                  select r.fold_idx, half, att, def, gamma, rho, worst, h, a, neutral, w, w_home, w_away, n00, n10, n01, n11,
                    exp(att[h] + def[a] + case when neutral then 0 else gamma end) as lh, exp(att[a] + def[h]) as la
                  from (select *, max(worst) over () as still from fit) r join met m on m.fold_idx = r.fold_idx
                  where half % 2 = 1 or still >= 1e-9)))))
        group by fold_idx, half, att, def, gamma, rho, worst, e.t))
    group by fold_idx, half, att, def, gamma, rho, worst)),
fitted as (select * from fit qualify half = max(half) over ())
"""
RATED = """
rates as (select match_id, exp(att[x.i] + def[y.i] + case when neutral then 0 else gamma end) as lambda_home,
  exp(att[y.i] + def[x.i]) as lambda_away, rho
  from asked q join fitted using (fold_idx) join idx x on x.fold_idx = q.fold_idx and x.team = home_team
  join idx y on y.fold_idx = q.fold_idx and y.team = away_team)
"""
# Teams of different pools never meet; the first of each pool has attack 0.
PARAMETERS = """
  team, round(att[i] - att[one], 6) as log_alpha, round(def[i] + att[one], 6) as log_beta, round(gamma, 6) as log_gamma,
  round(rho, 6) as rho from fitted join (select *, first_value(i) over (
    partition by fold_idx, cast(substring(team, 2) as int) % 8 order by team) as one from idx) using (fold_idx)
"""


def stats_sql(rows: str, end: str, fold: str = "0") -> str:
    """Unrounded sums of the rows of a from clause, weighted from the day ``end``."""
    return f"""
    weighted as (select *, {fold} as fold, exp(-0.0065 * ({end} - match_date)) as w from {rows}),
    stats as (select fold as fold_idx, home_team, away_team, neutral, sum(w) as w, sum(w * home_score) as w_home,
      sum(w * away_score) as w_away, {LOW_SUMS} from weighted group by 1, 2, 3, 4),
    """


STATS = stats_sql("tb_matches", "(select max(match_date) from tb_matches)")
FOLD_STATS = FOLDS + "," + stats_sql("tb_matches join folds on match_date < train_end", "train_end", "fold_idx")


@query("dc_fit", twin("tb_matches", STATS + FIT + "select" + PARAMETERS, True))
def dc_fit(spark, sf):
    teams, scalars = G.fit(G.sufficient_stats(view(spark, sf, "tb_matches")))
    df = teams.withColumns({c: scalars.select(c).scalar() for c in ("log_gamma", "rho")})
    return df.select("team", *[F.round(c, 6).alias(c) for c in ("log_alpha", "log_beta", "log_gamma", "rho")])


@query("dc_fit_folds", twin("tb_matches", FOLD_STATS + FIT + "select fold_idx," + PARAMETERS, True))
def dc_fit_folds(spark, sf):
    stats = G.fold_stats(view(spark, sf, "tb_matches"), folds(spark, sf))
    teams, scalars = G.fit(stats, by=("fold_idx",))
    df = teams.join(F.broadcast(scalars), "fold_idx")
    names = ("log_alpha", "log_beta", "log_gamma", "rho")
    return df.select("fold_idx", "team", *[F.round(c, 6).alias(c) for c in names])


# Rates without the low scores, then the root of the slope in rho.
GLM = STATS.replace("stats as (", "whole as (") + """
stats as (select * replace (0.0::double as n00, 0.0::double as n10, 0.0::double as n01, 0.0::double as n11) from whole),
""" + FIT + """,
placed as (select s.*, exp(att[x.i] + def[y.i] + case when neutral then 0 else gamma end) as lh, exp(att[y.i] + def[x.i]) as la
  from whole s join fitted using (fold_idx) join idx x on x.fold_idx = s.fold_idx and x.team = home_team
  join idx y on y.fold_idx = s.fold_idx and y.team = away_team),
search as (
  select 0 as step, 0.0::double as low_rho
  union all
  select step + 1, greatest(-0.99, least(0.99, low_rho + sum(g) / sum(g2))) from (
    select step, low_rho, -n00 * lh * la / f00 + n10 * la / f10 + n01 * lh / f01 - n11 / f11 as g,
      n00 * lh * la * lh * la / (f00 * f00) + n10 * la * la / (f10 * f10) + n01 * lh * lh / (f01 * f01) + n11 / (f11 * f11) as g2
    from (select *, 1 - lh * la * low_rho as f00, 1 + la * low_rho as f10, 1 + lh * low_rho as f01, 1 - low_rho as f11
      from search, placed where step < 30))
  group by step, low_rho)
"""


@query(
    "poisson_glm_fit",
    twin("tb_matches", GLM + "select" + PARAMETERS.replace("round(rho, 6)", "(select round(low_rho, 6) from search where step = 30)"), True),
)
def poisson_glm_fit(spark, sf):
    teams, scalars = L.fit(G.sufficient_stats(view(spark, sf, "tb_matches")))
    df = teams.join(F.broadcast(scalars))
    return df.select("team", *[F.round(c, 6).alias(c) for c in ("log_alpha", "log_beta", "log_gamma", "rho")])


# Given parameters instead of fitted ones, so that the prediction has a twin.
GIVEN = """
params as (select concat('T', cast(c_custkey as varchar(10))) as team, (c_custkey % 9 - 4) / 20.0 as log_alpha,
  (c_custkey % 7 - 3) / 20.0 as log_beta from customer),
rates as (select match_id, exp(h.log_alpha + a.log_beta + case when neutral then 0 else 0.25 end) as lambda_home,
  exp(a.log_alpha + h.log_beta) as lambda_away, -0.05::double as rho
  from tb_matches join params h on h.team = home_team join params a on a.team = away_team)
"""


@query(
    "dc_predict",
    twin("tb_matches tb_params", GIVEN + "," + (CELLS + MARKETS).replace("tb_params p", "rates p") + """
    select match_id, round(lambda_home, 6) as lambda_home, round(lambda_away, 6) as lambda_away,
      round(home_win, 6) as prob_home, round(draw, 6) as prob_draw, round(away_win, 6) as prob_away
    from rates join markets using (match_id)"""),
)
def dc_predict(spark, sf):
    key = F.col("c_custkey")
    teams = table(spark, sf, "customer").select(
        F.concat(F.lit("T"), key.cast("string")).alias("team"),
        ((key % 9 - 4) / 20.0).alias("log_alpha"), ((key % 7 - 3) / 20.0).alias("log_beta"),
    )
    scalars = spark.createDataFrame([(0.25, -0.05)], "log_gamma double, rho double")
    df = G.predict(view(spark, sf, "tb_matches"), teams, scalars)
    names = ["lambda_home", "lambda_away", "prob_home", "prob_draw", "prob_away"]
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in names])


def contextual(spark, sf, **extra):
    """Matches with rest days, flags and weights (ratings as given by the view)."""
    return K.derive_context(view(spark, sf, "tb_matches"), **extra)


FEATURES = LONG + HISTORY.format(n=5) + f"""
agg as (select team, match_date, avg(gf) gf, avg(ga) ga, avg(pts) pts, avg(opp) opp, count(*) n
  from hist group by team, match_date),
gaps as (select n.team, n.match_id,
    cast(n.match_date - lag(n.match_date) over (partition by n.team order by n.rn) as double) as rest from num n),
features as (select m.match_id, elo_home_pre, elo_away_pre, elo_home_pre - elo_away_pre as elo_diff,
    least(coalesce(g.rest, 365), 365) as rest_days_home, least(coalesce(r.rest, 365), 365) as rest_days_away,
    case when neutral then 1.0 else 0.0 end as neutral, case when tournament in {MAJOR} then 1.0 else 0.0 end as is_knockout,
    0.0 as is_host_home, 0.0 as is_host_away, {", ".join(
      f"coalesce({s[0]}.{c}, 0) as form_{name}_{s}" for s in ("home", "away")
      for c, name in (("gf", "gf"), ("ga", "ga"), ("pts", "pts"), ("opp", "opp_elo"), ("n", "n_played")))}
  from tb_matches m join gaps g on g.match_id = m.match_id and g.team = home_team
  join gaps r on r.match_id = m.match_id and r.team = away_team
  left join agg h on h.team = home_team and h.match_date = m.match_date
  left join agg a on a.team = away_team and a.match_date = m.match_date)
"""


@query(
    "feature_matrix",
    twin("tb_matches", FEATURES + "select match_id, " + ", ".join(
        f"round({c}, 6)::double as {c}" for c in T.FEATURES) + " from features"),
)
def feature_matrix(spark, sf):
    df = T.feature_matrix(contextual(spark, sf, form=C.AGGREGATE_LENGTH))
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in T.FEATURES])


@query(
    "column_means",
    twin("tb_matches", FEATURES + "select " + ", ".join(
        f"round(avg({c}), 6)::double as {c}" for c in T.FEATURES) + " from features"),
)
def column_means(spark, sf):
    df = T.column_means(T.feature_matrix(contextual(spark, sf, form=C.AGGREGATE_LENGTH)))
    return df.select(*[F.round(c, 6).alias(c) for c in T.FEATURES])


def tree_model(spark, sf):
    """The fitted ensembles and their validation rows."""
    train, val = K.train_val_split(contextual(spark, sf, form=C.AGGREGATE_LENGTH))
    return T.fit(train), val


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Importance of every feature in both fitted regressions."""
    model, _ = tree_model(spark, sf)
    rows = [
        (name, float(h), float(a))
        for name, h, a in zip(
            T.FEATURES, model.home.featureImportances.toArray(), model.away.featureImportances.toArray()
        )
    ]
    return spark.createDataFrame(rows, "feature string, home_importance double, away_importance double")


@query("gbt_predict")
def gbt_predict(spark, sf):
    model, val = tree_model(spark, sf)
    return model.predict(val).select(
        "match_id", "lambda_home", "lambda_away", "prob_home", "prob_draw", "prob_away"
    )


VOCAB = """
vocab as (select team, row_number() over (order by team) as idx from
  (select home_team as team from tb_matches union select away_team from tb_matches))
"""


@query("team_vocab", twin("tb_matches", VOCAB + "select * from vocab"))
def team_vocab(spark, sf):
    return N.team_vocab(view(spark, sf, "tb_matches"))


#: Hosts and squad columns are empty in the supplied tables: the twin expects zeros there.
CONTEXT = [
    "neutral", "rest_home", "rest_away", "elo", "knockout", "host_home", "host_away",
    "top5_home", "top5_away", "caps_home", "caps_away", "goals_home", "goals_away",
]


@query(
    "context_vector",
    twin("tb_matches", LONG + f"""
    gaps as (select n.team, n.match_id,
        cast(n.match_date - lag(n.match_date) over (partition by n.team order by n.rn) as double) as rest from num n)
    select m.match_id, case when neutral then 1.0 else 0.0 end::double as neutral,
      round(coalesce(g.rest, 0) / 180, 5) as rest_home, round(coalesce(r.rest, 0) / 180, 5) as rest_away,
      round((elo_home_pre - elo_away_pre) / 400, 5) as elo,
      case when tournament in {MAJOR} then 1.0 else 0.0 end::double as knockout,
      {", ".join(f"0::double as {c}" for c in CONTEXT[5:])}, 13 as width
    from tb_matches m join gaps g on g.match_id = m.match_id and g.team = home_team
    join gaps r on r.match_id = m.match_id and r.team = away_team"""),
)
def context_vector(spark, sf):
    df = contextual(spark, sf)
    df = df.select("match_id", N.context_vector(df.columns).alias("v"))
    values = [F.round(F.col("v")[i].cast("double"), 5).alias(name) for i, name in enumerate(CONTEXT)]
    return df.select("match_id", *values, F.size("v").alias("width"))


@query(
    "sequence_tensors",
    twin("tb_matches", VOCAB + "," + LONG + HISTORY.format(n=10) + """
    agg as (select team, match_date, count(*) as n, string_agg(gf || ':' || ga || ':' || pts || ':'
        || case when is_home then 1 else 0 end || ':' || cast(round(opp) as int), ' ' order by rn) as played
      from hist group by 1, 2)
    select m.match_id, x.idx as home_idx, y.idx as away_idx,
      trim(repeat('0:0:0:0:0 ', 10 - coalesce(h.n, 0)) || coalesce(h.played, '')) as home_steps,
      trim(repeat('0:0:0:0:0 ', 10 - coalesce(a.n, 0)) || coalesce(a.played, '')) as away_steps
    from tb_matches m join vocab x on x.team = home_team join vocab y on y.team = away_team
    left join agg h on h.team = home_team and h.match_date = m.match_date
    left join agg a on a.team = away_team and a.match_date = m.match_date"""),
)
def sequence_tensors(spark, sf):
    matches = contextual(spark, sf, sequence=C.SEQUENCE_LENGTH)
    df = N.sequence_tensors(matches, N.team_vocab(matches))

    def steps(side):
        def told(r):
            opponent = F.round(r[3].cast("double") * C.FORM_RATING_SCALE)
            values = [r[0], r[1], r[2], r[4], opponent]
            return F.concat_ws(":", *[v.cast("int").cast("string") for v in values])

        return F.array_join(F.transform(f"{side}_seq", told), " ").alias(f"{side}_steps")

    return df.select("match_id", "home_idx", "away_idx", steps("home"), steps("away"))


def net_shapes(width: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights for team vectors of the given width."""
    fused = 2 * width + 2 * C.GRU_HIDDEN + C.CONTEXT_OUT
    return {
        "gru_in": (3 * C.GRU_HIDDEN, C.FORM_FEATURES), "gru_hid": (3 * C.GRU_HIDDEN, C.GRU_HIDDEN),
        "gru_in_bias": (3 * C.GRU_HIDDEN,), "gru_hid_bias": (3 * C.GRU_HIDDEN,),
        "ctx1": (C.CONTEXT_HIDDEN, C.CONTEXT_DIM), "ctx1_bias": (C.CONTEXT_HIDDEN,),
        "ctx2": (C.CONTEXT_OUT, C.CONTEXT_HIDDEN), "ctx2_bias": (C.CONTEXT_OUT,),
        "fuse1": (C.FUSION_HIDDEN, fused), "fuse1_bias": (C.FUSION_HIDDEN,),
        "fuse2": (3, C.FUSION_HIDDEN), "fuse2_bias": (3,),
    }


def net_weights(seed: int = 7, width: int = C.EMBED_DIM) -> dict[str, np.ndarray]:
    """Untrained weights of the right shapes."""
    rng = np.random.default_rng(seed)
    return {name: rng.normal(0, 0.15, shape) for name, shape in net_shapes(width).items()}


VECTOR_WIDTH = 64


def plain_weights() -> dict[str, np.ndarray]:
    """Weights under which the network is a formula that SQL can write.

    The update gates are shut, so a sequence ends as the tanh of its last step; the
    context passes through; three hidden units are sums that stay positive.
    """
    w = {name: np.zeros(shape) for name, shape in net_shapes(VECTOR_WIDTH).items()}
    hidden, context = C.GRU_HIDDEN, 2 * VECTOR_WIDTH + 2 * C.GRU_HIDDEN
    w["gru_in_bias"][hidden : 2 * hidden] = -60.0
    for i in range(C.FORM_FEATURES):
        w["gru_in"][2 * hidden + i, i] = 0.3
    for i in range(C.CONTEXT_DIM):
        w["ctx1"][i, i], w["ctx2"][i, i] = 1.0, 1.0
    w["ctx1_bias"][: C.CONTEXT_DIM] = 50.0
    w["ctx2_bias"][: C.CONTEXT_DIM] = -50.0
    for unit, own in ((0, 0), (1, 1)):
        vector, form = own * VECTOR_WIDTH, 2 * VECTOR_WIDTH + own * hidden
        w["fuse1"][unit, vector : vector + VECTOR_WIDTH] = 0.02 * np.arange(1, VECTOR_WIDTH + 1) / VECTOR_WIDTH
        w["fuse1"][unit, form : form + C.FORM_FEATURES] = 0.5
        w["fuse1"][unit, context : context + C.CONTEXT_DIM] = 0.1
        w["fuse2"][unit, unit] = 1.0
    w["fuse1"][2, context + 3] = 1.0
    w["fuse1_bias"][:3], w["fuse2"][2, 2] = 20.0, 0.5
    w["fuse2_bias"][:] = (-20.0, -20.0, -10.0)
    return w


def _own_unit(side: str) -> str:
    last = " + ".join(f"tanh(0.3 * {side}.{c})" for c in ("gf", "ga", "pts", "opp", "home"))
    return f"v{side}.v + 0.5 * (case when {side}.team is null then 0 else {last} end) + 0.1 * ctx"


NETWORK = VOCAB + "," + LONG + """
recent as (select d.team, d.match_date, n.gf, n.ga, n.pts, n.opp / 1500 as opp, case when n.is_home then 1 else 0 end as home
  from days d join num n on n.team = d.team and n.rn = d.upto),
gaps as (select n.team, n.match_id,
    cast(n.match_date - lag(n.match_date) over (partition by n.team order by n.rn) as double) as rest from num n),
vecs as (select team, coalesce(list_sum(list_transform(embedding, lambda x, i: x::double * 0.02 * i / 64)), 0) as v
  from vocab left join embeddings on vec_id = idx),
contexts as (select m.*, (elo_home_pre - elo_away_pre) / 400 as elo, case when neutral then 1 else 0 end
    + coalesce(g.rest, 0) / 180 + coalesce(r.rest, 0) / 180 + (elo_home_pre - elo_away_pre) / 400
    + case when tournament in """ + f"{MAJOR}" + """ then 1 else 0 end as ctx
  from tb_matches m join gaps g on g.match_id = m.match_id and g.team = home_team
  join gaps r on r.match_id = m.match_id and r.team = away_team),
rates as (select m.match_id, ln(1 + exp(""" + _own_unit("h") + """)) as lambda_home,
    ln(1 + exp(""" + _own_unit("a") + """)) as lambda_away, 0.2 * tanh(0.5 * elo) as rho
  from contexts m left join recent h on h.team = home_team and h.match_date = m.match_date
  left join recent a on a.team = away_team and a.match_date = m.match_date
  join vecs vh on vh.team = home_team join vecs va on va.team = away_team)
"""


@query(
    "net_batch_score",
    twin("tb_matches", NETWORK + "," + (CELLS + MARKETS).replace("tb_params p", "rates p") + """
    select match_id, round(lambda_home, 4) as lambda_home, round(lambda_away, 4) as lambda_away, round(rho, 4) as rho,
      round(home_win, 4) as prob_home, round(draw, 4) as prob_draw, round(away_win, 4) as prob_away
    from rates join markets using (match_id)"""),
)
def net_batch_score(spark, sf):
    matches = contextual(spark, sf, sequence=C.SEQUENCE_LENGTH)
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("idx"), F.transform("embedding", lambda x: x.cast("float")).alias("vector")
    )
    vocab = N.with_vectors(N.team_vocab(matches), vectors)
    df = N.net_batch_score(N.sequence_tensors(matches, vocab), plain_weights())
    names = ["lambda_home", "lambda_away", "rho", "prob_home", "prob_draw", "prob_away"]
    return df.select("match_id", *[F.round(c, 4).alias(c) for c in names])


SUMMARY = """
select fold_idx, sum(n_matches)::bigint as n_matches, sum(n_value_bets)::bigint as n_value_bets, round(avg(rps), 6) as rps,
  round(avg(nll), 6) as nll, round(avg(flat_roi), 6) as flat_roi, round(avg(kelly_roi), 6) as kelly_roi
from perfold group by rollup (fold_idx)
"""


@query(
    "backtest_run",
    twin("tb_matches tb_quotes", FOLD_STATS + FIT + """,
    asked as (select * from tb_matches join folds on match_date >= val_start and match_date < val_end),"""
    + RATED + "," + BETS.replace("tb_params p", "rates p") + "," + ROI + SUMMARY, True),
)
def backtest_run(spark, sf):
    matches = view(spark, sf, "tb_matches").drop("elo_home_pre", "elo_away_pre")
    df = P.backtest(matches, odds=P.best_prices(view(spark, sf, "tb_quotes")), model="rates")
    return rounded(df, ["fold_idx"])


LATEST_FORECAST = """
latest as (select fold_idx, team, arg_max(r, struct_pack(d := match_date, m := match_id)) as r
  from ends join folds on match_date < train_end group by 1, 2),
gap as (select v.*, h.r + case when neutral then 0 else 100 end - a.r as g from val v
  join latest h on h.fold_idx = v.fold_idx and h.team = home_team
  join latest a on a.fold_idx = v.fold_idx and a.team = away_team),
p as (select *, 0.26 * exp(-(g * g) / 80000.0) as dr, 1 / (1 + pow(10.0, -g / 400.0)) as w from gap)
select fold_idx, count(*) as n_matches, round(avg((pow(w * (1 - dr)
    - case when home_score > away_score then 1 else 0 end, 2)
  + pow(w * (1 - dr) + dr - case when home_score >= away_score then 1 else 0 end, 2)) / 2), 6) as rps
from p group by fold_idx
"""


@query(
    "backtest_ratings",
    twin("tb_matches", ELO + "," + FOLDS + """,
    val as (select * from tb_matches join folds on match_date >= val_start and match_date < val_end),
    ends as (select home_team as team, match_date, match_id, hn as r from rated
      union all select away_team, match_date, match_id, an from rated),""" + LATEST_FORECAST, True),
)
def backtest_ratings(spark, sf):
    """Back-test of the rating model on its own scan."""
    matches = view(spark, sf, "tb_matches").drop("elo_home_pre", "elo_away_pre")
    df = P.backtest(matches, model="ratings", summary=False)
    return df.select("fold_idx", "n_matches", F.round("rps", 6).alias("rps"))


@query(
    "backtest_rating_model",
    twin("tb_matches tb_quotes", FOLDS + """,
    val as (select * from tb_matches join folds on match_date >= val_start and match_date < val_end),
    ends as (select home_team as team, match_date, match_id, elo_home_pre as r from tb_matches
      union all select away_team, match_date, match_id, elo_away_pre from tb_matches),""" + LATEST_FORECAST),
)
def backtest_rating_model(spark, sf):
    """Back-test of the rating model with the view's given ratings as the scan's result."""
    matches = view(spark, sf, "tb_matches")
    rated = P.fold_latest_ratings(matches, folds(spark, sf), "elo_home_pre", "elo_away_pre")
    return P.score_rating_folds(matches, folds(spark, sf), rated).select(
        "fold_idx", "n_matches", F.round("rps", 6).alias("rps")
    )


# Schedule, given prices and signals, after the last day of the fitted rows.
RUN = RATED + "," + CHAIN.replace("tb_params p", "rates p") + "," + LISTED + """,
offer as (select l.* from listed l join straight using (home_team, away_team, pos)),""" + BETS.replace(
    "tb_params p", "adjusted p"
).replace(ODDS, """
odds as (select m.match_id, coalesce(s.odds_home, r.odds_away) as odds_home,
    coalesce(s.odds_draw, r.odds_draw) as odds_draw, coalesce(s.odds_away, r.odds_home) as odds_away
  from tb_matches m left join offer s on s.home_team = m.home_team and s.away_team = m.away_team
  left join offer r on r.home_team = m.away_team and r.away_team = m.home_team)
""") + """
select match_id, round(lambda_home, 6) as lambda_home, round(lambda_away, 6) as lambda_away, round(home_win, 6) as prob_home,
  round(draw, 6) as prob_draw, round(away_win, 6) as prob_away, pick as best_edge_outcome, round(edge, 6) as best_edge,
  is_value, round(case when is_value and price > 1 then stake else 0 end, 6) as kelly_stake,
  round(coalesce(lasth.r, 1500), 6) as elo_home_pre, round(coalesce(lasta.r, 1500), 6) as elo_away_pre
from staked join adjusted using (match_id) join asked using (match_id)
left join lastly lasth on lasth.team = asked.home_team left join lastly lasta on lasta.team = asked.away_team
"""
# The latest ratings of the played rows.
LASTLY = ELO.replace("tb_matches", "past") + """,
lastly as (select team, arg_max(r, struct_pack(d := match_date, m := match_id)) as r from (
  select home_team as team, match_date, match_id, hn as r from rated
  union all select away_team, match_date, match_id, an from rated) group by team),"""
ASKED = """,
asked as (select match_id, home_team, away_team, true as neutral, 0 as fold_idx from tb_matches
  where match_date >= date '2001-07-01'),"""


def _run(spark, sf, history, **options):
    schedule = view(spark, sf, "tb_matches").filter("match_date >= date '2001-07-01'").select(
        "match_id", "match_date", "home_team", "away_team", "pool",
        F.col("match_date").cast("timestamp_ntz").alias("kickoff"), F.lit(False).alias("is_completed"),
    )
    losses, sentiment, trajectory = signal_tables(spark, sf)
    df = P.predict_upcoming(history, schedule, listed(spark, sf), losses, sentiment, trajectory, **options)
    names = ["lambda_home", "lambda_away", "prob_home", "prob_draw", "prob_away", "best_edge", "kelly_stake", "elo_home_pre", "elo_away_pre"]
    return df.select("match_id", "best_edge_outcome", "is_value", *[F.round(c, 6).alias(c) for c in names])


def _before(spark, sf, day):
    return view(spark, sf, "tb_matches").drop("elo_home_pre", "elo_away_pre").filter(f"match_date < date '{day}'")


@query(
    "predict_upcoming",
    twin("tb_matches", """
    past as (select * from tb_matches where match_date < date '2001-07-01'),""" + LASTLY
    + stats_sql("past", "(select max(match_date) from past)") + FIT + ASKED + RUN, True),
)
def predict_upcoming(spark, sf):
    """The whole prediction run: goal rates, adjustments, prices and bets."""
    return _run(spark, sf, _before(spark, sf, "2001-07-01"))


@query(
    "predict_upcoming_injected",
    twin("tb_matches", """
    past as (select * replace (neutral or match_date >= date '2001-01-01' as neutral,
      case when match_date >= date '2001-01-01' then 'FIFA World Cup' else tournament end as tournament) from tb_matches
      where match_date < date '2001-07-01'),""" + LASTLY
    + stats_sql("past", "(select max(match_date) from past)") + FIT + ASKED + RUN, True),
)
def predict_upcoming_injected(spark, sf):
    """The same run after half a year's matches came in as finished ones of the tournament, on neutral ground."""
    done = _before(spark, sf, "2001-07-01").filter("match_date >= date '2001-01-01'").select(
        "match_id", "match_date", "home_team", "away_team", "home_score", "away_score", "pool"
    )
    return _run(spark, sf, _before(spark, sf, "2001-01-01"), completed=done)
