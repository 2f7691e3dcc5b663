"""Fold, back-test, calibration and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.grids import CELLS, MARKETS, grids, scored
from matchlab.catalog.prices import BETS, VIEWS
from matchlab.catalog.registry import query
from matchlab.catalog.views import table, twin, view
from matchlab.functions import grid as G
from matchlab.functions import metrics as M
from matchlab.models import ensemble as E
from matchlab.operators import bets as B
from matchlab.operators import calibration as L
from matchlab.operators import folds as D
from matchlab.operators import odds as O

# No month of the table starts on a day past the 28th, so plain month steps agree.
FOLDS = """
span as (select min(match_date) as a, max(match_date) as b from tb_matches),
steps as (select cast(a + to_months(cast(36 + 6 * g as int)) as date) as val_start, a, b, g
  from span, (select unnest(range(200)) as g)),
folds as (select cast(row_number() over (order by val_start) as int) as fold_idx, a as train_start, val_start,
    cast(val_start + interval 6 months as date) as val_end, val_start as train_end
  from steps where cast(val_start + interval 6 months as date) <= b)
"""


def folds(spark, sf):
    return D.walk_forward_folds(view(spark, sf, "tb_matches"))


@query("walk_forward_folds", twin("tb_matches", FOLDS + "select * from folds"))
def walk_forward_folds(spark, sf):
    return folds(spark, sf)


@query(
    "fold_range_join",
    twin("tb_matches", FOLDS + """
    select fold_idx, match_id from tb_matches join folds on match_date >= val_start and match_date < val_end"""),
)
def fold_range_join(spark, sf):
    return D.validation_rows(view(spark, sf, "tb_matches"), folds(spark, sf)).select("fold_idx", "match_id")


@query(
    "training_period",
    twin("tb_matches", FOLDS + """
    select match_id, min(fold_idx) as period from tb_matches join folds on match_date < train_end group by 1"""),
)
def training_period(spark, sf):
    return D.training_period(view(spark, sf, "tb_matches"), folds(spark, sf)).select("match_id", "period")


# A team table in which newcomers do appear late: customers play customers.
NEWCOMERS = FOLDS + """,
games as (select o_orderkey as match_id, cast(o_orderdate as date) as match_date,
    concat('C', cast(o_custkey as varchar)) as home_team,
    concat('C', cast(o_custkey + 1 + o_orderkey % 5 as varchar)) as away_team from orders),
seen as (select team, min(match_date) as first_date from (select home_team as team, match_date from games
  union all select away_team, match_date from games) group by team),
val as (select fold_idx, train_end, g.* from games g join folds on match_date >= val_start and match_date < val_end)
"""


def games(spark, sf):
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"),
        F.concat(F.lit("C"), key.cast("string")).alias("home_team"),
        F.concat(F.lit("C"), (key + 1 + F.col("o_orderkey") % 5).cast("string")).alias("away_team"),
    )


@query(
    "known_team_semijoin",
    twin("tb_matches", NEWCOMERS + """
    select fold_idx, match_id from val join seen h on h.team = home_team join seen a on a.team = away_team
    where h.first_date < train_end and a.first_date < train_end"""),
)
def known_team_semijoin(spark, sf):
    all_games = games(spark, sf)
    val = D.validation_rows(all_games, folds(spark, sf))
    return D.known_teams_only(val, all_games).select("fold_idx", "match_id")


@query(
    "unseen_team_antijoin",
    twin("tb_matches", NEWCOMERS + """
    select distinct team from seen where first_date >= date '2000-01-01'"""),
)
def unseen_team_antijoin(spark, sf):
    all_games = games(spark, sf)
    old = all_games.filter("match_date < date '2000-01-01'")
    return D.unseen_teams(all_games, D.all_teams(old))


ROI = """
folded as (select fold_idx, s.*, (pow(home_win - case when result = 'home' then 1 else 0 end, 2)
    + pow(home_win + draw - case when result <> 'away' then 1 else 0 end, 2)) / 2 as rps,
    -ln(greatest(c.p, 1e-10)) as nll
  from staked s join folds on match_date >= val_start and match_date < val_end
  join cells c on c.match_id = s.match_id and i = least(home_score, 7) and j = least(away_score, 7)),
perfold as (select fold_idx, count(*) as n_matches, avg(rps) as rps, avg(nll) as nll,
    count(*) filter (where is_value) as n_value_bets,
    sum(case when is_value then case when won then price - 1 else -1 end end)
      / nullif(count(*) filter (where is_value), 0) as flat_roi,
    sum(case when is_value then case when won then stake * (price - 1) else -stake end end)
      / nullif(sum(case when is_value then stake end), 0) as kelly_roi
  from folded group by fold_idx)
"""


def scored_folds(spark, sf):
    # Rows outside all folds are dropped before any grid is built for them.
    rows = D.validation_rows(view(spark, sf, "tb_matches"), folds(spark, sf))
    rated = G.with_outcome_probs(G.with_score_grid(rows.join(view(spark, sf, "tb_params"), "match_id")))
    prices = O.best_quotes(view(spark, sf, "tb_quotes"))
    df = B.with_returns(B.with_selection(rated.join(prices, "match_id", "left")))
    outcome = M.outcome_class(F.col("home_score"), F.col("away_score"))
    nll = G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score"))
    return df.withColumns({"rps": M.rps(F.col("prob_home"), F.col("prob_draw"), outcome), "nll": nll})


def rounded(df, first):
    names = ["rps", "nll", "flat_roi", "kelly_roi"]
    return df.select(
        *first, "n_matches", "n_value_bets", *[F.round(c, 6).alias(c) for c in names]
    )


@query(
    "fold_metrics",
    twin(VIEWS, BETS + "," + FOLDS + "," + ROI + """
    select fold_idx, n_matches, n_value_bets, round(rps, 6) as rps, round(nll, 6) as nll,
      round(flat_roi, 6) as flat_roi, round(kelly_roi, 6) as kelly_roi from perfold"""),
)
def fold_metrics(spark, sf):
    return rounded(D.fold_metrics(scored_folds(spark, sf)), ["fold_idx"])


@query(
    "backtest_summary",
    twin(VIEWS, BETS + "," + FOLDS + "," + ROI + """
    select fold_idx, sum(n_matches)::bigint as n_matches, sum(n_value_bets)::bigint as n_value_bets,
      round(avg(rps), 6) as rps, round(avg(nll), 6) as nll, round(avg(flat_roi), 6) as flat_roi,
      round(avg(kelly_roi), 6) as kelly_roi from perfold group by rollup (fold_idx)"""),
)
def backtest_summary(spark, sf):
    return rounded(D.backtest_summary(D.fold_metrics(scored_folds(spark, sf))), ["fold_idx"])


BINS = """
p as (select home_win as p, case when home_score > away_score then 1.0 else 0.0 end as y
  from tb_matches join markets using (match_id)),
binned as (select cast((select count(*) from range(1, 10) t(i) where p >= i / 10.0::double) as int) as bin, p, y
  from p),
bins as (select bin, count(*) as n, avg(p) as mean_pred, avg(y) as frac_pos from binned group by bin)
"""


def home_win_forecast(spark, sf):
    df = scored(spark, sf)
    return df.select(
        "match_id", "prob_home", "prob_draw", "prob_away",
        (F.col("home_score") > F.col("away_score")).alias("happened"),
        M.outcome_class(F.col("home_score"), F.col("away_score")).alias("outcome"),
    )


@query(
    "reliability_bins",
    twin("tb_matches tb_params", CELLS + MARKETS + "," + BINS + """
    select cast(g as int) as bin, coalesce(n, 0) as n, round(coalesce(mean_pred, (g + 0.5) / 10), 6) as mean_pred,
      round(frac_pos, 6) as frac_pos, coalesce(n, 0) < 5 as is_small
    from range(10) t(g) left join bins on bin = g"""),
)
def reliability_bins(spark, sf):
    df = L.reliability_bins(home_win_forecast(spark, sf), "prob_home", "happened")
    return df.select(
        "bin", "n", F.round("mean_pred", 6).alias("mean_pred"),
        F.round("frac_pos", 6).alias("frac_pos"), "is_small",
    )


@query(
    "ece",
    twin("tb_matches tb_params", CELLS + MARKETS + "," + BINS + """
    select round(sum(n * abs(mean_pred - frac_pos)) / sum(n), 6) as ece from bins"""),
)
def ece(spark, sf):
    df = L.expected_calibration_error(home_win_forecast(spark, sf), "prob_home", "happened")
    return df.select(F.round("ece", 6).alias("ece"))


@query(
    "temperature_scale",
    twin("tb_matches tb_params", CELLS + MARKETS + """,
    e as (select match_id, pow(greatest(home_win, 1e-10), 1 / 1.7) as h, pow(greatest(draw, 1e-10), 1 / 1.7) as d,
      pow(greatest(away_win, 1e-10), 1 / 1.7) as a from markets)
    select match_id, round(h / (h + d + a), 6) as prob_home, round(d / (h + d + a), 6) as prob_draw,
      round(a / (h + d + a), 6) as prob_away from e"""),
)
def temperature_scale(spark, sf):
    df = home_win_forecast(spark, sf)
    names = ["prob_home", "prob_draw", "prob_away"]
    scaled = M.temperature_scale([F.col(c) for c in names], 1.7)
    return df.select("match_id", *[F.round(c, 6).alias(n) for n, c in zip(names, scaled)])


@query(
    "fit_temperature",
    twin("tb_matches tb_params", CELLS + MARKETS + """,
    z as (select ln(greatest(home_win, 1e-10)) as h, ln(greatest(draw, 1e-10)) as d, ln(greatest(away_win, 1e-10)) as a,
        case when home_score > away_score then ln(greatest(home_win, 1e-10))
          when home_score = away_score then ln(greatest(draw, 1e-10)) else ln(greatest(away_win, 1e-10)) end as c
      from tb_matches join markets using (match_id)),
    tried as (select t / 100 as temperature, avg(ln(exp(h * 100 / t) + exp(d * 100 / t) + exp(a * 100 / t)) - c * 100 / t) as nll
      from z, range(1, 1001) g(t) group by t)
    select round(arg_min(temperature, nll), 2) as temperature, round(min(nll), 6) as nll from tried"""),
)
def fit_temperature(spark, sf):
    df = home_win_forecast(spark, sf)
    names = ["prob_home", "prob_draw", "prob_away"]
    t = round(L.fit_temperature(df, names, "outcome"), 2)
    scaled = M.temperature_scale([F.col(c) for c in names], t)
    chosen = F.element_at(F.array(*scaled), F.col("outcome") + 1)
    return df.agg(F.lit(t).alias("temperature"), F.round(F.avg(-F.log(chosen)), 6).alias("nll"))


@query(
    "isotonic_fit",
    twin("tb_matches tb_params", CELLS + MARKETS + """,
    p as (select match_id, round(home_win, 9) as p, case when home_score > away_score then 1.0 else 0.0 end::double as y
      from tb_matches join markets using (match_id)),
    pts as (select p, count(*) as n, sum(y) as s, row_number() over (order by p) as i from p group by p),
    cum as (select *, sum(n) over (order by i) as cn, sum(s) over (order by i) as cs from pts),
    av as (select a.i as a, b.i as b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) as v
      from cum a join cum b on b.i >= a.i),
    low as (select a, b, min(v) over (partition by a order by b desc) as v from av),
    fit as (select b as i, max(v) as v from low group by b)
    select match_id, round(v, 6) as calibrated from p join pts using (p) join fit using (i)"""),
)
def isotonic_fit(spark, sf):
    df = home_win_forecast(spark, sf).withColumn("prob", F.round("prob_home", 9))
    out = L.fit_isotonic(df, "prob", "happened").transform(df)
    return out.select("match_id", F.round("prediction", 6).alias("calibrated"))


@query(
    "ensemble_grid",
    twin("tb_params", CELLS.replace("cells as (", "one as (").rstrip().rstrip(",") + "," + """
    flat as (select match_id, i, j, exp(-1.5) * pow(1.5, i) / f1.f * exp(-1.1) * pow(1.1, j) / f2.f as q
      from one join fact f1 on f1.g = i join fact f2 on f2.g = j),
    two as (select match_id, i, j, q / sum(q) over (partition by match_id) as p from flat),
    cells as (select one.match_id, one.i, one.j, 0.7 * one.p + 0.3 * two.p as p
      from one join two using (match_id, i, j)),""" + MARKETS + """
    select match_id, round(home_win, 6) as prob_home, round(draw, 6) as prob_draw,
      round(away_win, 6) as prob_away, round(expected_home, 6) as expected_home,
      round(expected_away, 6) as expected_away from markets"""),
)
def ensemble_grid(spark, sf):
    from matchlab.models.trees import unfitted_rates

    first = view(spark, sf, "tb_params")
    second = unfitted_rates(first.select("match_id"))
    df = E.ensemble_grid([first, second], [0.7, 0.3])
    names = ["prob_home", "prob_draw", "prob_away", "expected_home", "expected_away"]
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    "ensemble_weights",
    twin("tb_matches", """
    r as (select tournament as model, avg(0.1 + (match_id % 100) / 500.0) as rps from tb_matches group by 1)
    select model, round((1 / rps) / sum(1 / rps) over (), 6) as weight from r"""),
)
def ensemble_weights(spark, sf):
    scores = view(spark, sf, "tb_matches").groupBy(F.col("tournament").alias("model")).agg(
        F.avg(0.1 + (F.col("match_id") % 100) / 500.0).alias("rps")
    )
    return E.inverse_rps_weights(scores).select("model", F.round("weight", 6).alias("weight"))
