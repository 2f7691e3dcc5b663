"""Score grid, market and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.registry import query
from matchlab.catalog.views import twin, view
from matchlab.functions import grid as G
from matchlab.functions import metrics as M
from matchlab.functions import sql as S

# Twin of the grid: one row per match and cell.
CELLS = """
k as (select unnest(range(8)) as g),
fact as (select g, (case g when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 6 when 4 then 24
  when 5 then 120 when 6 then 720 else 5040 end)::double as f from k),
raw as (
  select p.match_id, lambda_home, lambda_away, rho, h.g as i, a.g as j,
    exp(-lambda_home) * pow(lambda_home, h.g) / h.f
    * exp(-lambda_away) * pow(lambda_away, a.g) / a.f
    * case when h.g = 0 and a.g = 0 then 1 - lambda_home * lambda_away * rho
           when h.g = 1 and a.g = 0 then 1 + lambda_away * rho
           when h.g = 0 and a.g = 1 then 1 + lambda_home * rho
           when h.g = 1 and a.g = 1 then 1 - rho else 1 end as q
  from tb_params p, fact h, fact a),
cells as (select match_id, i, j, q / sum(q) over (partition by match_id) as p from raw),
"""
MARKETS = """
markets as (select match_id,
  sum(case when i > j then p else 0 end) as home_win,
  sum(case when i = j then p else 0 end) as draw,
  sum(case when i < j then p else 0 end) as away_win,
  sum(case when i + j >= 1 then p else 0 end) as over_0_5,
  sum(case when i + j >= 2 then p else 0 end) as over_1_5,
  sum(case when i + j >= 3 then p else 0 end) as over_2_5,
  sum(case when i + j >= 4 then p else 0 end) as over_3_5,
  sum(case when i + j >= 5 then p else 0 end) as over_4_5,
  sum(case when i >= 1 and j >= 1 then p else 0 end) as btts_yes,
  sum(case when i - j >= 2 then p else 0 end) as by2,
  sum(case when i - j = 1 then p else 0 end) as by1,
  sum(case when i - j >= -1 then p else 0 end) as not2,
  sum(case when i - j = -1 then p else 0 end) as lose1,
  sum(i * p) as expected_home, sum(j * p) as expected_away
  from cells group by match_id)
"""


def grids(spark, sf):
    return G.with_score_grid(view(spark, sf, "tb_params"))


def rounded(df, *columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query(
    "poisson_pmf",
    twin("tb_params", CELLS + """
    pmf as (select match_id, g, round(exp(-lambda_home) * pow(lambda_home, g) / f, 6) as p
            from tb_params, fact)
    select match_id, g as goals, p as prob from pmf"""),
)
def poisson_pmf(spark, sf):
    pmf = G.poisson_pmf("lambda_home")
    rows = view(spark, sf, "tb_params").select("match_id", F.posexplode(pmf))
    return rows.select(
        "match_id", F.col("pos").cast("bigint").alias("goals"), F.round("col", 6).alias("prob")
    )


@query(
    "score_grid",
    twin("tb_params", CELLS + """
    done as (select 1) select match_id, i as home, """ + ", ".join(
        f"round(sum(case when j = {n} then p else 0 end), 6) as away_{n}" for n in range(8)
    ) + " from cells group by match_id, i"),
)
def score_grid(spark, sf):
    lines = F.array(*[F.slice("grid", 8 * i + 1, 8) for i in range(8)])
    rows = grids(spark, sf).select("match_id", F.posexplode(lines))
    return rows.select(
        "match_id", F.col("pos").cast("bigint").alias("home"),
        *[F.round(F.col("col")[n], 6).alias(f"away_{n}") for n in range(8)],
    )


_FLAT = ", ".join(
    f"round({expr}, 6) as {name}"
    for name, expr in {
        "home_win": "home_win", "draw": "draw", "away_win": "away_win",
        **{f"over_{n}_5": f"over_{n}_5" for n in range(5)},
        **{f"under_{n}_5": f"1 - over_{n}_5" for n in range(5)},
        "btts_yes": "btts_yes", "btts_no": "1 - btts_yes",
        "ah_home_m1_5": "by2", "ah_home_m0_5": "home_win", "ah_home_p0_5": "home_win + draw",
        "ah_home_p1_5": "not2", "ah_home_m1_win": "by2", "ah_home_m1_push": "by1",
        "ah_home_p1_win": "home_win + draw", "ah_home_p1_push": "lose1",
    }.items()
)


@query("derive_markets", twin("tb_params", CELLS + MARKETS + f"select match_id, {_FLAT} from markets"))
def derive_markets(spark, sf):
    df = G.with_markets(grids(spark, sf)).select("match_id", "markets.*")
    return df.select("match_id", *rounded(df, *G.MARKETS))


@query(
    "ah_away_side",
    twin("tb_params", CELLS + MARKETS + """
    select match_id, round(1 - not2, 6) as ah_away_m1_5, round(away_win, 6) as ah_away_m0_5,
      round(1 - home_win, 6) as ah_away_p0_5, round(1 - by2, 6) as ah_away_p1_5 from markets"""),
)
def ah_away_side(spark, sf):
    df = G.with_markets(grids(spark, sf))
    df = df.select("match_id", G.ah_away_side(F.col("markets")).alias("s")).select("match_id", "s.*")
    return df.select("match_id", *rounded(df, *df.columns[1:]))


@query(
    "expected_goals",
    twin("tb_params", CELLS + MARKETS + """
    select match_id, round(expected_home, 6) as expected_home,
      round(expected_away, 6) as expected_away from markets"""),
)
def expected_goals(spark, sf):
    df = G.with_expected_goals(grids(spark, sf))
    return df.select("match_id", *rounded(df, "expected_home", "expected_away"))


@query(
    "top_scorelines",
    twin("tb_params", CELLS + """
    ranked as (select *, row_number() over (partition by match_id order by round(p, 12) desc, i, j) as rk
               from cells)
    select match_id, rk, i as home, j as away, round(p, 6) as prob from ranked where rk <= 5"""),
)
def top_scorelines(spark, sf):
    # Cells are rounded to 12 places before ranking so that equal cells tie in both engines.
    grid = F.transform("grid", lambda p: F.round(p, 12))
    rows = grids(spark, sf).select("match_id", F.posexplode(G.top_scorelines(grid, 5)))
    return rows.select(
        "match_id", (F.col("pos") + 1).cast("bigint").alias("rk"), "col.home", "col.away",
        F.round("col.prob", 6).alias("prob"),
    )


MATCHES = "tb_matches tb_params"
OUTCOME = "case when home_score > away_score then 0 when home_score = away_score then 1 else 2 end"


def scored(spark, sf):
    """Matches with their grid and 1X2 probabilities."""
    matches = view(spark, sf, "tb_matches")
    df = G.with_score_grid(matches.join(view(spark, sf, "tb_params"), "match_id"))
    return G.with_outcome_probs(df)


def outcome():
    return M.outcome_class(F.col("home_score"), F.col("away_score"))


RPS = f"""
joined as (select m.match_id, tournament, home_score, away_score, home_win, draw, away_win,
    {OUTCOME} as outcome, over_2_5, btts_yes
  from tb_matches m join markets using (match_id)),
rps as (select *, (pow(home_win - case when outcome = 0 then 1 else 0 end, 2)
    + pow(home_win + draw - case when outcome <= 1 then 1 else 0 end, 2)) / 2 as rps from joined),
nll as (select r.*, -ln(greatest(p, 1e-10)) as nll from rps r join cells c
    on c.match_id = r.match_id and i = least(home_score, 7) and j = least(away_score, 7))
"""


@query(
    "outcome_class",
    twin("tb_matches", f"select match_id, {OUTCOME} as outcome from tb_matches"),
)
def outcome_class(spark, sf):
    return view(spark, sf, "tb_matches").select("match_id", outcome().alias("outcome"))


@query("rps", twin(MATCHES, CELLS + MARKETS + "," + RPS + "select match_id, round(rps, 6) as rps from rps"))
def rps(spark, sf):
    value = M.rps(F.col("prob_home"), F.col("prob_draw"), outcome())
    return scored(spark, sf).select("match_id", F.round(value, 6).alias("rps"))


@query(
    "scoreline_nll",
    twin(MATCHES, CELLS + MARKETS + "," + RPS + "select match_id, round(nll, 6) as nll from nll"),
)
def scoreline_nll(spark, sf):
    value = G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score"))
    return scored(spark, sf).select("match_id", F.round(value, 6).alias("nll"))


@query(
    "brier",
    twin(MATCHES, CELLS + MARKETS + "," + RPS + """
    select match_id, round(pow(home_win - case when outcome = 0 then 1 else 0 end, 2), 6) as brier
    from rps"""),
)
def brier(spark, sf):
    value = M.brier(F.col("prob_home"), outcome() == 0)
    return scored(spark, sf).select("match_id", F.round(value, 6).alias("brier"))


@query(
    "mean_metrics",
    twin(MATCHES, CELLS + MARKETS + "," + RPS + """
    select tournament, count(*) as n, round(avg(rps), 6) as mean_rps, round(avg(nll), 6) as mean_nll,
      round(avg(pow(home_win - case when outcome = 0 then 1 else 0 end, 2)), 6) as mean_brier
    from nll group by tournament"""),
)
def mean_metrics(spark, sf):
    df = scored(spark, sf)
    nll = G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score"))
    return df.groupBy("tournament").agg(
        F.count("*").alias("n"),
        F.round(F.avg(M.rps(F.col("prob_home"), F.col("prob_draw"), outcome())), 6).alias("mean_rps"),
        F.round(F.avg(nll), 6).alias("mean_nll"),
        F.round(F.avg(M.brier(F.col("prob_home"), outcome() == 0)), 6).alias("mean_brier"),
    )


def _mean(name, sql, value):
    """Register the mean of one row metric over the whole table."""

    @query(
        name,
        twin(MATCHES, CELLS + MARKETS + "," + RPS + f"""
        select count(*) as n, round(avg({sql}), 6) as {name} from nll"""),
    )
    def mean(spark, sf):
        return scored(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(value()), 6).alias(name))

    return mean


mean_rps = _mean(
    "mean_rps", "rps", lambda: M.rps(F.col("prob_home"), F.col("prob_draw"), outcome())
)
mean_nll = _mean(
    "mean_nll", "nll",
    lambda: G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score")),
)
mean_brier = _mean(
    "mean_brier", "pow(home_win - case when outcome = 0 then 1 else 0 end, 2)",
    lambda: M.brier(F.col("prob_home"), outcome() == 0),
)


@query(
    "weighted_nll",
    twin(MATCHES, CELLS + MARKETS + "," + RPS + """
    select round(sum(nll * w) / sum(w), 6) as weighted_nll
    from (select *, 1.0 + match_id % 5 as w from nll)"""),
)
def weighted_nll(spark, sf):
    nll = G.scoreline_nll(F.col("grid"), F.col("home_score"), F.col("away_score"))
    weight = 1.0 + F.col("match_id") % 5
    total = F.sum(nll * weight) / F.greatest(F.sum(weight), F.lit(1e-10))
    return scored(spark, sf).agg(F.round(total, 6).alias("weighted_nll"))


@query("sql_markets", twin("tb_params", CELLS + MARKETS + f"select match_id, {_FLAT} from markets"))
def sql_markets(spark, sf):
    """Markets by the registered SQL functions alone."""
    S.register(spark)
    view(spark, sf, "tb_params").createOrReplaceTempView("forecasts")
    columns = ", ".join(f"round(m.{c}, 6) as {c}" for c in G.MARKETS)
    return spark.sql(
        f"select match_id, {columns} from (select match_id, score_markets(score_grid(lambda_home, lambda_away, rho)) as m from forecasts)"
    )
