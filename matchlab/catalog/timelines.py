"""Form, rest and rating queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlab.catalog.registry import query
from matchlab.catalog.views import table, twin, view
from matchlab.functions import metrics as M
from matchlab.operators import ratings as R
from matchlab.operators import timeline as T

LONG = """
longf as (
  select match_id, match_date, home_team as team, away_team as opponent, true as is_home,
    home_score as gf, away_score as ga, elo_away_pre as opp from tb_matches
  union all
  select match_id, match_date, away_team, home_team, false, away_score, home_score, elo_home_pre
  from tb_matches),
pts as (select *, case when gf > ga then 3 when gf = ga then 1 else 0 end as pts from longf),
num as (select *, row_number() over (partition by team order by match_date, match_id) as rn from pts),
days as (select team, match_date, min(rn) - 1 as upto, min(match_id) as first_match from num
         group by team, match_date),
"""


@query(
    "team_long_form",
    twin("tb_matches", LONG + "x as (select 1) select * from pts"),
)
def team_long_form(spark, sf):
    long = T.team_long_form(view(spark, sf, "tb_matches"))
    return long.withColumnRenamed("opp_rating", "opp")


@query(
    "rest_days",
    twin("tb_matches", LONG + """
    gaps as (select n.team, n.match_id,
        cast(n.match_date - lag(n.match_date) over (partition by n.team order by n.rn) as double) as rest
      from num n)
    select m.match_id, h.rest as rest_days_home, a.rest as rest_days_away
    from tb_matches m join gaps h on h.match_id = m.match_id and h.team = m.home_team
    join gaps a on a.match_id = m.match_id and a.team = m.away_team"""),
)
def rest_days(spark, sf):
    return T.rest_days(view(spark, sf, "tb_matches")).select(
        "match_id", "rest_days_home", "rest_days_away"
    )


HISTORY = """
hist as (select d.team, d.match_date, n.gf, n.ga, n.pts, n.opp, n.is_home, n.rn
  from days d join num n on n.team = d.team and n.rn <= d.upto and n.rn > d.upto - {n}),
"""


@query(
    "form_aggregates",
    twin("tb_matches", LONG + HISTORY.format(n=5) + """
    agg as (select team, match_date, avg(gf) gf, avg(ga) ga, avg(pts) pts, avg(opp) opp, count(*) n
            from hist group by team, match_date)
    select m.match_id,
      round(coalesce(h.gf, 0), 6) as form_gf_home, round(coalesce(a.gf, 0), 6) as form_gf_away,
      round(coalesce(h.ga, 0), 6) as form_ga_home, round(coalesce(a.ga, 0), 6) as form_ga_away,
      round(coalesce(h.pts, 0), 6) as form_pts_home, round(coalesce(a.pts, 0), 6) as form_pts_away,
      round(coalesce(h.opp, 0), 6) as form_opp_elo_home,
      round(coalesce(a.opp, 0), 6) as form_opp_elo_away,
      cast(coalesce(h.n, 0) as double) as form_n_played_home,
      cast(coalesce(a.n, 0) as double) as form_n_played_away
    from tb_matches m
    left join agg h on h.team = m.home_team and h.match_date = m.match_date
    left join agg a on a.team = m.away_team and a.match_date = m.match_date"""),
)
def form_aggregates(spark, sf):
    df = T.match_form(view(spark, sf, "tb_matches"))
    names = [c for c in df.columns if c.startswith("form_")]
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    "form_sequence",
    twin("tb_matches", LONG + HISTORY.format(n=10) + """
    seqs as (select team, match_date, count(*) n,
        string_agg(gf || ':' || ga || ':' || pts || ':' || case when is_home then 1 else 0 end, ' '
                   order by rn) as played,
        sum(opp / 1500) as opp from hist group by team, match_date)
    select m.match_id, coalesce(h.played, '') as home_played, coalesce(a.played, '') as away_played,
      10 - coalesce(h.n, 0) as home_padding, 10 - coalesce(a.n, 0) as away_padding,
      round(coalesce(h.opp, 0), 4) as home_opp, round(coalesce(a.opp, 0), 4) as away_opp
    from tb_matches m
    left join seqs h on h.team = m.home_team and h.match_date = m.match_date
    left join seqs a on a.team = m.away_team and a.match_date = m.match_date"""),
)
def form_sequence(spark, sf):
    df = T.match_sequences(view(spark, sf, "tb_matches"))

    def parts(side):
        # Padding rows are all zero; a real row has a positive opponent rating.
        real = F.filter(f"{side}_seq", lambda r: r[3] > 0)
        text = F.transform(
            real,
            lambda r: F.concat_ws(
                ":", *[F.floor(r[i]).cast("string") for i in (0, 1, 2, 4)]
            ),
        )
        opp = F.aggregate(real, F.lit(0.0), lambda acc, r: acc + r[3].cast("double"))
        return [
            F.array_join(text, " ").alias(f"{side}_played"),
            (F.size(f"{side}_seq") - F.size(real)).cast("bigint").alias(f"{side}_padding"),
            F.round(opp, 4).alias(f"{side}_opp"),
        ]

    return df.select("match_id", *parts("home"), *parts("away"))


@query(
    "form_asof_join",
    twin("tb_matches", LONG + """
    probes as (select c_custkey as probe, concat('T', cast(c_custkey % 64 as varchar(10))) as team,
        date '1994-06-01' + cast(c_custkey * 7 % 3000 as int) as as_of from customer),
    found as (select p.probe, p.team, p.as_of, n.gf, n.ga, n.pts, n.opp,
        row_number() over (partition by p.probe order by n.rn desc) as back
      from probes p join num n on n.team = p.team and n.match_date < p.as_of),
    agg as (select probe, avg(gf) gf, avg(ga) ga, avg(pts) pts, avg(opp) opp, count(*) n
      from found where back <= 5 group by probe)
    select p.probe, round(coalesce(gf, 0), 6) as form_gf, round(coalesce(ga, 0), 6) as form_ga,
      round(coalesce(pts, 0), 6) as form_pts, round(coalesce(opp, 0), 6) as form_opp_elo,
      cast(coalesce(n, 0) as double) as form_n_played
    from probes p left join agg using (probe)"""),
)
def form_asof_join(spark, sf):
    probes = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("probe"),
        F.concat(F.lit("T"), (F.col("c_custkey") % 64).cast("string")).alias("team"),
        F.date_add(F.lit("1994-06-01").cast("date"), (F.col("c_custkey") * 7 % 3000).cast("int"))
        .alias("as_of"),
    )
    df = T.history_asof(view(spark, sf, "tb_matches"), probes, 5)
    form = T.form_aggregates(F.col("history"))
    return df.select("probe", *[F.round(c, 6).alias(n) for n, c in form.items()])


@query(
    "chronological_blocks",
    twin("tb_matches", LONG + """
    counted as (select *, count(*) over (partition by team) as n_matches from num)
    select team, match_id, match_date, opponent, rn as seq, n_matches,
      case when gf > ga then 'won' when gf = ga then 'drew' else 'lost' end as result,
      concat('=== Match ', rn, ' of ', n_matches, ' — vs ', opponent, ' (', match_date,
        '), round unknown, ', team, ' ',
        case when gf > ga then 'won' when gf = ga then 'drew' else 'lost' end, ' ', gf, '-', ga,
        ' ===') as header
    from counted"""),
)
def chronological_blocks(spark, sf):
    return T.chronological_blocks(view(spark, sf, "tb_matches"))


K = """
case when starts_with(tournament, 'FIFA World Cup qualification') then 40.0
     when starts_with(tournament, 'UEFA Euro qualification') then 40.0
     when starts_with(tournament, 'Africa Cup of Nations') then 50.0
     when starts_with(tournament, 'CONCACAF Gold Cup') then 40.0
     when starts_with(tournament, 'FIFA World Cup') then 60.0
     when starts_with(tournament, 'AFC Asian Cup') then 50.0
     when starts_with(tournament, 'Copa America') then 50.0
     when starts_with(tournament, 'UEFA Euro') then 50.0
     when starts_with(tournament, 'Friendly') then 20.0 else 35.0 end
"""


@query(
    "competition_k",
    twin("tb_matches", f"select match_id, cast({K} as double) as k from tb_matches"),
)
def competition_k(spark, sf):
    df = view(spark, sf, "tb_matches")
    return df.select("match_id", M.competition_k(F.col("tournament")).alias("k"))


# All pools advance together, one match per pool and step; the state is two
# lists over a pool's eight teams.  {SRC} marks rows to report.
ELO = f"""
seq as (select match_id, pool, match_date as d, home_team, away_team,
    cast((cast(substring(home_team, 2) as int) - pool) / 8 as int) + 1 as h,
    cast((cast(substring(away_team, 2) as int) - pool) / 8 as int) + 1 as a,
    case when neutral then 0.0 else 100.0 end as bonus, cast({K} as double) as k,
    case when home_score > away_score then 1.0 when home_score = away_score then 0.5 else 0.0 end as s,
    row_number() over (partition by pool order by match_date, match_id) as rn from tb_matches),
walk as (
  select pool, 0::bigint as rn, null::bigint as match_id, 0 as h, 0 as a,
    list_transform(range(8), lambda x: 1500.0::double) as r,
    list_transform(range(8), lambda x: null::date) as last,
    0.0::double as hp, 0.0::double as ap, 0.0::double as hn, 0.0::double as an
  from (select distinct pool from seq)
  union all
  select pool, rn, match_id, h, a,
    list_transform(r, lambda x, i: case when i = h then hn when i = a then an else x end),
    list_transform(last, lambda x, i: case when i = h or i = a then d else x end), hp, ap, hn, an
  from (select *, hp + k * (s - e) as hn, ap + k * ((1 - s) - (1 - e)) as an
    from (select *, 1 / (1 + pow(10.0, (ap - (hp + bonus)) / 400)) as e
      from (select w.pool, q.rn, q.match_id, q.h, q.a, w.r, w.last, q.d, q.bonus, q.k, q.s,
          case when q.d - w.last[q.h] > 365 then w.r[q.h]
               - 0.1 * ((q.d - w.last[q.h]) / 365.0) * (w.r[q.h] - 1500) else w.r[q.h] end as hp,
          case when q.d - w.last[q.a] > 365 then w.r[q.a]
               - 0.1 * ((q.d - w.last[q.a]) / 365.0) * (w.r[q.a] - 1500) else w.r[q.a] end as ap
        from walk w join seq q on q.pool = w.pool and q.rn = w.rn + 1)))),
rated as (select m.*, hp, ap, hn, an from walk w join tb_matches m using (match_id) where w.rn > 0)
"""


@query(
    "elo_ratings",
    twin("tb_matches", ELO + """
    select match_id, round(hp, 6) as elo_home_pre, round(ap, 6) as elo_away_pre from rated""", True),
)
def elo_ratings(spark, sf):
    df = R.rating_scan(view(spark, sf, "tb_matches"))
    return df.select(
        "match_id", F.round("elo_home_pre", 6).alias("elo_home_pre"),
        F.round("elo_away_pre", 6).alias("elo_away_pre"),
    )


@query(
    "current_ratings",
    twin("tb_matches", ELO + """,
    ends as (select home_team as team, match_date, match_id, hn as r from rated
      union all select away_team, match_date, match_id, an from rated)
    select team, round(arg_max(r, struct_pack(d := match_date, m := match_id)), 6) as rating
    from ends group by team""", True),
)
def current_ratings(spark, sf):
    df = R.current_ratings(R.rating_scan(view(spark, sf, "tb_matches")))
    return df.select("team", F.round("rating", 6).alias("rating"))


@query(
    "extend_ratings",
    twin("tb_matches", ELO + """
    select match_id, round(hp, 6) as elo_home_pre, round(ap, 6) as elo_away_pre,
      round(hp - ap, 6) as elo_diff from rated where match_date >= date '2001-01-01'""", True),
)
def extend_ratings(spark, sf):
    matches = view(spark, sf, "tb_matches")
    new = F.col("match_date") >= "2001-01-01"
    df = R.extend_ratings(matches.filter(~new), matches.filter(new))
    return df.select(
        "match_id", *[F.round(c, 6).alias(c) for c in ("elo_home_pre", "elo_away_pre", "elo_diff")]
    )


@query(
    "elo_1x2",
    twin("tb_matches", """
    gap as (select match_id, elo_home_pre + case when neutral then 0 else 100 end - elo_away_pre as g
            from tb_matches),
    p as (select match_id, 0.26 * exp(-(g * g) / 80000.0) as dr, 1 / (1 + pow(10.0, -g / 400.0)) as w
          from gap)
    select match_id, round(w * (1 - dr), 6) as prob_home, round(dr, 6) as prob_draw,
      round((1 - w) * (1 - dr), 6) as prob_away from p"""),
)
def elo_1x2(spark, sf):
    df = R.with_rating_probs(view(spark, sf, "tb_matches"))
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in ("prob_home", "prob_draw", "prob_away")])


@query(
    "rating_rps",
    twin("tb_matches", ELO + """,
    p as (select *, 0.26 * exp(-(pow(hp + case when neutral then 0 else 100 end - ap, 2)) / 80000.0) as dr,
        1 / (1 + pow(10.0, -(hp + case when neutral then 0 else 100 end - ap) / 400.0)) as w from rated),
    s as (select *, (pow(w * (1 - dr) - case when home_score > away_score then 1 else 0 end, 2)
        + pow(w * (1 - dr) + dr - case when home_score >= away_score then 1 else 0 end, 2)) / 2 as rps
      from p)
    select tournament, count(*) as n, round(avg(rps), 6) as mean_rps from s group by tournament""", True),
)
def rating_rps(spark, sf):
    """Flagship: ratings, 1X2 forecast and its score per tournament."""
    df = R.with_rating_probs(R.elo_ratings(view(spark, sf, "tb_matches").drop("elo_home_pre", "elo_away_pre")))
    outcome = M.outcome_class(F.col("home_score"), F.col("away_score"))
    value = M.rps(F.col("prob_home"), F.col("prob_draw"), outcome)
    return df.groupBy("tournament").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_rps")
    )


@query(
    "inactivity_decay",
    twin("tb_matches", """
    days as (select o_custkey as team, cast(o_orderdate as date) as match_date,
      1200 + max(o_totalprice) / 100 as rating from orders group by all),
    gaps as (select *, match_date - lag(match_date) over (partition by team order by match_date) as gap
      from days)
    select team, match_date, gap, round(case when gap > 365
      then rating - 0.1 * (gap / 365.0) * (rating - 1500) else rating end, 6) as decayed
    from gaps where gap is not null"""),
)
def inactivity_decay(spark, sf):
    days = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("team"), F.col("o_orderdate").cast("date").alias("match_date"))
        .agg((1200 + F.max("o_totalprice") / 100).alias("rating"))
    )
    before = F.lag("match_date").over(Window.partitionBy("team").orderBy("match_date"))
    gaps = days.withColumn("gap", F.datediff("match_date", before).cast("bigint"))
    decayed = M.inactivity_decay(F.col("rating"), F.col("gap"))
    return gaps.filter("gap is not null").select(
        "team", "match_date", "gap", F.round(decayed, 6).alias("decayed")
    )


@query(
    "latest_rating_asof",
    twin("tb_matches", """
    ends as (select match_date, match_id, home_team as team, elo_home_pre as r from tb_matches
      union all select match_date, match_id, away_team, elo_away_pre from tb_matches),
    last as (select team, arg_max(r, struct_pack(d := match_date, m := match_id)) as r from ends
             group by team),
    fix as (select s_suppkey as match_id, concat('T', s_suppkey % 70) as h, concat('T', s_nationkey) as a
            from supplier)
    select f.match_id, coalesce(x.r, 1500) as elo_home_pre, coalesce(y.r, 1500) as elo_away_pre
    from fix f left join last x on x.team = f.h left join last y on y.team = f.a"""),
)
def latest_rating_asof(spark, sf):
    matches = view(spark, sf, "tb_matches")
    ends = matches.select(
        "match_date", "match_id",
        F.explode(F.array(
            F.struct(F.col("home_team").alias("team"), F.col("elo_home_pre").alias("rating")),
            F.struct(F.col("away_team").alias("team"), F.col("elo_away_pre").alias("rating")),
        )).alias("s"),
    )
    last = ends.groupBy("s.team").agg(
        F.max_by("s.rating", F.struct("match_date", "match_id")).alias("rating")
    )
    fixtures = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("match_id"),
        F.concat(F.lit("T"), (F.col("s_suppkey") % 70).cast("string")).alias("home_team"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("away_team"),
    )
    df = R.with_latest_rating(fixtures, last)
    return df.select("match_id", "elo_home_pre", "elo_away_pre")
