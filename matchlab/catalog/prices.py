"""Price, bet and adjustment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.grids import CELLS, MARKETS, scored
from matchlab.catalog.registry import query
from matchlab.catalog.views import table, twin, view
from matchlab.functions import adjust as A
from matchlab.functions import metrics as M
from matchlab.functions import text as X
from matchlab.operators import bets as B
from matchlab.operators import odds as O
from matchlab.operators import signals as S

ODDS = """
odds as (select match_id, max(price_home) as odds_home, max(price_draw) as odds_draw,
  max(price_away) as odds_away from tb_quotes group by match_id)
"""


@query("best_quotes", twin("tb_quotes", ODDS + "select * from odds"))
def best_quotes(spark, sf):
    return O.best_quotes(view(spark, sf, "tb_quotes"))


@query(
    "remove_margin",
    twin("tb_quotes", ODDS + """
    select match_id, round((1 / odds_home) / (1 / odds_home + 1 / odds_draw + 1 / odds_away), 6) as home,
      round((1 / odds_draw) / (1 / odds_home + 1 / odds_draw + 1 / odds_away), 6) as draw,
      round((1 / odds_away) / (1 / odds_home + 1 / odds_draw + 1 / odds_away), 6) as away from odds"""),
)
def remove_margin(spark, sf):
    fair = M.remove_margin(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    df = O.best_quotes(view(spark, sf, "tb_quotes")).select("match_id", fair.alias("f"))
    return df.select("match_id", *[F.round(f"f.{o}", 6).alias(o) for o in B.OUTCOMES])


BETS = CELLS + MARKETS + "," + ODDS + """,
fair as (select m.match_id, home_score, away_score, home_win, draw, away_win, odds_home, odds_draw, odds_away,
    (1 / odds_home) / (1 / odds_home + 1 / odds_draw + 1 / odds_away) as mh,
    (1 / odds_draw) / (1 / odds_home + 1 / odds_draw + 1 / odds_away) as md,
    (1 / odds_away) / (1 / odds_home + 1 / odds_draw + 1 / odds_away) as ma, match_date, tournament
  from tb_matches m join markets using (match_id) left join odds using (match_id)),
edges as (select *, round(home_win - mh, 9) as eh, round(draw - md, 9) as ed, round(away_win - ma, 9) as ea
  from fair),
best as (select *, case when mh is null then null when eh >= ed and eh >= ea then 'home'
    when ed >= ea then 'draw' else 'away' end as pick from edges),
chosen as (select *, case pick when 'home' then home_win - mh when 'draw' then draw - md
    when 'away' then away_win - ma end as edge,
    case pick when 'home' then mh when 'draw' then md when 'away' then ma end as prob,
    case pick when 'home' then odds_home when 'draw' then odds_draw when 'away' then odds_away end as price,
    case when home_score > away_score then 'home' when home_score = away_score then 'draw' else 'away' end
      as result from best),
flagged as (select *, coalesce(edge >= 0.02 and prob >= 0.08 and edge / prob >= 0.20, false) as is_value
  from chosen),
staked as (select *, 0.25 * edge / price as stake, result = pick as won from flagged)
"""
VIEWS = "tb_matches tb_params tb_quotes"


def priced(spark, sf):
    """Matches with model and best market prices; unpriced matches have null prices."""
    odds = O.best_quotes(view(spark, sf, "tb_quotes"))
    return scored(spark, sf).join(odds, "match_id", "left")


@query(
    "select_value_bet",
    twin(VIEWS, BETS + """
    select match_id, pick as best_edge_outcome, round(edge, 6) as best_edge,
      round(prob, 6) as best_market_prob, is_value from staked"""),
)
def select_value_bet(spark, sf):
    df = B.with_selection(priced(spark, sf).drop("grid"))
    return df.select(
        "match_id", "best_edge_outcome", F.round("best_edge", 6).alias("best_edge"),
        F.round("best_market_prob", 6).alias("best_market_prob"), "is_value",
    )


@query(
    "value_bets",
    twin(VIEWS, BETS + """
    select match_id, pick as best_edge_outcome, round(stake, 6) as kelly_stake, won as outcome_won,
      round(case when won then price - 1 else -1 end, 6) as flat_return,
      round(case when won then stake * (price - 1) else -stake end, 6) as kelly_return
    from staked where is_value"""),
)
def value_bets(spark, sf):
    df = B.value_bets(priced(spark, sf).drop("grid"))
    return df.select(
        "match_id", "best_edge_outcome", F.round("kelly_stake", 6).alias("kelly_stake"), "outcome_won",
        F.round("flat_return", 6).alias("flat_return"), F.round("kelly_return", 6).alias("kelly_return"),
    )


@query(
    "expected_value_pct",
    twin(VIEWS, BETS + """
    select match_id, round(edge / prob * 100, 5) as ev_pct,
      round(case when is_value and price > 1 then stake else 0 end, 6) as kelly_stake
    from staked where pick is not null"""),
)
def expected_value_pct(spark, sf):
    df = B.live_bets(priced(spark, sf).drop("grid")).filter("best_edge_outcome is not null")
    return df.select(
        "match_id", F.round("ev_pct", 5).alias("ev_pct"), F.round("kelly_stake", 6).alias("kelly_stake")
    )


@query(
    "global_topk",
    twin(VIEWS, BETS + """
    select match_id, pick as best_edge_outcome, round(edge, 6) as best_edge from staked where is_value
    order by round(edge, 9) desc, match_id limit 25"""),
)
def global_topk(spark, sf):
    df = B.best_edges(B.with_selection(priced(spark, sf).drop("grid")).filter("is_value"), 25)
    return df.select("match_id", "best_edge_outcome", F.round("best_edge", 6).alias("best_edge"))


LISTED = """
listed as (select case when o_orderkey % 2 = 0 then home_team else away_team end as home_team,
    case when o_orderkey % 2 = 0 then away_team else home_team end as away_team, match_id as pos,
    1.5 + match_id % 40 / 10.0 as odds_home, 3.0 + match_id % 7 / 10.0 as odds_draw,
    1.4 + match_id % 50 / 10.0 as odds_away, (match_id % 5) / 4.0 as line
  from tb_matches join orders on o_orderkey = match_id),
straight as (select home_team, away_team, max(pos) as pos from listed group by 1, 2)
"""


def listed(spark, sf):
    m = view(spark, sf, "tb_matches")
    even = F.col("match_id") % 2 == 0
    ident = F.col("match_id")
    line = (ident % 5) / 4.0
    return m.select(
        F.when(even, F.col("home_team")).otherwise(F.col("away_team")).alias("home_team"),
        F.when(even, F.col("away_team")).otherwise(F.col("home_team")).alias("away_team"),
        ident.alias("pos"), (1.5 + ident % 40 / 10.0).alias("odds_home"),
        (3.0 + ident % 7 / 10.0).alias("odds_draw"), (1.4 + ident % 50 / 10.0).alias("odds_away"),
        F.array(
            F.struct(
                (-line).alias("home_handicap"), F.lit(1.9).alias("home_odds"),
                line.alias("away_handicap"), F.lit(2.0).alias("away_odds"),
            )
        ).alias("spreads"),
    )


@query(
    "odds_join_swapped",
    twin("tb_matches", LISTED + """,
    best as (select l.* from listed l join straight using (home_team, away_team, pos))
    select m.match_id, coalesce(s.odds_home, r.odds_away) as odds_home,
      coalesce(s.odds_draw, r.odds_draw) as odds_draw, coalesce(s.odds_away, r.odds_home) as odds_away,
      case when s.pos is not null then -s.line when r.pos is not null then -r.line end as home_handicap,
      case when s.pos is not null then 1.9 when r.pos is not null then 2.0 end::double as home_spread_odds,
      s.pos is null and r.pos is not null as is_swapped
    from tb_matches m left join best s on s.home_team = m.home_team and s.away_team = m.away_team
    left join best r on r.home_team = m.away_team and r.away_team = m.home_team"""),
)
def odds_join_swapped(spark, sf):
    matches = view(spark, sf, "tb_matches").select("match_id", "home_team", "away_team")
    df = O.odds_join_swapped(matches, listed(spark, sf))
    return df.select(
        "match_id", "odds_home", "odds_draw", "odds_away",
        (F.col("spreads")[0]["home_handicap"] + 0.0).alias("home_handicap"),
        F.col("spreads")[0]["home_odds"].alias("home_spread_odds"), "is_swapped",
    )


@query(
    "odds_for_pair",
    twin("tb_matches", LISTED + """,
    first as (select home_team, away_team, min(pos) as pos from listed group by 1, 2),
    best as (select l.* from listed l join first using (home_team, away_team, pos))
    select match_id, odds_home, odds_draw, odds_away from tb_matches m
    left join best b on b.home_team = m.home_team and b.away_team = m.away_team"""),
)
def odds_for_pair(spark, sf):
    # The feed writes names in its own way; the key sees through it.
    feed = listed(spark, sf).withColumns(
        {
            "home_team": F.concat(F.lit(" "), F.lower("home_team"), F.lit(".")),
            "away_team": F.concat(F.upper("away_team"), F.lit("'  ")),
        }
    )
    matches = view(spark, sf, "tb_matches").select("match_id", "home_team", "away_team")
    return O.odds_for_pair(matches, feed).drop("home_team", "away_team")


@query(
    "odds_name_key",
    twin("tb_matches", r"""
    raw as (select p_partkey, concat(p_name, ' & ', p_brand, '  (', p_type, ')') as name from part)
    select p_partkey, trim(regexp_replace(regexp_replace(replace(lower(name), '&', 'and'), '[^\w\s]', '', 'g'),
      '\s+', ' ', 'g')) as key from raw"""),
)
def odds_name_key(spark, sf):
    name = F.concat(
        "p_name", F.lit(" & "), "p_brand", F.lit("  ("), "p_type", F.lit(")")
    )
    return table(spark, sf, "part").select("p_partkey", X.odds_name_key(name).alias("key"))


@query(
    "latest_per_key",
    twin("tb_ticks", """
    select match_no, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id,
      arg_max(price, struct_pack(t := ts, e := event_id)) as price from tb_ticks group by 1, 2"""),
)
def latest_per_key(spark, sf):
    # event_id breaks ties of ts; it is part of the kept row.
    ticks = view(spark, sf, "tb_ticks").withColumn("pos", F.col("event_id"))
    df = O.latest_per_key(ticks, ["match_no", "event_type"], ["ts", "pos"])
    return df.select("match_no", "event_type", "event_id", "price")


@query(
    "odds_snapshot_upsert",
    twin("tb_matches", LISTED + """,
    rows as (select lower(home_team) as home_key, lower(away_team) as away_key,
      case when pos % 3 = 0 then 1 else 0 end as batch_ts, pos, odds_home, odds_away from listed)
    select home_key, away_key, arg_max(pos, struct_pack(b := batch_ts, p := pos)) as pos,
      arg_max(odds_home, struct_pack(b := batch_ts, p := pos)) as odds_home,
      arg_max(odds_away, struct_pack(b := batch_ts, p := pos)) as odds_away from rows group by 1, 2"""),
)
def odds_snapshot_upsert(spark, sf):
    rows = listed(spark, sf).drop("spreads")
    newer = F.col("pos") % 3 == 0
    snapshot = rows.filter(~newer).withColumn("batch_ts", F.lit(0))
    batch = rows.filter(newer).withColumn("batch_ts", F.lit(1))
    df = O.snapshot_upsert(snapshot, batch)
    return df.select("home_key", "away_key", "pos", "odds_home", "odds_away")


@query(
    "fresh_cache_filter",
    twin("tb_ticks", """
    select event_id, match_no, price from tb_ticks
    where ts >= (select max(ts) from tb_ticks) - interval 15 minutes"""),
)
def fresh_cache_filter(spark, sf):
    ticks = view(spark, sf, "tb_ticks").withColumn("fetched_at", F.col("ts"))
    now = ticks.select(F.max("ts")).scalar()
    return O.fresh_only(ticks, now).select("event_id", "match_no", "price")


SIGNALS = """
losses as (select concat('T', cast(n_nationkey as varchar(10))) as team, n_nationkey / 30.0 as loss from nation),
sent as (select concat('T', cast(s_suppkey % 64 as varchar(10))) as team,
    max(round(s_acctbal / 5000 - 1, 6)) as score, max(s_nationkey / 25.0) as conf from supplier group by 1),
traj as (select concat('T', cast(c_custkey % 64 as varchar(10))) as team,
    max(round(c_acctbal / 5000 - 1, 6)) as score, min(c_nationkey / 25.0 + 0.2) as conf
  from customer group by 1)
"""


def signal_tables(spark, sf):
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team"),
        (F.col("n_nationkey") / 30.0).alias("loss"),
    )
    sentiment = (
        table(spark, sf, "supplier")
        .groupBy(F.concat(F.lit("T"), (F.col("s_suppkey") % 64).cast("string")).alias("team"))
        .agg(
            F.max(F.round(F.col("s_acctbal") / 5000 - 1, 6)).alias("form_score"),
            F.max(F.col("s_nationkey") / 25.0).alias("confidence"),
        )
    )
    trajectory = (
        table(spark, sf, "customer")
        .groupBy(F.concat(F.lit("T"), (F.col("c_custkey") % 64).cast("string")).alias("team"))
        .agg(
            F.max(F.round(F.col("c_acctbal") / 5000 - 1, 6)).alias("form_score"),
            F.min(F.col("c_nationkey") / 25.0 + 0.2).alias("confidence"),
        )
    )
    return nation, sentiment, trajectory


def _factor(side: str) -> str:
    return f"""greatest(greatest(greatest(lambda_{side} * (1 - 0.5 * coalesce(l{side[0]}.loss, 0)), 0.01)
      * case when s{side[0]}.conf >= 0.25 then greatest(0.70, least(1.30, 1 + 0.30 * s{side[0]}.score * s{side[0]}.conf))
        else 1 end, 0.01)
      * case when t{side[0]}.conf >= 0.25 then greatest(0.85, least(1.15, 1 + 0.15 * t{side[0]}.score)) else 1 end,
      0.01)"""


CHAIN = SIGNALS + f""",
adjusted as (select p.match_id, rho, {_factor('home')} as lambda_home, {_factor('away')} as lambda_away
  from tb_params p join tb_matches m using (match_id)
  left join losses lh on lh.team = home_team left join losses la on la.team = away_team
  left join sent sh on sh.team = home_team left join sent sa on sa.team = away_team
  left join traj th on th.team = home_team left join traj ta on ta.team = away_team)
"""


def params(spark, sf):
    return view(spark, sf, "tb_params").join(
        view(spark, sf, "tb_matches").select("match_id", "home_team", "away_team"), "match_id"
    )


@query(
    "adjustment_chain",
    twin("tb_matches tb_params", CHAIN + "," + (CELLS + MARKETS).replace("tb_params p", "adjusted p") + """
    select match_id, round(lambda_home, 6) as lambda_home, round(lambda_away, 6) as lambda_away,
      round(home_win, 6) as prob_home, round(draw, 6) as prob_draw, round(over_2_5, 6) as over_2_5,
      round(expected_home, 6) as expected_home
    from adjusted join markets using (match_id)"""),
)
def adjustment_chain(spark, sf):
    df = S.adjustment_chain(params(spark, sf), *signal_tables(spark, sf))
    df = df.withColumn("over_2_5", F.col("markets.over_2_5"))
    names = ["lambda_home", "lambda_away", "prob_home", "prob_draw", "over_2_5", "expected_home"]
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    "injury_adjust",
    twin("tb_matches tb_params", SIGNALS + """
    select p.match_id, round(greatest(lambda_home * (1 - 0.5 * coalesce(loss, 0)), 0.01), 6) as lambda_home
    from tb_params p join tb_matches using (match_id) left join losses on team = home_team"""),
)
def injury_adjust(spark, sf):
    losses, _, _ = signal_tables(spark, sf)
    df = params(spark, sf).join(losses.withColumnRenamed("team", "home_team"), "home_team", "left")
    rate = A.injury_adjust(F.col("lambda_home"), F.col("loss"))
    return df.select("match_id", F.round(rate, 6).alias("lambda_home"))


@query(
    "sentiment_adjust",
    twin("tb_matches", SIGNALS + """
    select team, round(case when conf < 0.25 then 1 else greatest(0.70, least(1.30, 1 + 0.30 * score * conf)) end, 6)
      as factor from sent"""),
)
def sentiment_adjust(spark, sf):
    _, sentiment, _ = signal_tables(spark, sf)
    factor = A.sentiment_factor(F.col("form_score"), F.col("confidence"))
    return sentiment.select("team", F.round(factor, 6).alias("factor"))


@query(
    "trajectory_adjust",
    twin("tb_matches", SIGNALS + """
    select team, round(case when conf < 0.25 then 1 else greatest(0.85, least(1.15, 1 + 0.15 * score)) end, 6)
      as factor from traj"""),
)
def trajectory_adjust(spark, sf):
    _, _, trajectory = signal_tables(spark, sf)
    factor = A.trajectory_factor(F.col("form_score"), F.col("confidence"))
    return trajectory.select("team", F.round(factor, 6).alias("factor"))
