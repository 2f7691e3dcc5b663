"""Context, squad and score-correction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlab.catalog.registry import query
from matchlab.catalog.timelines import ELO, LONG
from matchlab.catalog.views import table, twin, view
from matchlab.functions import text as X
from matchlab.operators import context as K
from matchlab.operators import folds as D
from matchlab.operators import scores as S
from matchlab.operators import squads as Q
from matchlab.operators import timeline as T
from matchlab.session import durable

# A schedule: one fixture per customer, named by nations, kickoffs in June and July 2026.
SCHEDULE = """
sched as (select c_custkey as match_id,
    case c_nationkey when 0 then 'Mexico' when 1 then 'Canada'
      else concat('T', cast(c_nationkey as varchar(10))) end as home_team,
    concat('T', cast(25 + c_custkey % 30 as varchar(10))) as away_team,
    date '2026-06-11' + cast(c_custkey % 35 as int) as match_date,
    timestamp '2026-06-11 10:00:00' + to_hours(c_custkey % 835) + to_minutes((c_custkey % 4) * 15) as kickoff,
    (c_custkey % 3 = 0) as is_completed,
    cast(c_custkey % 4 as int) as home_score, cast(c_custkey % 3 as int) as away_score,
    case c_mktsegment when 'HOUSEHOLD' then 'Group A - 1' when 'MACHINERY' then 'group'
      when 'FURNITURE' then '' when 'BUILDING' then 'Round of 16' else null end as stage
  from customer)
"""


def schedule(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("match_id"),
        F.when(F.col("c_nationkey") == 0, "Mexico").when(F.col("c_nationkey") == 1, "Canada")
        .otherwise(F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("home_team"),
        F.concat(F.lit("T"), (25 + key % 30).cast("string")).alias("away_team"),
        F.date_add(F.lit("2026-06-11").cast("date"), (key % 35).cast("int")).alias("match_date"),
        (
            F.lit("2026-06-11 10:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(hours=(key % 835).cast("int"), mins=((key % 4) * 15).cast("int"))
        ).alias("kickoff"),
        (key % 3 == 0).alias("is_completed"),
        (key % 4).cast("int").alias("home_score"), (key % 3).cast("int").alias("away_score"),
        F.expr("""case c_mktsegment when 'HOUSEHOLD' then 'Group A - 1' when 'MACHINERY' then 'group'
          when 'FURNITURE' then '' when 'BUILDING' then 'Round of 16' else null end""").alias("stage"),
    )


MAJOR = "('FIFA World Cup', 'UEFA Euro', 'Copa America', 'Africa Cup of Nations', 'AFC Asian Cup', 'CONCACAF Gold Cup')"
WEIGHT = """round(case when tournament = 'Friendly' then 0.2 else 1.0 end
  * pow(0.5, greatest((select max(match_date) from tb_matches) - match_date, 0) / 1095.0), 6)"""


@query(
    "match_context",
    twin("tb_matches", f"""
    select match_id, round(elo_home_pre - elo_away_pre, 6) as elo_diff,
      tournament in {MAJOR} as is_knockout, home_team in ('United States', 'Canada', 'Mexico') as is_host_home,
      away_team in ('United States', 'Canada', 'Mexico') as is_host_away from tb_matches"""),
)
def match_context(spark, sf):
    return K.match_flags(view(spark, sf, "tb_matches")).select(
        "match_id", "elo_diff", "is_knockout", "is_host_home", "is_host_away"
    )


@query("sample_weight", twin("tb_matches", f"select match_id, {WEIGHT} as sample_weight from tb_matches"))
def sample_weight(spark, sf):
    return K.sample_weight(view(spark, sf, "tb_matches")).select(
        "match_id", F.round("sample_weight", 6).alias("sample_weight")
    )


@query(
    "recency_weight_dc",
    twin("tb_matches", """
    select match_id, round(exp(-0.0065 * ((select max(match_date) from tb_matches) - match_date)), 6)
      as weight from tb_matches"""),
)
def recency_weight_dc(spark, sf):
    return K.recency_weight(view(spark, sf, "tb_matches")).select(
        "match_id", F.round("weight", 6).alias("weight")
    )


@query(
    "tournament_window_filter",
    twin("tb_matches", SCHEDULE + """,
    joint as (select match_id, tournament, match_date from tb_matches
      union all select -1 - match_id, 'FIFA World Cup', match_date from sched)
    select match_id, tournament = 'FIFA World Cup' and match_date >= date '2026-06-01' as is_current
    from joint"""),
)
def tournament_window_filter(spark, sf):
    both = view(spark, sf, "tb_matches").select("match_id", "tournament", "match_date").unionByName(
        schedule(spark, sf).select(
            (-1 - F.col("match_id")).alias("match_id"), F.lit("FIFA World Cup").alias("tournament"),
            "match_date",
        )
    )
    return both.select("match_id", K.is_current().alias("is_current"))


@query(
    "drop_current_tournament",
    twin("tb_matches", """
    select tournament, count(*) as n from tb_matches
    where not (tournament = 'FIFA World Cup' and match_date >= date '2026-06-01') group by tournament"""),
)
def drop_current_tournament(spark, sf):
    return K.drop_current(view(spark, sf, "tb_matches")).groupBy("tournament").agg(F.count("*").alias("n"))


STAGE = """case when lower(trim(coalesce(stage, ''))) in ('', 'group') then match_date >= date '2026-06-28'
  when starts_with(lower(trim(stage)), 'group') then false else true end"""


@query(
    "knockout_stage",
    twin("tb_matches", SCHEDULE + f"select match_id, {STAGE} as knockout from sched"),
)
def knockout_stage(spark, sf):
    return schedule(spark, sf).select(
        "match_id", X.knockout_stage(F.col("match_date"), F.col("stage")).alias("knockout")
    )


@query(
    "upcoming_matches",
    twin("tb_matches", SCHEDULE + """,
    open as (select * from sched where not is_completed)
    select match_id, home_team, away_team, kickoff from open
    where kickoff <= (select min(kickoff) from open) + interval 30 minutes"""),
)
def upcoming_matches(spark, sf):
    return K.upcoming_matches(schedule(spark, sf), next_only=True).select(
        "match_id", "home_team", "away_team", "kickoff"
    )


@query(
    "due_notifications",
    twin("tb_matches", SCHEDULE + """
    select match_id, kickoff - interval 60 minutes as fire_at from sched
    where not is_completed and kickoff - interval 60 minutes > timestamp '2026-06-25 00:00:00'"""),
)
def due_notifications(spark, sf):
    now = F.lit("2026-06-25 00:00:00").cast("timestamp_ntz")
    return K.due_notifications(schedule(spark, sf), now).select("match_id", "fire_at")


@query(
    "train_val_split",
    twin("tb_matches", """
    parts as (select *, (select max(match_date) from tb_matches) - interval 6 months as cutoff from tb_matches)
    select case when match_date < cutoff or (tournament = 'FIFA World Cup' and match_date >= date '2026-06-01')
      then 'train' else 'val' end as part, count(*) as n, min(match_date) as first, max(match_date) as last
    from parts group by 1"""),
)
def train_val_split(spark, sf):
    train, val = K.train_val_split(view(spark, sf, "tb_matches"))
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(
        F.count("*").alias("n"), F.min("match_date").alias("first"), F.max("match_date").alias("last")
    )


@query(
    "complement_split",
    twin("tb_matches", """
    select tournament = 'UEFA Euro' and match_date >= date '1999-01-01' as wanted, count(*) as n,
      min(match_date) as first from tb_matches group by 1"""),
)
def complement_split(spark, sf):
    wanted, rest = K.complement_split(view(spark, sf, "tb_matches"), "UEFA Euro", "1999-01-01")
    both = wanted.withColumn("wanted", F.lit(True)).unionByName(rest.withColumn("wanted", F.lit(False)))
    return both.groupBy("wanted").agg(F.count("*").alias("n"), F.min("match_date").alias("first"))


SQUADS = """
squads as (select case pos % 3 when 0 then 'wc2026' when 1 then 'wc2018' else 'euro2016' end
    as tournament_key, * from tb_squads),
career as (select lower(trim(concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')))) as name,
    count(*) as goals from orders where o_orderstatus <> 'P' group by 1),
quality as (select tournament_key, team, avg(case when club in ('BUILDING', 'MACHINERY') then 1.0 else 0.0 end)
    as top5_share, avg(caps) / 100.0 as avg_caps_norm,
    case when sum(caps) > 0 then sum(coalesce(goals, 0)) / sum(caps) else 0.0 end as intl_goals_per_cap
  from squads left join career on name = lower(trim(player_name)) group by 1, 2)
"""


def squads(spark, sf):
    key = F.col("pos") % 3
    return view(spark, sf, "tb_squads").withColumn(
        "tournament_key", F.when(key == 0, "wc2026").when(key == 1, "wc2018").otherwise("euro2016")
    )


def scorer_events(spark, sf):
    """Goals by customer name; an order still in progress plays the own goal."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("scorer"),
        (F.col("o_orderstatus") == "P").alias("own_goal"),
    )


def quality(spark, sf):
    goals = Q.career_goals(scorer_events(spark, sf))
    return Q.squad_quality(squads(spark, sf), goals, top_clubs=("BUILDING", "MACHINERY"))


@query(
    "career_goals",
    twin("tb_goals", """
    select lower(trim(scorer)) as name, count(*) as goals from tb_goals where not own_goal group by 1"""),
)
def career_goals(spark, sf):
    return Q.career_goals(view(spark, sf, "tb_goals"))


@query(
    "squad_quality",
    twin("tb_squads", SQUADS + """
    select tournament_key, team, round(top5_share, 6) as top5_share, round(avg_caps_norm, 6) as avg_caps_norm,
      round(intl_goals_per_cap, 6) as intl_goals_per_cap from quality"""),
)
def squad_quality(spark, sf):
    df = quality(spark, sf)
    return df.select("tournament_key", "team", *[F.round(c, 6).alias(c) for c in Q.FEATURES])


FEATS = ", ".join(
    f"round(coalesce({s[0]}.{f}, 0), 6) as {n}_{s}" for s in ("home", "away") for f, n in Q.FEATURES.items()
)


@query(
    "squad_feature_join",
    twin("tb_matches tb_squads", SQUADS + f""",
    keyed as (select *, case
        when contains(tournament, 'FIFA World Cup') and year(d) = 2026 then 'wc2026'
        when contains(tournament, 'FIFA World Cup') and year(d) = 2022 then 'wc2022'
        when contains(tournament, 'FIFA World Cup') and year(d) = 2018 then 'wc2018'
        when contains(tournament, 'FIFA World Cup') and year(d) = 2014 then 'wc2014'
        when contains(tournament, 'UEFA Euro') and year(d) = 2024 then 'euro2024'
        when contains(tournament, 'UEFA Euro') and year(d) = 2021 then 'euro2021'
        when contains(tournament, 'UEFA Euro') and year(d) = 2016 then 'euro2016' end as k
      from (select *, match_date + interval 20 years as d from tb_matches))
    select match_id, {FEATS} from keyed
    left join quality h on h.tournament_key = k and h.team = home_team
    left join quality a on a.tournament_key = k and a.team = away_team"""),
)
def squad_feature_join(spark, sf):
    # Moved by twenty years so that the listed tournaments fall into the table.
    matches = view(spark, sf, "tb_matches").withColumn(
        "match_date", F.add_months("match_date", 240)
    )
    df = Q.join_squad_features(matches, quality(spark, sf))
    names = [f"{n}_{s}" for s in ("home", "away") for n in Q.FEATURES.values()]
    return df.select("match_id", *[F.round(c, 6).alias(c) for c in names])


LATEST = """
ends as (select match_date, match_id, home_team as team, elo_home_pre as r from tb_matches
  union all select match_date, match_id, away_team, elo_away_pre from tb_matches),
latest as (select team, arg_max(r, struct_pack(d := match_date, m := match_id)) as r from ends group by team)
"""


def latest(spark, sf):
    long = view(spark, sf, "tb_matches").select(
        "match_date", "match_id",
        F.explode(F.array(
            F.struct(F.col("home_team").alias("team"), F.col("elo_home_pre").alias("rating")),
            F.struct(F.col("away_team").alias("team"), F.col("elo_away_pre").alias("rating")),
        )).alias("s"),
    )
    return long.groupBy("s.team").agg(
        F.max_by("s.rating", F.struct("match_date", "match_id")).alias("rating")
    )


@query(
    "upcoming_feature_rows",
    twin("tb_matches tb_squads", SCHEDULE + "," + LATEST + "," + SQUADS + f"""
    select match_id, coalesce(x.r, 1500.0) as elo_home_pre, coalesce(y.r, 1500.0) as elo_away_pre,
      coalesce(x.r, 1500.0) - coalesce(y.r, 1500.0) as elo_diff, 7.0::double as rest_days_home,
      7.0::double as rest_days_away, false as is_knockout, true as neutral,
      home_team in ('United States', 'Canada', 'Mexico') as is_host_home,
      away_team in ('United States', 'Canada', 'Mexico') as is_host_away, {FEATS}
    from sched left join latest x on x.team = home_team left join latest y on y.team = away_team
    left join quality h on h.tournament_key = 'wc2026' and h.team = home_team
    left join quality a on a.tournament_key = 'wc2026' and a.team = away_team
    where not is_completed"""),
)
def upcoming_feature_rows(spark, sf):
    rows = K.upcoming_matches(schedule(spark, sf))
    df = K.upcoming_feature_rows(rows, latest(spark, sf), quality(spark, sf))
    names = [f"{n}_{s}" for s in ("home", "away") for n in Q.FEATURES.values()]
    return df.select(
        "match_id", "elo_home_pre", "elo_away_pre", "elo_diff", "rest_days_home", "rest_days_away",
        "is_knockout", "neutral", "is_host_home", "is_host_away",
        *[F.round(c, 6).alias(c) for c in names],
    )


@query(
    "inject_completed",
    twin("tb_matches", f"""
    done as (select c_custkey as match_id, concat('T', cast(c_custkey % 64 as varchar(10))) as home_team,
      concat('T', cast((c_custkey % 64 + 8) % 64 as varchar(10))) as away_team,
      case when c_custkey % 5 = 0 then date '2026-06-11'
        else date '2026-06-12' + cast(c_custkey % 30 as int) end as match_date,
      case c_mktsegment when 'HOUSEHOLD' then 'Group A - 1' when 'BUILDING' then 'Final' end as stage
      from customer where c_custkey % 3 = 0),
    joint as (select match_date, tournament, neutral, tournament in {MAJOR} as is_knockout, 0 as new
      from tb_matches
      union all select match_date, 'FIFA World Cup', true, {STAGE}, 1 from done)
    select new = 1 as is_new, tournament, count(*) as n, sum(case when is_knockout then 1 else 0 end)::bigint
      as knockouts, sum(case when neutral then 1 else 0 end)::bigint as neutrals, max(match_date) as last
    from joint group by all"""),
)
def inject_completed(spark, sf):
    key = F.col("c_custkey")
    completed = table(spark, sf, "customer").filter(key % 3 == 0).select(
        (10_000_000_000 + key).alias("match_id"),
        F.concat(F.lit("T"), (key % 64).cast("string")).alias("home_team"),
        F.concat(F.lit("T"), ((key % 64 + 8) % 64).cast("string")).alias("away_team"),
        F.when(key % 5 != 0, F.date_add(F.lit("2026-06-12").cast("date"), (key % 30).cast("int")))
        .alias("match_date"),
        (key % 4).cast("int").alias("home_score"), (key % 3).cast("int").alias("away_score"),
        (key % 8).cast("int").alias("pool"),
        F.expr("case c_mktsegment when 'HOUSEHOLD' then 'Group A - 1' when 'BUILDING' then 'Final' end")
        .alias("stage"),
    )
    history = K.match_flags(view(spark, sf, "tb_matches"))
    merged = K.inject_completed(history, completed, pool="pool")
    return merged.groupBy(
        (F.col("match_id") >= 10_000_000_000).alias("is_new"), "tournament"
    ).agg(
        F.count("*").alias("n"), F.count_if("is_knockout").alias("knockouts"),
        F.count_if("neutral").alias("neutrals"), F.max("match_date").alias("last"),
    )


@query(
    "chronological_sort",
    twin("tb_matches", """
    select match_id, match_date, row_number() over (order by match_date, match_id) - 1 as place
    from tb_matches"""),
)
def chronological_sort(spark, sf):
    """Every row's place in the sorted table, read off the written parts of the sort."""
    ordered = K.chronological(view(spark, sf, "tb_matches")).select("match_id", "match_date")
    at = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    # One row for each part of the sort.
    sizes = at.groupBy(part).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = at.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.select("match_id", "match_date", (F.col("_before") + within).alias("place"))


LATE = """
late as (select match_date, home_team, away_team,
    sum(case when goal_minute <= 90 and team = home_team then 1 else 0 end)::int as rh,
    sum(case when goal_minute <= 90 and team = away_team then 1 else 0 end)::int as ra,
    max(goal_minute) as last_minute from tb_goals group by 1, 2, 3)
"""


@query(
    "regulation_goals",
    twin("tb_goals", LATE + """
    select match_date, home_team, away_team, rh as reg_home, ra as reg_away, last_minute from late"""),
)
def regulation_goals(spark, sf):
    return S.regulation_goals(view(spark, sf, "tb_goals"))


@query(
    "extra_time_correction",
    twin("tb_goals", LATE + """
    select match_id, case when last_minute > 90 then rh else home_score end as home_score,
      case when last_minute > 90 then ra else away_score end as away_score,
      coalesce(last_minute > 90, false) as corrected,
      coalesce(last_minute > 90 and rh <> ra, false) as non_draw
    from tb_matches left join late using (match_date, home_team, away_team)"""),
)
def extra_time_correction(spark, sf):
    df = S.extra_time_correction(view(spark, sf, "tb_matches"), view(spark, sf, "tb_goals"))
    return df.select("match_id", "home_score", "away_score", "corrected", "non_draw")


@query(
    "completed_match_lookup",
    twin("tb_matches", LONG + """
    x as (select 1)
    select n_name as nation, match_id, match_date from nation
    join pts on team = concat('T', cast(n_nationkey as varchar(10)))"""),
)
def completed_match_lookup(spark, sf):
    long = T.team_long_form(view(spark, sf, "tb_matches"))
    asked = table(spark, sf, "nation").select(
        F.col("n_name").alias("nation"),
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team"),
    )
    return long.join(asked, "team").select("nation", "match_id", "match_date")


@query(
    "all_teams",
    twin("tb_matches", "select home_team as team from tb_matches union select away_team from tb_matches"),
)
def all_teams(spark, sf):
    return D.all_teams(view(spark, sf, "tb_matches"))


@query(
    "derive_context",
    twin("tb_matches", ELO + "," + LONG + f"""
    gaps as (select n.team, n.match_id,
        cast(n.match_date - lag(n.match_date) over (partition by n.team order by n.rn) as double) as rest
      from num n)
    select m.match_id, round(hp, 6) as elo_home_pre, round(hp - ap, 6) as elo_diff, h.rest as rest_days_home,
      a.rest as rest_days_away, tournament in {MAJOR} as is_knockout, {WEIGHT} as sample_weight
    from rated m join gaps h on h.match_id = m.match_id and h.team = m.home_team
    join gaps a on a.match_id = m.match_id and a.team = m.away_team""", True),
)
def derive_context(spark, sf):
    from matchlab.operators.ratings import elo_ratings

    matches = view(spark, sf, "tb_matches").drop("elo_home_pre", "elo_away_pre")
    df = K.derive_context(elo_ratings(matches))
    return df.select(
        "match_id", F.round("elo_home_pre", 6).alias("elo_home_pre"),
        F.round("elo_diff", 6).alias("elo_diff"), "rest_days_home", "rest_days_away", "is_knockout",
        F.round("sample_weight", 6).alias("sample_weight"),
    )


STATS = """
standard as (select c_name as player_name, c_mktsegment as club, c_custkey as pos,
    case c_nationkey % 4 when 0 then 'La Liga' when 1 then 'Serie A' when 2 then 'Eredivisie' end as league,
    cast(c_custkey % 90 as double) * 30 as minutes, cast(c_custkey % 7 as double) as goals,
    cast(c_custkey % 5 as double) as assists from customer),
shooting as (select c_name as player_name, c_mktsegment as club, cast(count(*) as double) / 4 as xg,
    cast(count(*) as double) / 5 as npxg, sum(o_totalprice) / 1000000 as xa
  from orders join customer on c_custkey = o_custkey group by 1, 2),
stats as (select s.*, coalesce(xg, 0) as xg, coalesce(npxg, 0) as npxg, coalesce(xa, 0) as xa,
    greatest(minutes, 1) / 90 as nineties from standard s left join shooting using (player_name, club))
"""


def player_stats(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    standard = c.select(
        F.col("c_name").alias("player_name"), F.col("c_mktsegment").alias("club"), key.alias("pos"),
        F.expr("case c_nationkey % 4 when 0 then 'La Liga' when 1 then 'Serie A' when 2 then 'Eredivisie' end")
        .alias("league"),
        ((key % 90).cast("double") * 30).alias("minutes"), (key % 7).cast("double").alias("goals"),
        (key % 5).cast("double").alias("assists"),
    )
    shooting = (
        table(spark, sf, "orders")
        .join(c, F.col("o_custkey") == key)
        .groupBy(F.col("c_name").alias("player_name"), F.col("c_mktsegment").alias("club"))
        .agg(
            (F.count("*") / 4.0).alias("xg"), (F.count("*") / 5.0).alias("npxg"),
            (F.sum("o_totalprice") / 1000000).alias("xa"), F.lit(0).alias("pos"),
        )
    )
    # Every player is listed twice: the second row must not count.
    twice = standard.unionByName(standard.withColumns({"pos": key_after("pos"), "minutes": F.lit(1.0)}))
    return Q.player_stats_merge(twice, shooting)


def key_after(name):
    return F.col(name) + 1_000_000_000


@query(
    "player_stats_merge",
    twin("tb_squads", STATS + """
    select player_name, club, league, minutes, goals, assists, round(xg, 6) as xg, round(npxg, 6) as npxg,
      round(xa, 6) as xa, round(xg / nineties, 6) as xg_per90, round(xa / nineties, 6) as xa_per90,
      round(npxg / nineties, 6) as npxg_per90 from stats"""),
)
def player_stats_merge(spark, sf):
    df = player_stats(spark, sf)
    rounded = ["xg", "npxg", "xa", "xg_per90", "xa_per90", "npxg_per90"]
    return df.select(
        "player_name", "club", "league", "minutes", "goals", "assists",
        *[F.round(c, 6).alias(c) for c in rounded],
    )


JOINED = STATS + """,
roster as (select *, case when pos % 4 = 0 then concat('Guest ', player_name) else upper(player_name) end
    as listed from tb_squads),
joined as (select r.team, r.listed as player_name, r.club, s.league, s.minutes,
    s.xg / s.nineties as xg_per90, s.xa / s.nineties as xa_per90, s.npxg / s.nineties as npxg_per90,
    s.player_name is not null as matched
  from roster r left join stats s on lower(s.player_name) = lower(r.listed))
"""


def roster_stats(spark, sf):
    listed = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Guest "), "player_name")).otherwise(
        F.upper("player_name")
    )
    roster = view(spark, sf, "tb_squads").withColumn("player_name", listed)
    stats = player_stats(spark, sf).withColumn("pos", F.lit(0))
    return Q.squad_stats_join(roster.select("team", "player_name", "club"), stats)


@query(
    "squad_stats_join",
    twin("tb_squads", JOINED + """
    select team, player_name, club, league, minutes, round(xg_per90, 6) as xg_per90,
      round(xa_per90, 6) as xa_per90, round(npxg_per90, 6) as npxg_per90, matched from joined"""),
)
def squad_stats_join(spark, sf):
    df = roster_stats(spark, sf)
    rounded = ["xg_per90", "xa_per90", "npxg_per90"]
    return df.select(
        "team", "player_name", "club", "league", "minutes", "matched",
        *[F.round(c, 6).alias(c) for c in rounded],
    )


@query(
    "squad_weighted_stats",
    twin("tb_squads", JOINED + """
    select team,
      round(case when sum(case when matched then minutes end) <> 0 then
        sum(xg_per90 * minutes) / sum(case when matched then minutes end) else 0 end, 6) as squad_xg_per90,
      round(case when sum(case when matched then minutes end) <> 0 then
        sum(xa_per90 * minutes) / sum(case when matched then minutes end) else 0 end, 6) as squad_xa_per90,
      round(case when sum(case when matched then minutes end) <> 0 then
        sum(npxg_per90 * minutes) / sum(case when matched then minutes end) else 0 end, 6) as squad_npxg_per90,
      0.0::double as squad_market_value,
      round(case when count(league) > 0 then sum(case when league in ('La Liga', 'Serie A') then 1 else 0 end)
        else sum(case when club in ('La Liga', 'Serie A') then 1 else 0 end) end / count(*), 6)
        as top5_league_share,
      sum(case when matched then 1 else 0 end)::bigint as n_matched, count(*) as n_squad
    from joined group by team"""),
)
def squad_weighted_stats(spark, sf):
    df = Q.squad_weighted_stats(roster_stats(spark, sf))
    rounded = ["squad_xg_per90", "squad_xa_per90", "squad_npxg_per90", "top5_league_share"]
    return df.select(
        "team", "squad_market_value", "n_matched", "n_squad", *[F.round(c, 6).alias(c) for c in rounded]
    )


@query(
    "injury_loss",
    twin("tb_squads", """
    absent as (select team, player_name, caps from tb_squads where pos % 7 = 0)
    select s.team, round(least(1, case when sum(s.caps) > 0 then coalesce(max(a.caps), 0) / sum(s.caps)
      else coalesce(max(a.n), 0) / count(*) end), 6) as loss
    from tb_squads s left join (select team, sum(caps) as caps, count(*) as n from absent group by team) a
      on a.team = s.team group by s.team"""),
)
def injury_loss(spark, sf):
    squad = view(spark, sf, "tb_squads")
    # Each absent player is reported twice; caps count once.
    absent = squad.filter(F.col("pos") % 7 == 0).select("team", "player_name")
    df = Q.injury_loss(absent.unionByName(absent), squad)
    return df.select("team", F.round("loss", 6).alias("loss"))


@query(
    "absence_list",
    twin("tb_squads", """
    select team, row_number() over (partition by team order by pos) - 1 as place, player_name
    from tb_squads where caps % 5 = 0"""),
)
def absence_list(spark, sf):
    absent = view(spark, sf, "tb_squads").filter(F.col("caps") % 5 == 0)
    return Q.absence_list(absent.select("team", "player_name", "pos"))
