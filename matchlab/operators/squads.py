"""Squad quality, player statistics and absence losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.text import nfc_name_key

FEATURES = {"top5_share": "squad_top5", "avg_caps_norm": "squad_caps", "intl_goals_per_cap": "squad_goals"}


def career_goals(goals: DataFrame) -> DataFrame:
    """(name, goals): goals per scorer, own goals left out."""
    kept = goals.filter(~F.col("own_goal"))
    # Count by raw spelling first: the name key is then built once per spelling.
    spelled = kept.groupBy("scorer").agg(F.count("*").alias("n"))
    key = nfc_name_key(F.col("scorer"))
    return spelled.groupBy(key.alias("name")).agg(F.sum("n").alias("goals"))


def squad_quality(
    squads: DataFrame,
    goals: DataFrame,
    top_clubs: tuple[str, ...] = C.TOP_LEAGUE_CLUBS,
    keys: tuple[str, ...] = ("tournament_key", "team"),
) -> DataFrame:
    """Per squad: top5_share, avg_caps_norm, intl_goals_per_cap."""
    key = nfc_name_key(F.col("player_name"), strip_notes=True)
    caps = F.coalesce(F.col("caps").cast("double"), F.lit(0.0))
    rows = squads.withColumn("_name", key).join(
        goals.withColumnsRenamed({"name": "_name", "goals": "_goals"}), "_name", "left"
    )
    total = F.sum(caps)
    scored = F.sum(F.coalesce("_goals", F.lit(0)))
    return rows.groupBy(*keys).agg(
        F.avg(F.coalesce(F.col("club").isin(*top_clubs), F.lit(False)).cast("double")).alias("top5_share"),
        (F.avg(caps) / 100.0).alias("avg_caps_norm"),
        F.when(total > 0, scored / total).otherwise(0.0).alias("intl_goals_per_cap"),
    )


def tournament_key(tournament: Column, year: Column) -> Column:
    """Squad list of a match: name fragment and year, first listed entry wins; else null."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for fragment, listed, key in C.SQUAD_TOURNAMENTS:
        chain = chain.when(tournament.contains(fragment) & (year == listed), key)
    return chain


def join_squad_features(
    matches: DataFrame, features: DataFrame | None, year: int | None = None
) -> DataFrame:
    """Add squad_{top5,caps,goals}_{home,away}; 0.0 where the squad is unknown."""
    names = [f"{short}_{side}" for side in ("home", "away") for short in FEATURES.values()]
    if features is None:
        return matches.withColumns({n: F.lit(0.0) for n in names})
    when = F.year("match_date") if year is None else F.lit(year)
    out = matches.withColumn("tournament_key", tournament_key(F.col("tournament"), when))
    for side in ("home", "away"):
        lookup = features.select(
            "tournament_key", F.col("team").alias(f"{side}_team"),
            *[F.col(f).alias(f"{short}_{side}") for f, short in FEATURES.items()],
        )
        out = out.join(lookup, ["tournament_key", f"{side}_team"], "left")
    return out.fillna(0.0, names).drop("tournament_key")


def player_stats_merge(standard: DataFrame, shooting: DataFrame) -> DataFrame:
    """Standard stats with shooting stats; per-90 rates; first row per player and club.

    ``standard`` carries ``pos``, its order.  The reduction to first rows comes
    before the join, where it is a map-side aggregate.
    """
    keys = ["player_name", "club"]

    def first(df: DataFrame, columns: list[str]) -> DataFrame:
        row = F.struct(*columns)
        return df.groupBy(*keys).agg(F.min_by(row, "pos").alias("r")).select(*keys, "r.*")

    left = first(standard, ["league", "minutes", "goals", "assists"])
    right = first(shooting, ["xg", "npxg", "xa"])
    joined = left.join(right, keys, "left").fillna(0.0, ["xg", "npxg", "xa"])
    nineties = F.greatest("minutes", F.lit(1.0)) / 90.0
    return joined.withColumns({f"{c}_per90": F.col(c) / nineties for c in ("xg", "xa", "npxg")})


def squad_stats_join(squads: DataFrame, stats: DataFrame) -> DataFrame:
    """Roster rows with the first statistics row of the same name key (left join)."""
    keyed = stats.withColumn("_key", nfc_name_key(F.col("player_name")))
    columns = ["league", "minutes", "xg_per90", "xa_per90", "npxg_per90"]
    first = keyed.groupBy("_key").agg(
        F.min_by(F.struct(*columns, F.lit(True).alias("matched")), "pos").alias("stat")
    )
    roster = squads.withColumn("_key", nfc_name_key(F.col("player_name")))
    return roster.join(first, "_key", "left").select(
        *squads.columns, *[F.col(f"stat.{c}").alias(c) for c in columns],
        F.coalesce("stat.matched", F.lit(False)).alias("matched"),
    )


def squad_weighted_stats(joined: DataFrame) -> DataFrame:
    """Per team: minutes-weighted rates of matched players and the top-league share."""
    weight = F.when(F.col("matched"), F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)))
    total = F.sum(weight)

    def mean(name: str) -> Column:
        value = F.sum(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight)
        return F.when(total != 0, value / total).otherwise(0.0).alias(f"squad_{name}")

    leagues = F.count(F.when(F.col("matched"), F.col("league")))
    in_league = F.count_if(F.col("matched") & F.col("league").isin(*C.TOP_LEAGUES))
    country = F.col("club_country") if "club_country" in joined.columns else F.lit("")
    in_club = F.count_if(F.col("club").isin(*C.TOP_LEAGUES) | country.isin(*C.TOP_LEAGUES))
    return joined.groupBy("team").agg(
        mean("xg_per90"), mean("xa_per90"), mean("npxg_per90"),
        F.lit(0.0).alias("squad_market_value"),
        (F.when(leagues > 0, in_league).otherwise(in_club) / F.count("*")).alias("top5_league_share"),
        F.count_if("matched").alias("n_matched"),
        F.count("*").alias("n_squad"),
    )


def injury_loss(matched: DataFrame, squads: DataFrame) -> DataFrame:
    """(team, loss): caps-weighted share of the squad that is absent, in [0, 1].

    ``matched`` holds one row per absent name with the squad ``player_name`` it
    was matched to (null if none).  Without any caps the share is by headcount,
    where repeated names count again.
    """
    caps = F.coalesce(F.col("caps").cast("double"), F.lit(0.0))
    size = squads.groupBy("team").agg(F.sum(caps).alias("_total"), F.count("*").alias("_n"))
    # First roster row of a name carries its caps.
    roster = squads.groupBy("team", "player_name").agg(F.min_by(caps, "pos").alias("_caps"))
    hits = (
        matched.filter("player_name is not null")
        .groupBy("team", "player_name")
        .agg(F.count("*").alias("_hits"))
        .join(roster, ["team", "player_name"])
        .groupBy("team")
        .agg(F.sum("_caps").alias("_absent"), F.sum("_hits").alias("_hits"))
    )
    share = F.when(F.col("_total") > 0, F.col("_absent") / F.col("_total")).otherwise(
        F.col("_hits") / F.col("_n")
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))
    return size.join(hits, "team", "left").select("team", bounded.alias("loss"))


NUMBERING_STRETCH = 4096


def absence_list(absent: DataFrame) -> DataFrame:
    """(team, place, player_name): absent players per team in feed order from 0, each once.

    A place is the count of the team's players in earlier stretches of the feed plus
    the rank within the stretch, so no sort holds more than one stretch of a team;
    the places do not depend on the stretches.
    """
    first = absent.groupBy("team", "player_name").agg(F.min("pos").alias("pos"))
    rows = first.withColumn("_stretch", F.floor(F.col("pos") / NUMBERING_STRETCH))
    earlier = Window.partitionBy("team").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("team", "_stretch").agg(F.count("*").alias("_n"))
    before = counts.select(
        "team", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("team", "_stretch").orderBy("pos", "player_name"))
    return rows.withColumn("_rank", within).join(before, ["team", "_stretch"]).select(
        "team", (F.col("_before") + F.col("_rank") - 1).alias("place"), "player_name"
    )
