"""Bookmaker prices: best price, freshness, snapshots and lookups by team pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.text import alias_team, odds_name_key

SPREADS = "array<struct<home_handicap:double,home_odds:double,away_handicap:double,away_odds:double>>"


def best_quotes(quotes: DataFrame, key: str = "match_id") -> DataFrame:
    """Best price of each outcome over all bookmakers.

    Without a home or away price there is no row; without a draw price it is null.
    """
    best = quotes.groupBy(key).agg(
        F.max("price_home").alias("odds_home"),
        F.max("price_draw").alias("odds_draw"),
        F.max("price_away").alias("odds_away"),
    )
    return best.filter((F.col("odds_home") > 0) & (F.col("odds_away") > 0)).withColumn(
        "odds_draw", F.when(F.col("odds_draw") > 0, F.col("odds_draw"))
    )


def fresh_only(odds: DataFrame, as_of: Column, minutes: int = C.ODDS_FRESH_MINUTES) -> DataFrame:
    """Prices fetched no more than ``minutes`` before ``as_of``."""
    oldest = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return odds.filter(F.col("fetched_at") >= oldest)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a map-side aggregate, so copies of a key never meet whole."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(last).select(*keys, "_r.*")


def snapshot_upsert(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Snapshot with a newer batch merged in by normalised team pair; later entries win.

    Both carry home_team, away_team, batch_ts and pos besides the prices.
    """
    both = snapshot.unionByName(batch, allowMissingColumns=True).withColumns(
        {
            "home_key": alias_team(F.col("home_team"), "odds"),
            "away_key": alias_team(F.col("away_team"), "odds"),
        }
    )
    return latest_per_key(both, ["home_key", "away_key"], ["batch_ts", "pos"])


def _entry(odds: DataFrame) -> Column:
    spreads = F.col("spreads") if "spreads" in odds.columns else F.lit(None)
    return F.struct(
        "odds_home", "odds_draw", "odds_away", spreads.cast(SPREADS).alias("spreads")
    )


def _swapped(entry: Column) -> Column:
    turned = F.transform(
        entry["spreads"],
        lambda s: F.struct(
            (-s["away_handicap"]).alias("home_handicap"), s["away_odds"].alias("home_odds"),
            (-s["home_handicap"]).alias("away_handicap"), s["home_odds"].alias("away_odds"),
        ),
    )
    return F.struct(
        entry["odds_away"].alias("odds_home"), entry["odds_draw"].alias("odds_draw"),
        entry["odds_home"].alias("odds_away"), turned.alias("spreads"),
    )


def odds_join_swapped(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """Add odds_home, odds_draw, odds_away, spreads and is_swapped to matches.

    The listed order of a pair wins; else the reversed listing is turned round.
    Both listings of a pair are folded into one row first, so one join serves
    both lookups.  ``odds`` carries pos: the last entry of a listing wins.
    """

    def pair(df: DataFrame) -> DataFrame:
        home = alias_team(F.col("home_team"), "odds")
        away = alias_team(F.col("away_team"), "odds")
        return df.withColumns(
            {
                "_first": F.least(home, away), "_second": F.greatest(home, away),
                "_straight": home <= away,
            }
        )

    listed = pair(odds).withColumn("_entry", _entry(odds))
    slots = listed.groupBy("_first", "_second").agg(
        F.max_by(F.when(F.col("_straight"), F.col("_entry")), F.when(F.col("_straight"), F.col("pos"))).alias("_a"),
        F.max_by(F.when(~F.col("_straight"), F.col("_entry")), F.when(~F.col("_straight"), F.col("pos"))).alias("_b"),
    )
    own = F.when(F.col("_straight"), F.col("_a")).otherwise(F.col("_b"))
    other = F.when(F.col("_straight"), F.col("_b")).otherwise(F.col("_a"))
    joined = pair(matches).join(slots, ["_first", "_second"], "left")
    joined = joined.withColumns({"_own": own, "_other": other})
    found = F.coalesce("_own", F.when(F.col("_other").isNotNull(), _swapped(F.col("_other"))))
    return joined.withColumn("_found", found).select(
        *matches.columns, "_found.odds_home", "_found.odds_draw", "_found.odds_away",
        "_found.spreads",
        (F.col("_own").isNull() & F.col("_other").isNotNull()).alias("is_swapped"),
    )


def odds_for_pair(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """Left join on names without case, punctuation and extra spaces; first entry wins."""
    keys = ["_home", "_away"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"_home": odds_name_key(F.col("home_team")), "_away": odds_name_key(F.col("away_team"))}
        )

    first = keyed(odds).groupBy(*keys).agg(
        F.min_by(F.struct("odds_home", "odds_draw", "odds_away"), "pos").alias("_o")
    )
    joined = keyed(matches).join(first, keys, "left")
    return joined.select(*matches.columns, "_o.odds_home", "_o.odds_draw", "_o.odds_away")
