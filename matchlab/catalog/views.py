"""Match-domain views of the supplied tables.

Each view is one select list that both engines accept, so a query and its SQL
twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> (select body, views it reads)
_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    # 64 teams in 8 closed pools; ratings_* stand in where a query needs any rating.
    "tb_matches": (
        """
        select o_orderkey as match_id, cast(o_orderdate as date) as match_date,
          cast(o_custkey % 8 as int) as pool,
          concat('T', cast(o_custkey % 64 as varchar(10))) as home_team,
          concat('T', cast((o_custkey % 64 + 8 * (1 + o_orderkey % 7)) % 64 as varchar(10)))
            as away_team,
          cast(cast(floor(o_totalprice) as bigint) % 5 as int) as home_score,
          cast(cast(floor(o_totalprice / 7) as bigint) % 4 as int) as away_score,
          (o_orderkey % 3 = 0) as neutral,
          case o_orderpriority when '1-URGENT' then 'FIFA World Cup' when '2-HIGH' then 'UEFA Euro'
            when '3-MEDIUM' then 'FIFA World Cup qualification'
            when '4-NOT SPECIFIED' then 'Friendly' else 'Regional Cup' end as tournament,
          cast(1400 + o_orderkey % 200 as double) as elo_home_pre,
          cast(1400 + o_custkey % 200 as double) as elo_away_pre
        from orders
        """,
        (),
    ),
    "tb_goals": (
        """
        select m.match_id, m.match_date, m.home_team, m.away_team,
          case when l_suppkey % 2 = 0 then m.home_team else m.away_team end as team,
          cast(2 * l_quantity as int) + l_linenumber % 2 as goal_minute,
          l_returnflag = 'R' as own_goal, concat('P', cast(l_partkey as varchar(10))) as scorer
        from tb_matches m join lineitem on l_orderkey = m.match_id
        """,
        ("tb_matches",),
    ),
    "tb_params": (
        """
        select o_orderkey as match_id,
          cast(0.4 as double) + (o_orderkey % 17) / cast(10 as double) as lambda_home,
          cast(0.3 as double) + (o_custkey % 13) / cast(10 as double) as lambda_away,
          ((o_orderkey % 9) - 4) / cast(50 as double) as rho
        from orders
        """,
        (),
    ),
    "tb_quotes": (
        """
        select l_orderkey as match_id, concat('B', cast(l_suppkey as varchar(10))) as bookmaker,
          cast(1.2 as double) + l_quantity / 10 as price_home,
          cast(2.5 as double) + 10 * l_tax as price_draw,
          cast(1.3 as double) + 30 * l_discount as price_away
        from lineitem
        """,
        (),
    ),
    "tb_squads": (
        """
        select concat('T', cast(c_custkey % 64 as varchar(10))) as team, c_name as player_name,
          c_custkey as pos, cast(floor(abs(c_acctbal) / 100) as int) as caps,
          c_mktsegment as club, c_nationkey
        from customer
        """,
        (),
    ),
    # One row per quote event of a pair of teams.
    "tb_ticks": (
        """
        select event_id, ts, cast(user_id % 40 as int) as match_no, event_type,
          1 + value / 10 as price
        from events
        """,
        (),
    ),
    # Articles: the first 60 characters play the title, the whole text the description.
    "tb_articles": (
        """
        select doc_id as pos, concat('http://', source, '.example/', cast(doc_id % 700 as varchar(10)))
            as link,
          substring(text, 1, 60) as title, text as description,
          cast(doc_id % 6 as int) as feed_prio
        from documents
        """,
        (),
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    for name in names:
        for part in (*_needed(_VIEWS[name][1]), name):
            if part not in order:
                order.append(part)
    return order


def twin(names: str, body: str, recursive: bool = False) -> str:
    """SQL text: the named views as common table expressions, then ``body``.

    ``body`` starts with more expressions (``x as (...),``) or with a select.
    """
    head = ", ".join(f"{n} as ({_VIEWS[n][0].strip()})" for n in _needed(tuple(names.split())))
    rest = body.strip()
    glue = "" if rest.lower().startswith("select") else ", "
    return f"with {'recursive ' if recursive else ''}{head}{glue} {rest}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above as a DataFrame."""
    body, reads = _VIEWS[name]
    frames = {part: view(spark, sf_dir, part) for part in reads}
    for base in ("orders", "lineitem", "customer", "events", "documents"):
        if base in body:
            frames[base] = table(spark, sf_dir, base)
    text = body
    for part in frames:
        for keyword in ("from", "join"):
            text = text.replace(f"{keyword} {part}", f"{keyword} {{{part}}}")
    return spark.sql(text, **frames)
