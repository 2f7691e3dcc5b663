"""News, text-model and player-name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.registry import query
from matchlab.catalog.timelines import LONG
from matchlab.catalog.views import table, twin, view
from matchlab.functions import text as X
from matchlab.operators import articles as A
from matchlab.operators import matching as N
from matchlab.operators import signals as S
from matchlab.operators import squads as Q
from matchlab.operators import timeline as T

# Word pieces that occur in the supplied texts play the search terms.
TERMS = {
    "Alpha": ("eaux", "ouéau"),
    "Beta": ("thorr", "ndwh", "whnd"),
    "Gamma": ("schen", "lich"),
    "Delta": ("worthless", "tioned"),
}
_LISTED = ", ".join(f"('{t}', '{w}')" for t, words in TERMS.items() for w in words)

MATCHED = rf"""
terms as (select * from (values {_LISTED}) t(team, term)),
plain as (select *, lower(title) as low_title, lower(trim(regexp_replace(regexp_replace(description,
    '<[^>]+>', ' ', 'g'), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))) as low_text from tb_articles),
hits as (select pos, link, title, description, feed_prio, team, bool_or(contains(low_title, term)) as in_title,
    sum((length(low_text) - length(replace(low_text, term, ''))) / length(term)) as n
  from plain, terms group by all),
matched as (select pos, link, title, description, feed_prio, team, in_title from hits where in_title or n >= 2)
"""


def matched(spark, sf):
    return A.team_article_match(view(spark, sf, "tb_articles"), TERMS)


@query("team_article_match", twin("tb_articles", MATCHED + "select pos, team, in_title from matched"))
def team_article_match(spark, sf):
    return matched(spark, sf).select("pos", "team", "in_title")


BODY = r"""
paras as (select page_id, list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda p:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '&quot;', '"'),
      '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))) as ps from pages),
bodies as (select page_id, array_to_string(list_filter(ps, lambda p: length(p) >= 60
    and not starts_with(p, 'BBC') and not starts_with(lower(p), 'play ')
    and not regexp_matches(lower(p), 'cookie|subscribe|close dialogue|toggle caption|document\.addeventlistener|veggieburger|print subscriptions|search jobs')),
    ' ') as body from paras)
"""


@query(
    "article_body",
    twin("tb_articles", BODY + "select page_id, length(body) as chars, md5(body) as digest from bodies"),
)
def article_body(spark, sf):
    body = X.article_body(F.col("html"))
    df = table(spark, sf, "pages").select("page_id", body.alias("body"))
    return df.select("page_id", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("digest"))


TEXTS = BODY + r""",
joined as (select a.pos, coalesce(body, '') as body, case when a.pos % 3 = 0 then concat(link, '/bbc.') else link end
    as link, concat(title, '. ', description) as summary from tb_articles a left join bodies on page_id = a.pos),
texts as (select pos, link, case when length(body) >= 150 and contains(link, 'bbc.') then body
    else trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) end as text
  from joined)
"""


def texts(spark, sf):
    bodies = table(spark, sf, "pages").select(
        F.col("page_id").alias("pos"), X.article_body(F.col("html")).alias("body")
    )
    link = F.when(F.col("pos") % 3 == 0, F.concat("link", F.lit("/bbc."))).otherwise(F.col("link"))
    rows = view(spark, sf, "tb_articles").withColumn("link", link).join(bodies, "pos", "left")
    return A.body_or_summary(rows)


@query(
    "body_or_summary",
    twin("tb_articles", TEXTS + "select pos, md5(text) as digest from texts where length(text) > 0"),
)
def body_or_summary(spark, sf):
    return texts(spark, sf).select("pos", F.md5("text").alias("digest"))


@query(
    "dedupe_articles",
    twin("tb_articles", MATCHED + """,
    seq as (select team, pos, link, lower(concat(title, description)) as mark,
      row_number() over (partition by team order by pos) as rn from matched where link <> ''),
    walk as (
      select distinct team, 0::bigint as rn, null::bigint as pos, null::varchar as link, false as kept,
        []::varchar[] as links, []::varchar[] as marks from seq
      union all
      select team, rn, pos, link, ok, case when ok then list_append(links, link) else links end,
        case when ok then list_append(marks, mark) else marks end
      from (select s.team, s.rn, s.pos, s.link, s.mark, w.links, w.marks,
          not list_contains(w.links, s.link) and not list_contains(w.marks, s.mark) as ok
        from walk w join seq s on s.team = w.team and s.rn = w.rn + 1))
    select team, pos, link from walk where kept""", True),
)
def dedupe_articles(spark, sf):
    rows = matched(spark, sf).withColumn(
        "fingerprint", A.fingerprint(F.col("title"), F.col("description"))
    )
    return A.dedupe_articles(rows).select("team", "pos", "link")


TOP = MATCHED + """,
ranked as (select *, row_number() over (partition by team order by in_title desc, feed_prio, pos) as rank from matched)
"""


@query(
    "top_articles",
    twin("tb_articles", TOP + "select team, pos, in_title, rank from ranked where rank <= 6"),
)
def top_articles(spark, sf):
    return A.top_articles(matched(spark, sf)).select("team", "pos", "in_title", "rank")


@query(
    "interleave_match_news",
    twin("tb_articles", TOP + """,
    fixtures as (select n_nationkey as match_id, (['Alpha', 'Beta', 'Gamma', 'Delta'])[1 + n_nationkey % 4] as home_team,
      (['Alpha', 'Beta', 'Gamma', 'Delta'])[1 + (n_nationkey + 1 + n_nationkey % 3) % 4] as away_team from nation),
    sides as (select match_id, home_team as team, 0 as side from fixtures
      union all select match_id, away_team, 1 from fixtures),
    turns as (select match_id, link, pos, rank * 2 + side as turn,
      row_number() over (partition by match_id, link order by rank * 2 + side) as copy
      from sides join ranked using (team) where rank <= 6),
    placed as (select match_id, link, pos, row_number() over (partition by match_id order by turn) as place
      from turns where copy = 1)
    select * from placed where place <= 12"""),
)
def interleave_match_news(spark, sf):
    key = F.col("n_nationkey")
    names = F.array(*map(F.lit, TERMS))
    fixtures = table(spark, sf, "nation").select(
        key.cast("bigint").alias("match_id"),
        F.element_at(names, key % 4 + 1).alias("home_team"),
        F.element_at(names, (key + 1 + key % 3) % 4 + 1).alias("away_team"),
    )
    return A.interleave_match_news(fixtures, A.top_articles(matched(spark, sf)))


@query(
    "match_report_filter",
    twin("tb_articles", rf"""
    terms as (select * from (values {_LISTED}) t(team, term)),
    reports as (select distinct pos, team, date '1995-01-01' + cast(pos % 400 as int) as day from tb_articles, terms
      where contains(lower(title), term)
        and length(trim(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))) > 0),
    games as (select distinct (['Alpha', 'Beta', 'Gamma', 'Delta'])[1 + cast(o_custkey % 4 as int)] as team,
      o_orderkey as match_id, cast(o_orderdate as date) as match_date from orders)
    select match_id, pos, team from games join reports using (team)
    where day >= match_date and day <= match_date + 2"""),
)
def match_report_filter(spark, sf):
    games = table(spark, sf, "orders").select(
        F.element_at(F.array(*map(F.lit, TERMS)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("team"),
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"),
    )
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("pos") % 400).cast("int"))
    docs = view(spark, sf, "tb_articles").select(
        "pos", "title", F.col("link").alias("url"), day.cast("timestamp").alias("published"),
        F.col("description").alias("body_html"),
    )
    return A.match_report_filter(games, docs, TERMS).select("match_id", "pos", "team")


REQUESTS = TOP + """,
requests as (select team, string_agg(title, e'\n\n---\n\n' order by rank) as request,
  string_agg(link, ',' order by rank) as urls, cast(count(*) as int) as n_articles
  from ranked where rank <= 6 group by team)
"""


def requests(spark, sf):
    ranked = A.top_articles(matched(spark, sf)).withColumn("text", F.col("title"))
    return S.signal_requests(ranked)


@query(
    "signal_request_table",
    twin("tb_articles", REQUESTS + "select team, md5(request) as digest, urls, n_articles from requests"),
)
def signal_request_table(spark, sf):
    return requests(spark, sf).select(
        "team", F.md5("request").alias("digest"), F.array_join("urls", ",").alias("urls"), "n_articles"
    )


@query(
    "signal_response_table",
    twin("tb_squads", """
    teams as (select team, min(pos) as k, cast(count(*) as int) as n from tb_squads group by team)
    select team, case when k % 5 in (1, 2, 3) then 0 else least(1, k / 20.0 - 1) end::double as form_score,
      case when k % 5 in (1, 2, 3) then 0 else 0.5 end::double as confidence,
      case when k % 5 in (1, 2, 3) then 0 else n end as n_articles,
      case k % 5 when 1 then 'timeout' when 2 then 'no answer' when 3 then 'unreadable answer' end as error
    from teams"""),
)
def signal_response_table(spark, sf):
    teams = view(spark, sf, "tb_squads").groupBy("team").agg(
        F.min("pos").alias("k"), F.count("*").cast("int").alias("n_articles")
    )
    asked = teams.select("team", F.array(F.lit("u")).alias("urls"), "n_articles")
    doc = F.to_json(
        F.struct((F.col("k") / 20.0 - 1).alias("form_score"), F.lit("0.5").alias("confidence"))
    )
    kind = F.col("k") % 5
    answers = teams.filter(kind != 2).select(
        "team", F.when(kind == 3, "Sorry, no").when(kind != 1, doc).alias("raw"),
        F.when(kind == 1, "timeout").alias("error"),
    )
    df = S.signal_responses(asked, answers)
    return df.select("team", "form_score", "confidence", "n_articles", "error")


KEYS = LONG + """
keyed as (select team, concat('v4|', team, '|', string_agg(cast(match_date as varchar), ',' order by match_date)) as key
  from (select distinct team, match_date from pts) group by team)
"""


@query(
    "work_to_do",
    twin("tb_matches", KEYS + """
    select team, md5(key) as digest from keyed where cast(substring(team, 2) as int) % 3 <> 0
      or cast(substring(team, 2) as int) % 2 = 0"""),
)
def work_to_do(spark, sf):
    number = F.substring("team", 2, 9).cast("int")
    long = T.team_long_form(view(spark, sf, "tb_matches"))
    keys = S.request_key(long)
    # A third of the teams is stored; of those, every second under an older version.
    cached = keys.filter(number % 3 == 0).withColumn(
        "key", F.when(number % 2 == 0, F.concat(F.lit("old "), "key")).otherwise(F.col("key"))
    )
    return S.work_to_do(keys, cached).select("team", F.md5("key").alias("digest"))


def absent_names(spark, sf):
    """Names as an absence feed spells them: exact, with slips, in part, or unknown."""
    name, pos = F.col("player_name"), F.col("pos")
    spelled = (
        F.when(pos % 4 == 0, F.upper(name))
        .when(pos % 4 == 1, F.concat(F.substring(name, 1, 5), F.lit("x"), F.substring(name, 7, 99)))
        .when(pos % 4 == 2, F.substring(name, 10, 99))
        .otherwise(F.concat(F.lit("Zz "), pos.cast("string")))
    )
    return view(spark, sf, "tb_squads").select("team", spelled.alias("absent_name"), "pos")


# A name in capitals is found as it is, one with a wrong letter by its likeness, one without its
# first nine letters as a part; its squad has no other name with the same number.
FOUND = """
found as (select team, pos, case pos % 4 when 0 then upper(player_name)
    when 1 then concat(substring(player_name, 1, 5), 'x', substring(player_name, 7))
    when 2 then substring(player_name, 10) else concat('Zz ', cast(pos as varchar)) end as absent_name,
  case when pos % 4 <> 3 then player_name end as player_name,
  case pos % 4 when 0 then 'exact' when 1 then 'similar' when 2 then 'part' end as how from tb_squads)
"""


@query("fuzzy_name_match", twin("tb_squads", FOUND + "select * from found"))
def fuzzy_name_match(spark, sf):
    squads = view(spark, sf, "tb_squads").select("team", "player_name", "pos")
    return N.fuzzy_name_match(absent_names(spark, sf), squads)


@query(
    "injury_loss_fuzzy",
    twin("tb_squads", FOUND + """
    select team, round(least(1, case when sum(s.caps) > 0 then sum(case when f.player_name is not null then s.caps else 0 end)
      / sum(s.caps) else count(f.player_name) / count(*) end), 6) as loss
    from tb_squads s join found f using (team, pos) group by team"""),
)
def injury_loss_fuzzy(spark, sf):
    squads = view(spark, sf, "tb_squads")
    found = N.fuzzy_name_match(absent_names(spark, sf), squads.select("team", "player_name", "pos"))
    return Q.injury_loss(found.select("team", "player_name"), squads).withColumn("loss", F.round("loss", 6))
