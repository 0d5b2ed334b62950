"""Queries X01..X10 and the scalar functions F01..F18 over pages, names and derived cell texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import pages
from touchline.plans.registry import query, r, rounded
from touchline.sources.match_pages import PAGES_SQL, match_pages
from touchline.sources.views import MATCHES_SQL, matches, table

BASE = f"with {MATCHES_SQL}, {PAGES_SQL}"


def cls(html: str, name: str) -> str:
    return f"regexp_extract({html}, 'class=\"{name}\"[^>]*>([^<]*)<', 1)"


@query("X01_match_links",
       "select distinct unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as url from pages")
def match_links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"))


@query("U04_dedupe_links", (
    BASE + " select distinct url from (select unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as url from mp)"
    " where contains(url, '/match/')"))
def dedupe_links(spark, sf_dir):
    return pages.links(match_pages(spark, sf_dir), "/match/")


@query("X02_league_rows", (
    "with l as (select page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>')) as row from pages)"
    " select page_id, regexp_extract(row, '>([^<]*)</a>', 1) as name, regexp_extract(row, 'href=\"([^\"]*)\"', 1) as url,"
    " '' as winner from l"))
def league_rows(spark, sf_dir):
    return pages.league_rows(table(spark, sf_dir, "pages"))


_STAGE_SQL = "coalesce(" + ",".join(
    f"case when contains(lower(hd), '{k}') then '{k.title()}' end" for k in text.STAGE_KEYWORDS
) + ", case when contains(trim(hd), ' - ') then trim(split_part(trim(hd), ' - ', -1)) end, 'Regular Season')"


def _title_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ' '), lambda x: upper(x[1])||lower(x[2:])), ' ')")


def _team_sql(side: str) -> str:
    block = f"regexp_extract(html, 'class=\"duelParticipant__{side}\">(.*?)</div>', 1)"
    name = cls(block, "participant__participantName")
    slug = _title_sql(f"replace(regexp_extract({block}, '/team/([^/]*)', 1), '-', ' ')")
    return f"case when {name} <> '' then {name} else {slug} end"


_STATUS_SQL = (f"case when {cls('html', 'detailScore__status')} <> '' then {cls('html', 'detailScore__status')}"
               " when contains(tx,'FINISHED') or contains(tx,'FT') then 'Finished' when contains(tx,'POSTPONED') then 'Postponed'"
               " when contains(tx,'CANCELLED') then 'Cancelled' else 'Finished' end")


def _info_sql(label: str) -> str:
    return f"nullif(regexp_extract(lower(html), '>{label}: ([^<]+)<', 1), '')"


RECORD_SQL = (
    BASE + f", x as (select *, {cls('html', 'tournamentHeader__country')} as hd, {cls('html', 'duelParticipant__startTime')} as dt,"
    f" {cls('html', 'detailScore__wrapper')} as sc, regexp_replace(html, '<[^>]+>', ' ', 'g') as tx from mp),"
    " y as (select page_id, regexp_extract(url, '/match/([^/]*)', 1) as match_key, try_strptime(dt, '%d.%m.%Y %H:%M') as kickoff,"
    " split_part(hd, ' - ', 1) as competition, nullif(regexp_extract(dt, '\\d{2}\\.\\d{2}\\.(\\d{4})', 1), '') as season,"
    f" {_STAGE_SQL} as stage, {_team_sql('home')} as home_team, {_team_sql('away')} as away_team,"
    " try_cast(regexp_extract(sc, '^(\\d+)\\s*-\\s*(\\d+)', 1) as int) as home_score,"
    " try_cast(regexp_extract(sc, '^(\\d+)\\s*-\\s*(\\d+)', 2) as int) as away_score,"
    f" {_STATUS_SQL} as status, {_info_sql('venue')} as venue, {_info_sql('referee')} as referee,"
    " try_cast(replace(regexp_extract(html, 'Attendance: ([0-9,.]+)', 1), ',', '') as int) as attendance,"
    f" {_info_sql('weather')} as weather from x)"
)


@query("X03_match_records", RECORD_SQL + (
    " select *, concat_ws(',', case when kickoff is null then 'date' end, case when home_team = away_team then 'teams' end,"
    " case when home_score is null then 'score' end) as quarantine from y"))
def match_records(spark, sf_dir):
    return pages.match_records(match_pages(spark, sf_dir))


_STAT_CASE = "case " + " ".join(
    f"when contains(lower(row), '{label.lower()}') then '{field}'" for label, field in text.STAT_LABELS.items()) + " end"
STAT_ROWS_SQL = (
    BASE + ", sec as (select page_id, unnest(regexp_extract_all(html, '<section title=.*?</section>')) as sec from mp),"
    " rw as (select page_id, regexp_extract(sec, 'title=\"([^\"]*)\"', 1) as period,"
    " unnest(regexp_extract_all(sec, 'class=\"stat__row\">([^<]*)<', 1)) as row from sec),"
    f" ty as (select page_id, period, {_STAT_CASE} as stat, list_transform(regexp_extract_all(row, '[0-9.]+'), lambda x: cast(x as double)) as v from rw)")
STAT_SQL = STAT_ROWS_SQL + (
    " select page_id, period, stat, case when stat='expected_goals' then v[1] else floor(v[1]) end as home,"
    " case when stat='expected_goals' then v[-1] else floor(v[-1]) end as away from ty")


@query("X04_page_statistics", STAT_SQL)
def page_statistics(spark, sf_dir):
    return rounded(pages.stat_rows(match_pages(spark, sf_dir)))


def _parse_sql(cell: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(replace({cell}, ',', '.'), '([0-9]+\\.?[0-9]*)', 1), '') as double), 0.0)"


ODDS_ROWS_SQL = (
    BASE + ", tb as (select page_id, unnest(regexp_extract_all(html, '<table data-market=.*?</table>')) as t from mp),"
    " rw as (select page_id, regexp_extract(t, 'data-market=\"([^\"]*)\"', 1) as mk, regexp_extract(t, 'data-period=\"([^\"]*)\"', 1) as period,"
    " unnest(regexp_extract_all(t, '<tr>(.*?)</tr>', 1)) as row from tb),"
    " cl as (select *, regexp_extract_all(row, '<td>(.*?)</td>', 1) as c from rw),"
    f" pr as (select *, regexp_replace(c[1], '<[^>]+>', '', 'g') as nm, {_parse_sql('c[2]')} as p1,"
    f" case when len(c)>2 then {_parse_sql('c[3]')} else 0 end as p2, case when len(c)>3 then {_parse_sql('c[4]')} else 0 end as p3 from cl),"
    " bk as (select *, case when nm <> '' then nm when contains(row, 'alt=') then regexp_extract(row, 'alt=\"([^\"]*)\"', 1)"
    " when contains(lower(row), 'unibet') then 'Unibet' end as bm from pr),"
    " lg as ("
    " select page_id, 'match_winner' as market, period, bm as bookmaker, null::double as line, unnest(['home_win','draw','away_win']) as selection,"
    " unnest([p1,p2,p3]) as price from bk where mk='1X2' and bm is not null and p1>0 and p2>0 and p3>0"
    " union all select page_id, 'over_under', period, nm,"
    " coalesce(try_cast(nullif(regexp_extract(row, 'class=\"total\">([0-9.]+)<', 1), '') as double), 2.5),"
    " unnest(['over','under']), unnest([p1,p2]) from bk where mk='Over/Under' and (p1>0 or p2>0)"
    " union all select page_id, 'both_teams_to_score', period, nm, null, unnest(['yes','no']), unnest([p1,p2]) from bk where mk='Both teams to score' and (p1>0 or p2>0)"
    " union all select page_id, 'odd_even', period, nm, null, unnest(['odd','even']), unnest([p1,p2]) from bk where mk='Odd/Even' and (p1>0 or p2>0)"
    " union all select page_id, 'correct_score', period, null, null, c[1], p1 from bk where mk='Correct score' and p1>0 and regexp_matches(c[1], '^[0-9]+-[0-9]+'))")


@query("X05_odds_rows", ODDS_ROWS_SQL + f" select page_id, market, period, bookmaker, line, selection, {r('price')} as price from lg")
def odds_rows(spark, sf_dir):
    return rounded(pages.odds_rows(match_pages(spark, sf_dir)))


@query("X06_over_under_lines",
       ODDS_ROWS_SQL + " select page_id, bookmaker, line, count(*) as quotes from lg where market='over_under' group by all")
def over_under_lines(spark, sf_dir):
    rows = pages.odds_rows(match_pages(spark, sf_dir)).where(F.col("market") == "over_under")
    return rows.groupBy("page_id", "bookmaker", "line").agg(F.count("*").alias("quotes"))


_CELL = "case l_linenumber%5 when 0 then '' when 1 then ' BOOK_'||cast(l_suppkey%8 as string)||' ' when 2 then '1.85' when 3 then '365' else 'Unibet' end"


@query("X07_bookmaker_fallback", (
    f"with c as (select l_suppkey, {_CELL} as cell from lineitem) select case when trim(cell)='' or regexp_full_match(trim(cell), '[0-9]+\\.?[0-9]*')"
    " then 'Unknown Bookmaker' else trim(cell) end as bookmaker, count(*) as n from c group by 1"))
def bookmaker_fallback(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr(f"{_CELL} as cell")
    return cells.select(text.bookmaker_or_unknown(F.lit(""), F.col("cell")).alias("bookmaker")) \
        .groupBy("bookmaker").agg(F.count("*").alias("n"))


@query("X09_offered_markets", (
    BASE + " select page_id, case when page_id%3=0 then '1X2 odds' else '1X2' end || '|Over/Under|Both teams to score|'"
    " || case when page_id%3=0 then 'Correct score odds' else 'Correct score' end || '|Odd/Even' as markets from mp"))
def offered_markets(spark, sf_dir):
    out = pages.offered_markets(match_pages(spark, sf_dir))
    return out.select("page_id", F.array_join("markets", "|").alias("markets"))


_ROWTEXT = "case l_linenumber%4 when 0 then 'row BET365 live' when 1 then 'Unibet 2.10' when 2 then 'william h. 3.1' else 'no name 1.9' end"


@query("X10_bookmaker_keyword", (
    f"with c as (select {_ROWTEXT} as t from lineitem), k as (select case when contains(lower(t),'bet365') then 'bet365'"
    " when contains(lower(t),'unibet') then 'Unibet' when contains(lower(t),'william') then 'William Hill' end as bookmaker from c)"
    " select bookmaker, count(*) as n from k where bookmaker is not null group by bookmaker"))
def bookmaker_keyword(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{_ROWTEXT} as t")
    return rows.select(text.bookmaker(F.lit(""), F.lit(""), F.col("t")).alias("bookmaker")) \
        .where(F.col("bookmaker").isNotNull()).groupBy("bookmaker").agg(F.count("*").alias("n"))


# --- scalar functions --------------------------------------------------------------------------

_NAME = "'  '||p_name||'    '||p_type||' '||p_brand||'  '"


@query("F01_clean_name", f"select p_partkey, regexp_replace(trim({_NAME}), '\\s+', ' ', 'g') as name from part")
def clean_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.clean_team_name(F.expr(_NAME)).alias("name"))


@query("F02_lookup_key", f"select p_partkey, replace(lower(trim({_NAME})), ' ', '') as key from part")
def lookup_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.normalise_name(F.expr(_NAME)).alias("key"))


_SHORT = ("case c_custkey%6 when 0 then 'Atl ' when 1 then 'Dep ' when 2 then 'CF ' when 3 then 'FC ' when 4 then 'SC FC ' "
          "else '' end||c_name")


@query("F03_expand_prefixes", (
    f"with t as (select c_custkey, {_SHORT} as n from customer) select c_custkey, case when starts_with(n,'Atl ') then 'Atletico '||n[5:]"
    " when starts_with(n,'Dep ') then 'Deportes '||n[5:] when starts_with(n,'CF ') then 'Club de Futbol '||n[4:]"
    " when starts_with(n,'FC ') then 'Football Club '||n[4:] when starts_with(n,'SC ') then 'Sporting Club '||n[4:] else n end as name from t"))
def expand_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.expand_prefixes(F.expr(_SHORT)).alias("name"))


def _two(x):
    return f"lpad(cast({x} as string),2,'0')"


_D, _M, _Y = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"
_DATE_TEXT = (
    f"case o_orderkey%6 when 0 then {_two(_D)}||'.'||{_two(_M)}||'.'||cast({_Y} as string)||' 19:05'"
    f" when 1 then cast({_Y} as string)||'-'||{_two(_M)}||'-'||{_two(_D)}||' 08:30'"
    f" when 2 then {_two(_D)}||'/'||{_two(_M)}||'/'||cast({_Y} as string)||' 21:00'"
    f" when 3 then {_two(_D)}||'.'||{_two(_M)}||'.'||substr(cast({_Y} as string),3,2)||' 12:15'"
    f" when 4 then ' '||{_two(_D)}||'.'||{_two(_M)}||'.'||cast({_Y} as string)||' ' else 'tomorrow' end")


def _strptime(x, *formats):
    def one(f):
        got = f"try_strptime(trim({x}), '{f}')"
        return f"case when regexp_matches({x}, '[0-9]{{4}}') then {got} end" if "%Y" in f else got
    return "coalesce(" + ",".join(one(f) for f in formats) + ")"


@query("F04_parse_dates", (
    f"with t as (select o_orderkey, {_DATE_TEXT} as d from orders) select o_orderkey,"
    f" {_strptime('d', '%d.%m.%Y %H:%M', '%Y-%m-%d %H:%M', '%d/%m/%Y %H:%M')} as parsed,"
    f" {_strptime('d', '%d.%m.%Y %H:%M', '%d.%m.%y %H:%M', '%Y-%m-%d %H:%M')} as validated,"
    f" {_strptime('d', '%d.%m.%Y %H:%M', '%d.%m.%Y', '%Y-%m-%d %H:%M', '%Y-%m-%d')} as page_date from t"))
def parse_dates(spark, sf_dir):
    d = F.expr(_DATE_TEXT)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *[text.parse_date(d, f).cast("timestamp").alias(n) for n, f in (
            ("parsed", text.PARSING_FORMATS), ("validated", text.VALIDATION_FORMATS),
            ("page_date", text.PAGE_FORMATS))])


_SCORE = ("case match_id%4 when 0 then ' '||coalesce(cast(home_score as string),'x')||' - '||coalesce(cast(away_score as string),'x')"
          " when 1 then coalesce(cast(home_score as string),'')||'-'||coalesce(cast(away_score as string),'')||' (aet)'"
          " when 2 then 'score: 1-0' else cast(match_id%12 as string)||' -'||cast(match_id%10 as string) end")


@query("F05_parse_score", (
    f"with {MATCHES_SQL}, t as (select match_id, {_SCORE} as sc from m) select match_id,"
    " try_cast(nullif(regexp_extract(trim(sc), '^([0-9]+)\\s*-\\s*([0-9]+)', 1),'') as int) as home,"
    " try_cast(nullif(regexp_extract(trim(sc), '^([0-9]+)\\s*-\\s*([0-9]+)', 2),'') as int) as away from t"))
def parse_score(spark, sf_dir):
    return matches(spark, sf_dir).select("match_id", text.parse_score(F.expr(_SCORE)).alias("s")) \
        .select("match_id", "s.home", "s.away")


_PCT = "case p_partkey%3 when 0 then cast(p_size as string)||'%' when 1 then cast(p_size as string)||'.5%%' else 'n/a' end"


@query("F06_parse_percentage", f"select p_partkey, {r(f'try_cast(trim({_PCT}, chr(37)) as double)')} as pct from part")
def parse_percentage(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select(
        "p_partkey", text.parse_percentage(F.expr(_PCT)).alias("pct")))


_PRICE = ("case l_linenumber%6 when 0 then '' when 1 then ' - ' when 2 then 'n/a' when 3 then cast(l_orderkey%9+1 as string)||',25 '"
          " when 4 then 'x'||cast(l_partkey%50 as string)||'.5up' else 'evens' end")


@query("F07_parse_odds", (
    f"with t as (select l_orderkey, l_linenumber, {_PRICE} as p from lineitem) select p as cell, count(*) as n,"
    f" {r('max(' + _parse_sql('p') + ')')} as price from t group by p"))
def parse_odds(spark, sf_dir):
    cell = table(spark, sf_dir, "lineitem").selectExpr(f"{_PRICE} as cell")
    return rounded(cell.groupBy("cell").agg(
        F.count("*").alias("n"), F.max(text.parse_odds(F.col("cell"))).alias("price")))


_URLS = ("u as (select url from pages union all select 'https://www.example.com/match/k'||cast(o_orderkey as string)"
         "||case when o_orderkey%2=0 then '/#/match-summary' else '' end from orders"
         " union all select 'https://www.example.com/archive/primera-a-'||cast(year(o_orderdate) as string)||'/r'"
         "||cast(o_orderkey as string)||'#top' from orders)")


def _urls(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "pages")
    key = F.col("o_orderkey").cast("string")
    return p.select("url").union(o.select(F.concat(
        F.lit("https://www.example.com/match/k"), key,
        F.when(F.col("o_orderkey") % 2 == 0, "/#/match-summary").otherwise("")))).union(o.select(F.concat(
            F.lit("https://www.example.com/archive/primera-a-"), F.year("o_orderdate").cast("string"),
            F.lit("/r"), key, F.lit("#top"))))


@query("F08_match_id_from_url", (
    f"with {_URLS} select url, case when contains(url, '/match/') then regexp_extract(url, '/match/([^/?#]*)', 1)"
    " else split_part(url, '/', -1) end as id from u"))
def match_id_from_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", text.match_id_from_url(F.col("url")).alias("id"))


@query("F09_stored_id_from_url",
       f"with {_URLS} select url, split_part(split_part(url, '/', -1), '#', 1) as id from u")
def stored_id_from_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", text.stored_id_from_url(F.col("url")).alias("id"))


@query("F10_season_year", (
    f"with {_URLS} select url, coalesce(nullif(regexp_extract(url, 'primera-a-([0-9]{{4}})', 1),''), '2017') as season from u"))
def season_year(spark, sf_dir):
    return _urls(spark, sf_dir).select(
        "url", text.season_year(F.col("url"), F.lit("17.12.2017 19:00")).alias("season"))


@query("F11_competition", BASE + f" select page_id, split_part({cls('html', 'tournamentHeader__country')}, ' - ', 1) as competition from mp")
def competition(spark, sf_dir):
    header = pages.class_text(F.col("html"), "tournamentHeader__country")
    return match_pages(spark, sf_dir).select("page_id", text.competition(header).alias("competition"))


@query("F12_stage", BASE + f", x as (select page_id, {cls('html', 'tournamentHeader__country')} as hd from mp) select page_id, {_STAGE_SQL} as stage from x")
def stage(spark, sf_dir):
    header = pages.class_text(F.col("html"), "tournamentHeader__country")
    return match_pages(spark, sf_dir).select("page_id", text.stage(header, header).alias("stage"))


@query("F13_status", RECORD_SQL + " select page_id, status from y")
def status(spark, sf_dir):
    html = F.col("html")
    return match_pages(spark, sf_dir).select("page_id", text.status(
        pages.class_text(html, "detailScore__status"), pages.strip_tags(html)).alias("status"))


@query("F14_match_metadata", RECORD_SQL + " select page_id, venue, referee, attendance, weather from y")
def match_metadata(spark, sf_dir):
    return pages.match_records(match_pages(spark, sf_dir)).select(
        "page_id", "venue", "referee", "attendance", "weather")


@query("F15_stat_rows", STAT_ROWS_SQL + " select page_id, period, count(distinct stat) as stats from ty group by page_id, period")
def stat_rows(spark, sf_dir):
    rows = pages.stat_rows(match_pages(spark, sf_dir))
    return rows.groupBy("page_id", "period").agg(F.count("*").alias("stats"))


_MARKET = ("case l_linenumber%8 when 0 then '1X2' when 1 then 'O/U 2.5' when 2 then 'BTTS' when 3 then 'Correct score'"
           " when 4 then 'odd even' when 5 then 'Asian handicap' when 6 then 'Both Teams To Score' else '1x2 first' end")


@query("F16_market_type", (
    f"with t as (select {_MARKET} as market_name from lineitem) select market_name, case when contains(lower(market_name),'1x2') then 'match_winner'"
    " when contains(lower(market_name),'over/under') or contains(lower(market_name),'o/u') then 'over_under'"
    " when contains(lower(market_name),'both teams to score') or contains(lower(market_name),'btts') then 'both_teams_to_score'"
    " when contains(lower(market_name),'correct score') then 'correct_score'"
    " when contains(lower(market_name),'odd/even') or contains(lower(market_name),'odd even') then 'odd_even' else 'match_winner' end as market,"
    " count(*) as n from t group by all"))
def market_type(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{_MARKET} as market_name")
    return rows.groupBy("market_name").agg(F.count("*").alias("n")).select(
        "market_name", text.market_type(F.col("market_name")).alias("market"), "n")


_PERIOD = ("case l_linenumber%6 when 0 then 'FT' when 1 then 'First half' when 2 then '2H' when 3 then 'Full-time' when 4 then ' Extra time '"
           " else 'Match' end")


@query("F17_period_names", (
    f"with t as (select trim({_PERIOD}) as p from lineitem) select case when contains(lower(p),'full') or contains(lower(p),'match') or lower(p)='ft' then 'Full Time'"
    " when contains(lower(p),'1st') or contains(lower(p),'first') or lower(p)='1h' then '1st Half'"
    " when contains(lower(p),'2nd') or contains(lower(p),'second') or lower(p)='2h' then '2nd Half' else p end as period, count(*) as n from t group by 1"))
def period_names(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{_PERIOD} as label")
    named = F.explode(text.periods(F.array(F.col("label")))).alias("period")
    return rows.select(named).groupBy("period").agg(F.count("*").alias("n"))


_SLUG_SQL = "replace(regexp_extract(link, '/team/([^/]*)', 1), '-', ' ')"


@query("F18_team_from_slug", (
    f"with {MATCHES_SQL}, t as (select match_id, '/team/'||lower(replace(home_team,' ','-'))||'/x'||cast(match_id as string)||'/' as link from m)"
    f" select match_id, {_title_sql(_SLUG_SQL)} as team from t"))
def team_from_slug(spark, sf_dir):
    link = F.concat(F.lit("/team/"), F.lower(F.replace(F.col("home_team"), F.lit(" "), F.lit("-"))),
                    F.lit("/x"), F.col("match_id").cast("string"), F.lit("/"))
    return matches(spark, sf_dir).select("match_id", text.team_from_slug(link).alias("team"))
