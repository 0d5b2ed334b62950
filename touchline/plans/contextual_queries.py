"""Queries D01..D27 and the joins they rest on (J01, J02, J07, J08)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from touchline.functions import geo
from touchline.operators import contextual, snapshot
from touchline.operators.asof import (
    before, last_n, league_recent, match_sides, day_state, recent_rows, with_outcome,
)
from touchline.plans.oracle_text import KEYS_SQL, SIDES_SQL, history, snapshot_sql
from touchline.plans.registry import query, r, rounded
from touchline.sources.views import MATCHES_SQL, matches

AS_OF = datetime.date(2001, 8, 2)
AS_OF_SQL = f"date '{AS_OF.isoformat()}'"

# --- joins -------------------------------------------------------------------------------------


@query("J01_asof_history", (
    history(5) + " select k.team, k.date, coalesce(c.n,0) as matches_before,"
    " max(h.played) as last_played, "
    f"case when coalesce(c.n,0) >= 1 then {r('avg(cast(h.gf as double))')} end as goals_last5"
    " from k left join c using (team, date) left join h using (team, date) group by k.team, k.date, c.n"))
def asof_history(spark, sf_dir):
    sides = match_sides(matches(spark, sf_dir))
    recent = recent_rows(with_outcome(sides), "team", 5)
    state = day_state(recent, "team", {
        "last_played": F.col("date"), "goals": F.avg("gf").over(last_n("team", 5))})
    days = sides.groupBy("team", "date").agg(F.count_if("finished").alias("n"))
    w = before("team")
    out = days.join(state, ["team", "date"], "left").select(
        "team", "date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("matches_before"),
        F.last("state", ignorenulls=True).over(w).alias("s"))
    return rounded(out.select("team", "date", "matches_before", "s.last_played",
                              F.col("s.goals").alias("goals_last5")))


PAIR_SQL = """
p as (select m.match_id, m.date, m.home_team, m.away_team, f.match_id as met_id, f.date as met,
       case when f.home_team = m.home_team then f.home_score else f.away_score end as mine,
       case when f.home_team = m.home_team then f.away_score else f.home_score end as theirs,
       row_number() over (partition by m.match_id order by f.date desc, f.match_id desc) as age
  from m join m f on f.home_score is not null and f.date < m.date
   and least(f.home_team, f.away_team) = least(m.home_team, m.away_team)
   and greatest(f.home_team, f.away_team) = greatest(m.home_team, m.away_team)),
e as (select match_id, count(*) as n, count(*) filter (where mine>theirs) as hw, count(*) filter (where mine<theirs) as aw,
       count(*) filter (where age<=5 and mine>theirs) as hw5, count(*) filter (where age<=5) as n5,
       avg(cast(mine as double)) as hg, avg(cast(theirs as double)) as ag,
       stddev_pop(cast(abs(mine-theirs) as double)) as vol, avg(cast(abs(mine-theirs) as double)) as gap,
       count(*) filter (where met > %s - interval 1095 day) as n3y
  from p group by match_id)""" % AS_OF_SQL
DERBY_SQL = "least((" + " + ".join(
    f"(case when contains(lower(m.home_team),'{k}') and contains(lower(m.away_team),'{k}') then 1.0::double else 0.0 end)"
    for k in geo.DERBY_KEYWORDS) + f")/{len(geo.DERBY_KEYWORDS)}, 1.0)"
H2H_SQL = {
    "h2h_total_matches": ("e.n", 0.0), "h2h_home_team_wins": ("e.hw", 0.0),
    "h2h_away_team_wins": ("e.aw", 0.0), "h2h_draws": ("e.n-e.hw-e.aw", 0.0),
    "h2h_home_team_win_rate": ("e.hw/e.n", 0.33), "h2h_away_team_win_rate": ("e.aw/e.n", 0.33),
    "h2h_draw_rate": ("(e.n-e.hw-e.aw)/e.n", 0.33), "h2h_recent_form_home": ("e.hw5/e.n5", 0.33),
    "h2h_avg_goals_home_team": ("e.hg", 1.5), "h2h_avg_goals_away_team": ("e.ag", 1.5),
    "h2h_competitive_balance": ("1.0-abs(e.hw-e.aw)/e.n", 0.5), "h2h_match_volatility": ("e.vol", 1.0),
}
INTENSITY_SQL = (
    "case when e.n is null then 0.0::double else " + r(
        "least(0.3*least(e.n/20.0,1.0)+0.3*least(e.n3y/6.0,1.0)+0.2*greatest(1.0-e.gap/3.0,0.0)"
        f"+0.5*({DERBY_SQL}),1.0)") + " end")


def h2h_select(names):
    parts = []
    for name in names:
        if name == "is_derby":
            parts.append(f"{r(DERBY_SQL)} as is_derby")
        elif name == "rivalry_intensity":
            parts.append(f"{INTENSITY_SQL} as rivalry_intensity")
        else:
            sql, default = H2H_SQL[name]
            parts.append(f"case when e.n >= 3 then {r(sql)} else {default}::double end as {name}")
    return ", ".join(parts)


def _h2h(names):
    def run(spark, sf_dir):
        m = matches(spark, sf_dir)
        return rounded(contextual.attach_h2h(m, F.lit(AS_OF)).select("match_id", *names))
    sql = (f"with {MATCHES_SQL},{PAIR_SQL} select m.match_id, {h2h_select(names)} "
           "from m left join e on e.match_id = m.match_id")
    return sql, run


H2H_ALL = [*H2H_SQL, "is_derby", "rivalry_intensity"]
for _name, _cols in {
    "J02_pair_history": ["h2h_total_matches", "h2h_recent_form_home"],
    "D06_h2h_record": ["h2h_total_matches", "h2h_home_team_wins", "h2h_away_team_wins", "h2h_draws",
                       "h2h_home_team_win_rate", "h2h_away_team_win_rate", "h2h_draw_rate"],
    "D07_h2h_recent_form": ["h2h_recent_form_home"],
    "D08_h2h_goals": ["h2h_avg_goals_home_team", "h2h_avg_goals_away_team"],
    "D09_h2h_balance_volatility": ["h2h_competitive_balance", "h2h_match_volatility"],
    "D10_h2h_gate": list(H2H_SQL),
    "D12_rivalry_intensity": ["rivalry_intensity"],
}.items():
    _sql, _run = _h2h(_cols)
    query(_name, _sql)(_run)


@query("D11_derby_score", f"with {MATCHES_SQL} select m.match_id, {r(DERBY_SQL)} as is_derby from m")
def derby(spark, sf_dir):
    return rounded(matches(spark, sf_dir).select(
        "match_id", geo.derby_score(F.col("home_team"), F.col("away_team")).alias("is_derby")))


# --- travel ------------------------------------------------------------------------------------

def city_sql(col: str) -> str:
    return "case " + " ".join(
        f"when contains(lower({col}),'{c}') then '{c}'" for c in geo.CITY_COORDINATES
    ) + f" else '{geo.DEFAULT_CITY}' end"


CITY_TABLE_SQL = "cities as (select * from (values " + ",".join(
    f"('{c}', {lat}::double, {lon}::double)" for c, (lat, lon) in geo.CITY_COORDINATES.items()
) + ") t(city, lat, lon))"
KM_SQL = ("(case when {a}.city={b}.city then 0.0::double else 2*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)"
          "+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))*6371 end)")


@query("J07_team_city", (
    f"with {MATCHES_SQL}, t as (select home_team as team from m union select away_team from m), {CITY_TABLE_SQL} "
    f"select t.team, cities.city, cities.lat as latitude, cities.lon as longitude from t join cities on cities.city = {city_sql('t.team')}"))
def team_city_lookup(spark, sf_dir):
    m = matches(spark, sf_dir)
    teams = m.select(F.col("home_team").alias("team")).union(m.select("away_team")).distinct()
    cities = spark.createDataFrame(
        [(c, lat, lon) for c, (lat, lon) in geo.CITY_COORDINATES.items()],
        "city string, latitude double, longitude double")
    return teams.withColumn("city", geo.team_city(F.col("team"))).join(F.broadcast(cities), "city") \
        .select("team", "city", "latitude", "longitude")


@query("D13_team_city_per_match",
       f"with {MATCHES_SQL} select match_id, {city_sql('home_team')} as home_city, {city_sql('away_team')} as away_city from m")
def team_city_per_match(spark, sf_dir):
    return matches(spark, sf_dir).select(
        "match_id", geo.team_city(F.col("home_team")).alias("home_city"),
        geo.team_city(F.col("away_team")).alias("away_city"))


@query("D14_travel_distance", (
    f"with {MATCHES_SQL}, {CITY_TABLE_SQL} select m.match_id, {r(KM_SQL.format(a='a', b='h'))} as away_km from m "
    f"join cities h on h.city = {city_sql('m.home_team')} join cities a on a.city = {city_sql('m.away_team')}"))
def travel_distance(spark, sf_dir):
    return rounded(matches(spark, sf_dir).select(
        "match_id", geo.travel_km(F.col("away_team"), F.col("home_team")).alias("away_km")))


TRAVEL_CTES = (
    f", {CITY_TABLE_SQL}, hk as (select h.*, case when h.is_home then 0.0::double else {KM_SQL.format(a='x', b='y')} end as km"
    f" from h join cities x on x.city={city_sql('h.team')} join cities y on y.city={city_sql('h.venue_team')}),"
    " tr as (select team, date, count(*) as n, max(played) as last_played, sum(km) as total, avg(km) as mean,"
    " avg(case when km>500 then 1.0::double else 0.0 end) as freq,"
    " least(sum(km/1000*pow(0.8, date_diff('day', played, date)/7.0)),1.0) as fatigue from hk group by team, date)")
TRIP_KM = {
    "home": "0.0::double",
    "away": KM_SQL.format(a="ca", b="ch"),
}


def travel_sql(names):
    parts = []
    for side in ("home", "away"):
        t, km = f"t{side[0]}", TRIP_KM[side]
        rest = f"date_diff('day', {t}.last_played, m.date)"
        exprs = {
            "current_travel_distance": (km, 0.0),
            "is_long_distance_travel": (f"case when {km} > 500 then 1.0 else 0.0 end", 0.0),
            "days_since_last_match": (f"least({rest},14)", 7.0),
            "rest_adequacy": (f"least({rest}/(2.0::double+case when {km}>500 then {km}/1000 else 0.0 end),1.0)", 1.0),
            "recent_total_travel": (f"{t}.total", 0.0), "avg_recent_travel": (f"{t}.mean", 0.0),
            "travel_frequency": (f"{t}.freq", 0.0), "cumulative_fatigue": (f"{t}.fatigue", 0.0),
        }
        for n in names:
            sql, default = exprs[n]
            parts.append(f"case when {t}.n is null then {default}::double else {r(sql)} end as {side}_travel_{n}")
    return (history(5) + TRAVEL_CTES + " select m.match_id, " + ", ".join(parts) + " from m "
            f"join cities ch on ch.city={city_sql('m.home_team')} join cities ca on ca.city={city_sql('m.away_team')} "
            "left join tr th on th.team=m.home_team and th.date=m.date "
            "left join tr ta on ta.team=m.away_team and ta.date=m.date")


def _travel(names):
    def run(spark, sf_dir):
        out = snapshot.match_features(matches(spark, sf_dir), ["travel"])
        return rounded(out.select(
            "match_id", *[f"{s}_travel_{n}" for s in ("home", "away") for n in names]))
    return run


for _name, _cols in {
    "D15_current_trip": ["current_travel_distance", "is_long_distance_travel"],
    "D16_rest_days": ["days_since_last_match"],
    "D17_rest_adequacy": ["rest_adequacy"],
    "D18_recent_travel": ["recent_total_travel", "avg_recent_travel", "travel_frequency"],
    "D19_cumulative_fatigue": ["cumulative_fatigue"],
    "D20_travel_defaults": ["current_travel_distance", "is_long_distance_travel",
                            "days_since_last_match", "rest_adequacy", "recent_total_travel",
                            "avg_recent_travel", "travel_frequency", "cumulative_fatigue"],
}.items():
    query(_name, travel_sql(_cols))(_travel(_cols))

# --- home advantage ----------------------------------------------------------------------------

HOME_AGGS = {
    "hn": "count(*) filter (where is_home)", "an": "count(*) filter (where not is_home)", "tot": "count(*)",
    **{f"{v}{k}": f"avg({e}) filter (where {c})"
       for v, c in (("h", "is_home"), ("a", "not is_home"))
       for k, e in (("win", "case when gd>0 then 1.0::double else 0.0 end"), ("gf", "cast(gf as double)"),
                    ("ga", "cast(ga as double)"))},
    "hv": "var_samp(cast(gd as double)) filter (where is_home)",
    "av": "var_samp(cast(gd as double)) filter (where not is_home)",
}
VENUE_MORE = (
    ", v0 as (select *, row_number() over (partition by team, date, is_home order by age) - 1 as vr from h),"
    " v as (select team, date, "
    + ", ".join(
        f"sum(exp(-0.1*vr)*(case when gd>0 then 1.0 else 0.0 end+gd*0.1)) filter (where {c})"
        f"/sum(exp(-0.1*vr)) filter (where {c}) as {n}" for n, c in (("hs", "is_home"), ("as_", "not is_home")))
    + " from v0 group by team, date)")
VENUE_JOIN = " left join v on v.team=k.team and v.date=k.date"


def both(expr, default):
    return f"case when a.hn>0 and a.an>0 then {expr} else {default}::double end"


HOME_SQL = {
    "home_advantage_win_rate": ("a.hwin-a.awin", 0.0),
    "home_advantage_goals_for": ("a.hgf-a.agf", 0.0),
    "home_advantage_goals_against": ("a.aga-a.hga", 0.0),
    "home_advantage_goal_diff": ("(a.hgf-a.hga)-(a.agf-a.aga)", 0.0),
    "home_matches_ratio": ("a.hn/a.tot", 0.5),
    "home_form_strength": ("v.hs", 0.0), "away_form_strength": ("v.as_", 0.0),
    "venue_consistency": ("1.0/(1.0+abs(a.hv-a.av))", 0.5),
}


def home_sql(names):
    return snapshot_sql(HOME_AGGS, {n: (both(*HOME_SQL[n]), 5, HOME_SQL[n][1]) for n in names}, 50,
                        more=VENUE_MORE, joins=VENUE_JOIN)


def _snap(family, names, prefix=""):
    def run(spark, sf_dir):
        snap = snapshot.team_snapshot(matches(spark, sf_dir), [family])
        return rounded(snap.select("team", "date", "matches_before",
                                   *[F.col(prefix + n).alias(n) for n in names]))
    return run


for _name, _cols in {
    "D01_home_advantage": ["home_advantage_win_rate", "home_advantage_goals_for",
                           "home_advantage_goals_against", "home_advantage_goal_diff"],
    "D02_home_ratio": ["home_matches_ratio"],
    "D03_venue_form_strength": ["home_form_strength", "away_form_strength"],
    "D04_venue_consistency": ["venue_consistency"],
    "D05_home_defaults": list(HOME_SQL),
}.items():
    query(_name, home_sql(_cols))(_snap("home", _cols))

# --- season ------------------------------------------------------------------------------------

PROGRESS_SQL = (
    "least(greatest(date_diff('day', make_date(year({d}) - case when month({d})>=8 then 0 else 1 end, 8, 1), {d})"
    " / date_diff('day', make_date(year({d}) - case when month({d})>=8 then 0 else 1 end, 8, 1),"
    " make_date(year({d}) + case when month({d})>=8 then 1 else 0 end, 5, 31))::double, 0.0), 1.0)")
FLAG_SQL = {
    "month_of_year": "month({d})::double",
    **{f"is_{n}_period": f"case when month({{d}}) in ({m}) then 1.0::double else 0.0::double end"
       for n, m in (("winter", "12,1,2"), ("spring", "3,4,5"), ("summer", "6,7,8"), ("autumn", "9,10,11"))},
    "christmas_period": "case when month({d})=12 and day({d})>15 then 1.0::double else 0.0::double end",
    "new_year_period": "case when month({d})=1 and day({d})<15 then 1.0::double else 0.0::double end",
}


@query("D21_season_progress",
       f"with {MATCHES_SQL} select match_id, {r(PROGRESS_SQL.format(d='date'))} as season_progress from m")
def progress(spark, sf_dir):
    return rounded(matches(spark, sf_dir).select(
        "match_id", contextual.season_progress(F.col("date")).alias("season_progress")))


@query("D22_calendar_flags", f"with {MATCHES_SQL} select match_id, " + ", ".join(
    f"{e.format(d='date')} as {n}" for n, e in FLAG_SQL.items()) + " from m")
def flags(spark, sf_dir):
    return matches(spark, sf_dir).select(
        "match_id", *[c.alias(n) for n, c in contextual.calendar_flags(F.col("date")).items()])


def perf_sql(p, g, n):
    return f"least(greatest((({p})/({n})::double + ({g})/({n})::double + 3)/6, 0.0), 1.0)"


SEASON_CTES = (
    ", lb as (select h0.*, x.home_team as mh, x.away_team as ma, x.home_score as xs, x.away_score as ys,"
    " count(*) over (partition by h0.team, h0.date) as tot,"
    " first_value(x.home_team) over (partition by h0.team, h0.date order by h0.age desc rows between unbounded preceding and unbounded following) as fh,"
    " first_value(x.away_team) over (partition by h0.team, h0.date order by h0.age desc rows between unbounded preceding and unbounded following) as fa"
    " from h0 join m x on x.match_id=h0.match_id where h0.played >= h0.date - interval 360 day),"
    " sa as (select team, date, count(*) as n,"
    " coalesce(var_pop(case when xs>ys then 3.0::double when xs=ys then 1.0 else 0.0 end)"
    " filter (where age<=10 and (mh=fh or mh=fa)), 0.0) as spread,"
    " sum(pts) filter (where age<=5) as p5, sum(gd) filter (where age<=5) as g5,"
    " sum(pts) filter (where age<=tot-tot//2) as pl, sum(gd) filter (where age<=tot-tot//2) as gl,"
    " sum(pts) filter (where age>tot-tot//2) as pe, sum(gd) filter (where age>tot-tot//2) as ge"
    " from lb group by team, date)")
_P = PROGRESS_SQL.format(d="k.date")
SEASON_SQL = {
    "season_progress": (_P, None),
    **{n: (e.format(d="k.date"), None) for n, e in FLAG_SQL.items()},
    "end_season_pressure": (f"least(pow({_P},2) + sa.spread/9*0.5, 1.0)", 0.5),
    "seasonal_form_trend": (
        f"least(greatest({perf_sql('sa.pl', 'sa.gl', 'sa.n-sa.n//2')} - {perf_sql('sa.pe', 'sa.ge', 'sa.n//2')}, -1.0), 1.0)", 0.0),
    "motivation_index": (
        f"least(greatest(0.5::double + case when {_P}<0.2 then 0.2 when {_P}>0.8 then 0.3 else 0.0 end"
        f" + case when {perf_sql('sa.p5', 'sa.g5', '5')}<0.3 then 0.2 when {perf_sql('sa.p5', 'sa.g5', '5')}>0.7 then 0.1 else 0.0 end"
        " - case when (month(k.date)=12 and day(k.date)>20) or (month(k.date)=1 and day(k.date)<10) then 0.1 else 0.0 end, 0.0), 1.0)", 0.5),
}


def season_sql(names):
    parts = []
    for n in names:
        sql, default = SEASON_SQL[n]
        parts.append(f"{r(sql)} as {n}" if default is None else
                     f"case when coalesce(sa.n,0)>=10 then {r(sql)} else {default}::double end as {n}")
    return (history() + SEASON_CTES + " select k.team, k.date, coalesce(c.n,0) as matches_before, "
            + ", ".join(parts) + " from k left join c using (team, date) left join sa using (team, date)")


for _name, _cols in {
    "D23_end_season_pressure": ["end_season_pressure"],
    "D25_seasonal_trend": ["seasonal_form_trend"],
    "D26_motivation_index": ["motivation_index"],
}.items():
    query(_name, season_sql(_cols))(_snap("season", _cols, "seasonal_"))


@query("D24_average_performance", (
    history(5) + ", a as (select team, date, sum(pts) as p, sum(gd) as g, count(*) as n from h group by team, date) "
    f"select team, date, {r(perf_sql('p', 'g', 'n'))} as performance from a"))
def average_performance(spark, sf_dir):
    sides = match_sides(matches(spark, sf_dir))
    recent = recent_rows(with_outcome(sides), "team", 5)
    frame = last_n("team", 5)
    state = day_state(recent, "team", {"p": contextual.performance(
        F.sum("points").over(frame), F.sum("gd").over(frame), F.count(F.lit(1)).over(frame))})
    out = sides.select("team", "date").distinct().join(state, ["team", "date"], "left").select(
        "team", "date", F.last("state", ignorenulls=True).over(before("team")).alias("s"))
    return rounded(out.where(F.col("s").isNotNull())
                   .select("team", "date", F.col("s.p").alias("performance")))


@query("D27_lookback_gate", (
    history() + " select k.team, k.date, count(h0.age) filter (where h0.played >= k.date - interval 360 day) as lookback_matches,"
    " count(h0.age) filter (where h0.played >= k.date - interval 360 day) >= 10 as enough"
    " from k left join h0 using (team, date) group by k.team, k.date"))
def lookback_gate(spark, sf_dir):
    from touchline.operators.asof import days_before
    days = match_sides(matches(spark, sf_dir)).groupBy("team", "date").agg(
        F.count_if("finished").alias("n"))
    n = F.coalesce(F.sum("n").over(days_before("team", contextual.LOOKBACK_DAYS)), F.lit(0))
    return days.select("team", "date", n.alias("lookback_matches")).withColumn(
        "enough", F.col("lookback_matches") >= contextual.SEASON_GATE)


# --- league scope ------------------------------------------------------------------------------

LEAGUE_SQL = (
    "with " + ",".join([MATCHES_SQL, SIDES_SQL, KEYS_SQL]) + ", dd as (select distinct date from k),"
    " l as (select dd.date, f.match_id, f.date as played, f.home_team, f.away_team, f.home_score, f.away_score,"
    " row_number() over (partition by dd.date order by f.date desc, f.match_id desc) as age"
    " from dd join m f on f.home_score is not null and f.date < dd.date qualify age <= {n})")


@query("J08_league_last_50", (
    LEAGUE_SQL.format(n=50) + " select date, count(*) as matches, min(played) as oldest, "
    + r("avg(cast(home_score as double))") + " as mean_home_goals from l group by date"))
def league_last(spark, sf_dir):
    m = matches(spark, sf_dir)
    out = league_recent(m, m, 50).groupBy("date").agg(
        F.count("*").alias("matches"), F.min("played").alias("oldest"),
        F.avg("home_score").alias("mean_home_goals"))
    return rounded(out)


_LEAGUE_SEEN = (
    ", h as (select k.team, k.date, l.age, l.home_team=k.team as is_home, (l.home_team=k.team or l.away_team=k.team) as own,"
    " case when l.home_team=k.team then l.home_score else l.away_score end as gf,"
    " case when l.home_team=k.team then l.away_score else l.home_score end as ga,"
    " case when l.home_team=k.team then l.home_score-l.away_score else l.away_score-l.home_score end as gd"
    " from k join l on l.date=k.date)")
query("D01_home_advantage_league", (
    LEAGUE_SQL.format(n=50) + _LEAGUE_SEEN
    + ", c as (select team, date, count(*) as n from h group by team, date),"
    " o as (select * from h where own), a as (select team, date, "
    + ", ".join(f"{e} as {n}" for n, e in HOME_AGGS.items() if n != "tot")
    + " from o group by team, date)" + VENUE_MORE.replace(" from h)", " from o)")
    + " select k.team, k.date, " + ", ".join(
        f"case when coalesce(c.n,0)>=5 then {r(both(e.replace('a.tot', 'c.n'), d))} else {d}::double end as {n}"
        for n, (e, d) in HOME_SQL.items())
    + " from k left join c on c.team=k.team and c.date=k.date left join a on a.team=k.team and a.date=k.date"
    + VENUE_JOIN))(lambda spark, sf_dir: rounded(
        snapshot.league_snapshot(matches(spark, sf_dir), ["home"])))
