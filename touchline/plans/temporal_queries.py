"""Queries W01..W18: temporal features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators import contextual, snapshot, temporal
from touchline.operators.asof import match_sides, with_outcome
from touchline.plans.oracle_text import KEYS_SQL, SIDES_SQL, history, snapshot_sql
from touchline.plans.registry import query, r, rounded
from touchline.sources.views import MATCHES_SQL, matches

ROLLING_SQL = {
    "goals_per_game": ("gf", 1.0),
    "goals_conceded_per_game": ("ga", 1.0),
    "goal_difference_per_game": ("gd", 0.0),
    "win_rate": ("case when gd>0 then 1.0 else 0.0 end", 0.33),
    "draw_rate": ("case when gd=0 then 1.0 else 0.0 end", 0.33),
    "loss_rate": ("case when gd<0 then 1.0 else 0.0 end", 0.33),
    "points_per_game": ("pts", 1.0),
    "clean_sheet_rate": ("case when ga=0 then 1.0 else 0.0 end", 0.25),
    "failed_to_score_rate": ("case when gf=0 then 1.0 else 0.0 end", 0.25),
    "over_2_5_rate": ("case when gf+ga>2.5 then 1.0 else 0.0 end", 0.5),
    "under_1_5_rate": ("case when gf+ga<1.5 then 1.0 else 0.0 end", 0.25),
}


def rolling_parts(stats):
    aggs, features = {}, {}
    for n in temporal.ROLLING_WINDOWS:
        for stat in stats:
            sql, default = ROLLING_SQL[stat]
            aggs[f"{stat}_{n}"] = f"avg(cast({sql} as double)) filter (where age <= {n})"
            features[f"{stat}_{n}g"] = (f"a.{stat}_{n}", 3, default)
    return aggs, features


def _rolling_sql(stats):
    aggs, features = rolling_parts(stats)
    return snapshot_sql(aggs, features, 20)


def _rolling(stats):
    def run(spark, sf_dir):
        snap = snapshot.team_snapshot(matches(spark, sf_dir), ["rolling"])
        names = [f"{s}_{n}g" for n in temporal.ROLLING_WINDOWS for s in stats]
        return rounded(snap.select("team", "date", "matches_before", *names))
    return run


for _name, _stats in {
    "W01_rolling_goals": ["goals_per_game", "goals_conceded_per_game", "goal_difference_per_game"],
    "W02_rolling_results": ["win_rate", "draw_rate", "loss_rate", "points_per_game"],
    "W03_rolling_clean_sheets": ["clean_sheet_rate", "failed_to_score_rate"],
    "W04_rolling_totals": ["over_2_5_rate", "under_1_5_rate"],
}.items():
    query(_name, _rolling_sql(_stats))(_rolling(_stats))


@query("W05_rolling_gate", (
    history(20) + ", a as (select team, date, avg(cast(gf as double)) as v from h group by all) "
    f"select k.team, k.date, coalesce(c.n,0) as matches_before, coalesce(c.n,0) < 3 as cold_start, "
    f"least(coalesce(c.n,0), 20) as rows_used, "
    f"case when coalesce(c.n,0) >= 3 then {r('a.v')} else 1.0::double end as goals_per_game_20g "
    "from k left join c using (team, date) left join a using (team, date)"))
def rolling_gate(spark, sf_dir):
    snap = snapshot.team_snapshot(matches(spark, sf_dir), ["rolling"])
    n = F.col("matches_before")
    return rounded(snap.select(
        "team", "date", "matches_before", (n < 3).alias("cold_start"),
        F.least(n, F.lit(20)).alias("rows_used"), "goals_per_game_20g"))


def _snap(family, names):
    def run(spark, sf_dir):
        snap = snapshot.team_snapshot(matches(spark, sf_dir), [family])
        return rounded(snap.select("team", "date", "matches_before", *names))
    return run


MOMENTUM_AGGS = {
    "num": "sum(pts * pow(0.95, age-1))", "den": "sum(pow(0.95, age-1))",
    "trend": "regr_slope(cast(pts as double), cast(-age as double)) filter (where age<=10)",
    "strength": "sum(pts * (case age when 1 then 1.2 when 2 then 1.0 when 3 then 0.9 when 4 then 0.7 else 0.5 end)::double)"
                " filter (where age<=5) / sum((case age when 1 then 1.2 when 2 then 1.0 when 3 then 0.9 when 4 then 0.7"
                " else 0.5 end)::double) filter (where age<=5) / 3.0",
    "v": "var_pop(cast(pts as double))",
    "sd": "stddev_pop(cast(pts as double)) filter (where age<=10)",
}
MOMENTUM_SQL = {
    "momentum_points": ("a.num / a.den", 3, 1.0),
    "momentum_trend": ("a.trend", 3, 0.0),
    "recent_form_strength": ("a.strength", 3, 0.5),
    "consistency": ("1.0/(1.0+a.v)", 3, 0.5),
    "volatility": ("case when c.n >= 10 then a.sd else 1.0 end", 3, 1.0),
}

for _name, _cols in {
    "W06_momentum_points": ["momentum_points"],
    "W07_momentum_trend": ["momentum_trend"],
    "W08_recent_form_strength": ["recent_form_strength"],
    "W09_consistency_volatility": ["consistency", "volatility"],
}.items():
    query(_name, snapshot_sql(MOMENTUM_AGGS, {c: MOMENTUM_SQL[c] for c in _cols}))(
        _snap("momentum", _cols))

FORM_SQL = ("least(greatest(case when gd>0 then 1.0::double when gd=0 then 0.5 else 0.0 end"
            " + 0.3*((exp(2*gd/3.0)-1)/(exp(2*gd/3.0)+1))"
            " + case when is_home then -0.05 else 0.05 end, 0.0), 1.0)")


@query("W10_match_form_score", (
    "with " + MATCHES_SQL + "," + SIDES_SQL +
    f" select match_id, team, {r(FORM_SQL.replace('gd', '(gf-ga)'))} as form_score from s"))
def match_form_score(spark, sf_dir):
    rows = with_outcome(match_sides(matches(spark, sf_dir)))
    return rounded(rows.select("match_id", "team", temporal.form_score().alias("form_score")))


def form_parts():
    aggs, features = {}, {}
    for n in temporal.FORM_WINDOWS:
        f = f" filter (where age<={n})"
        aggs |= {
            f"m{n}": f"avg({FORM_SQL}){f}",
            f"t{n}": f"regr_slope({FORM_SQL}, cast(-age as double)){f}",
            f"d{n}": f"stddev_pop({FORM_SQL}){f}",
            f"x{n}": f"max({FORM_SQL}){f}", f"w{n}": f"min({FORM_SQL}){f}",
        }
        features |= {
            f"form_rating_{n}f": (f"a.m{n}", 5, 0.5), f"form_trend_{n}f": (f"a.t{n}", 5, 0.0),
            f"form_stability_{n}f": (f"1.0 - a.d{n}", 5, 0.5),
            f"peak_form_{n}f": (f"a.x{n}", 5, 0.5), f"worst_form_{n}f": (f"a.w{n}", 5, 0.5),
        }
    return aggs, features


query("W11_form_windows", snapshot_sql(*form_parts(), 15))(
    _snap("form", [f"{stat}_{n}f" for n in temporal.FORM_WINDOWS for stat in temporal.FORM_DEFAULTS]))

# Streaks: the current run is everything newer than the newest break; the longest run is the widest
# gap between consecutive breaks (numbered oldest first, with sentinels at both ends).
_CURRENT = {
    f"{name}_age": f"min(age) filter (where {cond})"
    for name, cond in {"w": "gd<=0", "u": "gd<0", "l": "gd>=0"}.items()
}
_STREAK = {
    "current_win_streak": ("coalesce(a.w_age - 1, c.n)", 3, 0.0),
    "current_unbeaten_streak": ("coalesce(a.u_age - 1, c.n)", 3, 0.0),
    "current_loss_streak": ("coalesce(a.l_age - 1, c.n)", 3, 0.0),
}


def longest_sql(cond: str, name: str) -> str:
    return (
        f", b_{name} as (select team, date, age, coalesce(lead(age) over (partition by team, date order by age),"
        f" tot + 1) as older from (select h.*, c.n as tot from h join c using (team, date)) where {cond}"
        f"), l_{name} as (select c.team, c.date, greatest(coalesce(max(older - b.age - 1), 0),"
        f" coalesce(min(b.age) - 1, max(c.n))) as run"
        f" from c left join b_{name} b on b.team=c.team and b.date=c.date group by c.team, c.date)")


LONGEST_MORE = longest_sql("gd<=0", "w") + longest_sql("gd<0", "u")
LONGEST_JOINS = (" left join l_w on l_w.team=k.team and l_w.date=k.date"
                 " left join l_u on l_u.team=k.team and l_u.date=k.date")
LONGEST = {
    "longest_win_streak": ("l_w.run", 3, 0.0), "longest_unbeaten_streak": ("l_u.run", 3, 0.0),
}
_VOL = {
    "vol": "stddev_pop(case when gd>0 then 2.0::double when gd=0 then 1.0 else 0.0 end)",
    "five": "avg(case when gd>0 then 1.0::double when gd=0 then 0.5 else 0.0 end) filter (where age<=5)",
}
STREAK_VOL = {
    "streak_volatility": ("case when c.n>=5 then a.vol/2.0 else 0.5 end", 3, 0.5),
    "recent_streak_strength": ("case when c.n>=5 then a.five else 0.5 end", 3, 0.5),
}
query("W12_current_streaks", snapshot_sql(_CURRENT, _STREAK))(_snap("streaks", list(_STREAK)))
query("W13_longest_streaks",
      snapshot_sql({"z": "count(*)"}, LONGEST, more=LONGEST_MORE, joins=LONGEST_JOINS))(
    _snap("streaks", list(LONGEST)))
query("W14_streak_volatility", snapshot_sql(_VOL, STREAK_VOL))(_snap("streaks", list(STREAK_VOL)))
STREAK_AGGS = {**_CURRENT, **_VOL}
STREAK_SQL = {**_STREAK, **LONGEST, **STREAK_VOL}
query("W15_streak_gate",
      snapshot_sql(STREAK_AGGS, STREAK_SQL, more=LONGEST_MORE, joins=LONGEST_JOINS))(
    _snap("streaks", list(STREAK_SQL)))


def sided(snapshot_text: str, select: str) -> str:
    """Join a snapshot query to both sides of every match."""
    return (f"with snap as ({snapshot_text}), {MATCHES_SQL} select m.match_id, {select} from m "
            "left join snap h on h.team=m.home_team and h.date=m.date "
            "left join snap a on a.team=m.away_team and a.date=m.date")


_RA, _RF = rolling_parts(ROLLING_SQL)
_FA, _FF = form_parts()
TEMPORAL_AGGS = {**_RA, **MOMENTUM_AGGS, **_FA, **STREAK_AGGS}
TEMPORAL_SQL = {**_RF, **MOMENTUM_SQL, **_FF, **STREAK_SQL}
TEMPORAL_SNAP = snapshot_sql(TEMPORAL_AGGS, TEMPORAL_SQL, more=LONGEST_MORE, joins=LONGEST_JOINS)
# differences are taken on unrounded features in the plan, so allow the oracle the same
_RAW_SNAP = TEMPORAL_SNAP.replace("(round(cast(", "(((cast(").replace(
    " as double), 9) + 0.0::double)", " as double)) + 0.0::double))")
_DIFFS = {k: k for k in [*_RF, *MOMENTUM_SQL]} | temporal.DIFF_FORM_SOURCE


@query("W16_differentials", sided(_RAW_SNAP, ", ".join(
    f"{r(f'h.{src} - a.{src}')} as diff_{k}" for k, src in _DIFFS.items())))
def differentials(spark, sf_dir):
    out = snapshot.match_features(matches(spark, sf_dir), ["rolling", "momentum", "form"])
    return rounded(out.select("match_id", *[f"diff_{k}" for k in _DIFFS]))


@query("J03_side_attach", sided(
    snapshot_sql({k: v for k, v in _RA.items() if k.endswith("_5")},
                 {k: v for k, v in _RF.items() if k.endswith("_5g")}, 5),
    ", ".join(f"h.{k} as home_{k}, a.{k} as away_{k}" for k in _RF if k.endswith("_5g"))))
def side_attach(spark, sf_dir):
    names = [k for k in _RF if k.endswith("_5g")]
    out = snapshot.match_features(matches(spark, sf_dir), ["rolling"])
    return rounded(out.select("match_id", *[f"{s}_{k}" for k in names for s in ("home", "away")]))


@query("W18_half_split", (
    history() + ", b as (select *, count(*) over (partition by team, date) as tot from h0"
    " where played >= date - interval 360 day)"
    " select k.team, k.date, count(age) as lookback_matches,"
    " coalesce(sum(pts) filter (where age > tot - tot//2),0)::bigint as early_points,"
    " coalesce(sum(pts) filter (where age <= tot - tot//2),0)::bigint as late_points"
    " from k join b using (team, date) group by k.team, k.date having count(age) >= 10"))
def half_split(spark, sf_dir):
    from touchline.operators.asof import running_totals
    rows = with_outcome(match_sides(matches(spark, sf_dir)))
    one = rows.select("team", "date", "match_id", F.lit(1).alias("one"), "points", "gd")
    ranked = running_totals(one, "team", ["one", "points", "gd"])
    days = match_sides(matches(spark, sf_dir)).groupBy("team", "date").agg(
        F.count_if("finished").alias("n_day"),
        F.sum(F.when(F.col("finished"), F.when(F.col("gf") > F.col("ga"), 3)
                     .when(F.col("gf") == F.col("ga"), 1).otherwise(0))).alias("points_day"),
        F.sum(F.when(F.col("finished"), F.col("gf") - F.col("ga"))).alias("gd_day"),
        F.lit(None).cast("struct<home_team:string,away_team:string>").alias("first_day"))
    w = Window.partitionBy("team").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    asof = days.select(
        "team", "date",
        *[F.coalesce(F.sum(f"{c}_day").over(w), F.lit(0)).alias(a)
          for c, a in (("n", "n"), ("points", "h_points"), ("gd", "h_gd"))],
        *[c.alias(n) for n, c in contextual.season_asof().items()])
    out = contextual.late_half(asof, ranked).where(F.col("lb_n") >= 10)
    return out.select(
        "team", "date", F.col("lb_n").alias("lookback_matches"),
        (F.col("lb_points") - F.col("late_points")).alias("early_points"), "late_points")
