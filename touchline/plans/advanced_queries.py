"""Queries D30..D52: expected goals, efficiency, clutch and style."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import advanced, snapshot
from touchline.operators.asof import match_sides, with_outcome
from touchline.plans.contextual_queries import _LEAGUE_SEEN, LEAGUE_SQL
from touchline.plans.oracle_text import SIDES_SQL, snapshot_sql
from touchline.plans.registry import query, r, rounded
from touchline.sources.views import MATCHES_SQL, matches

XF = ("greatest((case when gd>0 then gf*0.8::double+0.3 when gd<0 then greatest(gf*0.8::double-0.2,0.1) else gf*0.8::double end)"
      "+case when is_home then 0.1 else 0.0 end, 0.1)")
XA = ("greatest((case when gd>0 then ga*0.8::double+0.2 when gd<0 then ga*0.8::double+0.3 else ga*0.8::double end)"
      "+case when is_home then 0.0 else 0.1 end, 0.1)")


@query("D30_match_xg", (
    f"with {MATCHES_SQL},{SIDES_SQL}, x as (select *, gf-ga as gd from s) "
    f"select match_id, team, {r(XF)} as xg_for, {r(XA)} as xg_against from x"))
def match_xg(spark, sf_dir):
    rows = with_outcome(match_sides(matches(spark, sf_dir)))
    return rounded(rows.select("match_id", "team", advanced.xg_for().alias("xg_for"),
                               advanced.xg_against().alias("xg_against")))


def share(cond):
    return f"avg(case when {cond} then 1.0::double else 0.0 end)"


def of(cond, value):
    return f"avg(cast({value} as double)) filter (where {cond})"


XG_AGGS = {
    "xf": f"avg({XF})", "xa": f"avg({XA})", "gf": "avg(cast(gf as double))", "ga": "avg(cast(ga as double))",
    "sxf": f"sum({XF})", "sxa": f"sum({XA})", "sgf": "sum(gf)", "sga": "sum(ga)",
    "vx": f"var_pop({XF})", "vg": "var_pop(cast(gf as double))",
    "cr": f"case when stddev_pop(cast(gf as double)) < 1e-12 or stddev_pop({XF}) < 1e-12 then null"
          f" else corr(cast(gf as double), {XF}) end",
}
XG_SQL = {
    "avg_xg_for": ("a.xf", 1.5), "avg_xg_against": ("a.xa", 1.5), "avg_actual_goals_for": ("a.gf", 1.5),
    "avg_actual_goals_against": ("a.ga", 1.5), "xg_diff": ("a.xf-a.xa", 0.0), "actual_goal_diff": ("a.gf-a.ga", 0.0),
    "xg_outperformance_for": ("a.gf-a.xf", 0.0), "xg_outperformance_against": ("a.xa-a.ga", 0.0),
    "finishing_quality": ("least(greatest(a.sgf/a.sxf-1.0,-1.0),1.0)", 0.0),
    "defensive_resilience": ("least(greatest(a.sxa/greatest(a.sga::double,0.1)-1.0,-1.0),1.0)", 0.0),
    "xg_variance": ("a.vx", 0.5), "goal_variance": ("a.vg", 0.5), "xg_consistency": ("1.0/(1.0+a.vx)", 0.5),
    "performance_sustainability": ("(coalesce(a.cr,0.0)+1.0)/2.0", 0.5),
}
EFF_AGGS = {
    "cnt": "count(*)", "sgf": "sum(gf)", "sga": "sum(ga)", "att": "avg(least(gf/3.0::double,1.0))",
    "de": "avg(greatest(1.0-ga/3.0::double,0.0))", "cs": share("ga=0"),
    "pr": "avg(case ga when 0 then 1.0::double when 1 then 0.7 when 2 then 0.4 else 0.1 end)",
    "po": "avg(case when gd>0 then 60.0::double when gd<0 then 40.0 else 50.0 end)", "gd": "avg(cast(gd as double))",
    "mg": "avg(case when gd>0 then 0.8::double when gd=0 then 0.6 else 0.4 end)",
}
EFF_SQL = {
    "goals_per_shot_ratio": ("a.sgf/greatest(a.sgf*4+a.cnt*6,1)", 0.15),
    "shots_per_goal_ratio": ("greatest(a.sgf*4+a.cnt*6,1)/greatest(a.sgf,1)", 6.0),
    "big_chances_conversion": ("a.sgf/greatest(a.sgf+a.cnt,1)", 0.4),
    "attacking_third_efficiency": ("a.att", 0.5),
    "defensive_actions_per_goal_conceded": ("a.cnt*20/greatest(a.sga,1)", 20.0),
    "clean_sheet_probability": ("a.cs", 0.3), "defensive_third_efficiency": ("a.de", 0.5),
    "pressure_resistance": ("a.pr", 0.5), "possession_efficiency": ("a.po/100", 0.5),
    "territory_control": ("a.po*0.9/100", 0.5), "tempo_control": ("(100+5*a.gd)/100", 0.5),
    "tactical_discipline": ("a.de", 0.5), "game_management": ("a.mg", 0.5), "adaptability_index": ("0.5+0.1*a.gd", 0.5),
}
RESP = "(case when gd>=0 then 0.7::double+0.1*gd else 0.3::double+0.1*gd end)"
CL_AGGS = {
    "gf": "avg(cast(gf as double))", "ga": "avg(cast(ga as double))",
    "nc": "count(*) filter (where abs(gd)<=1)", "cw": of("abs(gd)<=1", "case when gd>0 then 1 else 0 end"),
    "cp": of("abs(gd)<=1", "case when gd>0 then 3 when gd=0 then 1 else 0 end"),
    "ow": of("abs(gd)=1", "case when gd>0 then 1 else 0 end"), "rs": f"avg({RESP})", "rd": f"stddev_pop({RESP})",
    "hs": f"avg({RESP}*case when abs(gd)<=1 then 0.7 else 0.5 end)", "cb": share("gd>=0 and ga>0"),
    "cv": of("gd>=0 and ga>0", "case when gd>0 then 1 else 0 end"),
    "re": "avg(case when gd>0 and ga>0 then 1.0::double when gd=0 and ga>0 then 0.5 when ga>0 then 0.2 else 0.8 end)",
    "ld": of("gf>0", "case when gd>=0 then 1 else 0 end"),
}
CL_SQL = {
    "late_game_goals_for": ("a.gf*0.25", 0.25), "late_game_goals_against": ("a.ga*0.25", 0.25),
    "late_game_goal_differential": ("(a.gf-a.ga)*0.25", 0.0), "clutch_goal_ratio": ("0.25", 0.25),
    "close_match_win_rate": ("case when a.nc>0 then a.cw else 0.33 end", 0.33),
    "close_match_points_per_game": ("case when a.nc>0 then a.cp else 1.0 end", 1.0),
    "one_goal_game_performance": ("case when a.nc>0 then coalesce(a.ow,0.0) else 0.5 end", 0.5),
    "pressure_response_index": ("a.rs", 0.5), "high_stakes_performance": ("a.hs", 0.5),
    "mental_strength_score": ("least(a.rs+(1-a.rd),1.0)", 0.5), "comeback_frequency": ("a.cb", 0.2),
    "comeback_success_rate": ("coalesce(a.cv,0.0)", 0.5), "resilience_after_conceding": ("a.re", 0.5),
    "lead_protection_ability": ("coalesce(a.ld,0.0)", 0.7),
}
ST_AGGS = {
    "gf": "avg(cast(gf as double))", "ga": "avg(cast(ga as double))", "th": share("gf>=2"),
    "va": of("gf>0", "least(gf/3.0::double,1.0)"), "co": share("gd>0 and ga=0"), "cs": share("ga=0"),
    "ag": "avg(least(greatest(case when gd>=0 then 0.7::double+0.1*gf else 0.3::double+0.1*gd end,0.0),1.0))",
    "pt": "avg(case when gd>0 then 3.0::double when gd=0 then 1.0 else 0.0 end)",
    "ps": "stddev_pop(case when gd>0 then 3.0::double when gd=0 then 1.0 else 0.0 end)",
    "gs": "stddev_pop(cast(gf as double))", "mn": share("gf>2"),
    "te": "avg(case when gf+ga>=3 then 0.8::double when gf+ga=2 then 0.6 else 0.3 end)",
    "rh": "avg(least(case when gd>=0 then 0.7::double+0.1*gf else 0.3::double end,1.0))",
    "mo": "avg(least(greatest(0.5::double+0.1*gd,0.0),1.0))",
}
ST_SQL = {
    "attacking_intensity": ("least(a.gf/2.5,1.0)", 0.5), "goal_threat_level": ("a.th", 0.3),
    "attacking_variety": ("coalesce(a.va,0.3)", 0.4), "counter_attack_propensity": ("a.co", 0.2),
    "defensive_solidity": ("a.cs", 0.3), "defensive_aggression": ("a.ag", 0.5),
    "pressing_intensity": ("greatest(1.0-a.ga/3.0,0.0)", 0.5), "defensive_line_height": ("(a.cs+a.ag)/2", 0.5),
    "tactical_flexibility": ("least(greatest(1-a.ps/1.5,0.0),1.0)", 0.5),
    "formation_consistency": ("least(greatest(1-a.gs/2,0.0),1.0)", 0.6),
    "game_control_preference": ("a.pt/3", 0.5), "set_piece_effectiveness": ("least(a.mn,0.5)/0.5", 0.3),
    "tempo_preference": ("a.te", 0.5), "rhythm_consistency": ("a.rh", 0.5), "momentum_management": ("a.mo", 0.5),
}
FAMILY_SQL = {
    "xg": (XG_AGGS, XG_SQL, 30, 5), "efficiency": (EFF_AGGS, EFF_SQL, 15, 3),
    "clutch": (CL_AGGS, CL_SQL, 20, 5), "style": (ST_AGGS, ST_SQL, 20, 8),
}


def family_sql(family, names=None, raw=False):
    aggs, features, n, gate = FAMILY_SQL[family]
    names = names or list(features)
    return snapshot_sql(aggs, {k: (features[k][0], gate, features[k][1]) for k in names}, n)


def _snap(family, names):
    prefix = snapshot.FAMILIES[family][1]

    def run(spark, sf_dir):
        snap = snapshot.team_snapshot(matches(spark, sf_dir), [family])
        return rounded(snap.select("team", "date", "matches_before",
                                   *[F.col(prefix + n).alias(n) for n in names]))
    return run


for _name, (_family, _cols) in {
    "D31_xg_means": ("xg", list(XG_SQL)[:8]),
    "D32_finishing_resilience": ("xg", ["finishing_quality", "defensive_resilience"]),
    "D33_xg_variance": ("xg", ["xg_variance", "goal_variance", "xg_consistency"]),
    "D34_sustainability": ("xg", ["performance_sustainability"]),
    "D35_goals_per_shot": ("efficiency", ["goals_per_shot_ratio", "shots_per_goal_ratio"]),
    "D36_big_chances": ("efficiency", ["big_chances_conversion"]),
    "D37_third_efficiency": ("efficiency", ["attacking_third_efficiency", "defensive_third_efficiency"]),
    "D38_defensive_actions": ("efficiency", ["defensive_actions_per_goal_conceded", "clean_sheet_probability"]),
    "D39_pressure_resistance": ("efficiency", ["pressure_resistance"]),
    "D40_match_control": ("efficiency", ["possession_efficiency", "territory_control", "tempo_control"]),
    "D41_tactical_efficiency": ("efficiency", ["tactical_discipline", "game_management", "adaptability_index"]),
    "D42_late_game": ("clutch", list(CL_SQL)[:4]),
    "D43_close_matches": ("clutch", list(CL_SQL)[4:7]),
    "D44_pressure_situations": ("clutch", list(CL_SQL)[7:10]),
    "D45_comebacks": ("clutch", list(CL_SQL)[10:13]),
    "D46_lead_protection": ("clutch", ["lead_protection_ability"]),
    "D47_attacking_style": ("style", list(ST_SQL)[:4]),
    "D48_defensive_style": ("style", list(ST_SQL)[4:8]),
    "D49_tactical_patterns": ("style", list(ST_SQL)[8:12]),
    "D50_game_tempo": ("style", list(ST_SQL)[12:]),
}.items():
    query(_name, family_sql(_family, _cols))(_snap(_family, _cols))


def _families_sql(names, select):
    snaps = ", ".join(f"snap_{f} as ({family_sql(f)})" for f in names)
    cols = ", ".join(
        f"snap_{f}.{n} as {snapshot.FAMILIES[f][1]}{n}" for f in names for n in FAMILY_SQL[f][1])
    first, *rest = names
    joins = "".join(f" join snap_{f} using (team, date)" for f in rest)
    return f"with {snaps}, snap as (select team, date, {cols} from snap_{first}{joins}) {select}"


@query("D51_advanced_defaults", _families_sql(
    ["xg", "efficiency", "clutch", "style"], "select * from snap"))
def advanced_defaults(spark, sf_dir):
    snap = snapshot.team_snapshot(matches(spark, sf_dir), list(snapshot.ADVANCED))
    return rounded(snap.drop("matches_before"))


_RAW = _families_sql(["xg", "efficiency"], "").replace("(round(cast(", "(((cast(").replace(
    " as double), 9) + 0.0::double)", " as double)) + 0.0::double))")
_COMPARE = {
    "xg_advantage_home": "h.xg_avg_xg_for-a.xg_avg_xg_for",
    "xg_defensive_advantage_home": "a.xg_avg_xg_against-h.xg_avg_xg_against",
    "finishing_advantage_home": "h.xg_finishing_quality-a.xg_finishing_quality",
    "xg_consistency_advantage_home": "h.xg_xg_consistency-a.xg_xg_consistency",
    "attacking_efficiency_advantage_home": "h.eff_goals_per_shot_ratio-a.eff_goals_per_shot_ratio",
    "defensive_efficiency_advantage_home":
        "h.eff_defensive_actions_per_goal_conceded-a.eff_defensive_actions_per_goal_conceded",
    "possession_advantage_home": "h.eff_possession_efficiency-a.eff_possession_efficiency",
}


@query("D52_comparatives", (
    f"{_RAW}, {MATCHES_SQL} select m.match_id, "
    + ", ".join(f"{r(e)} as {n}" for n, e in _COMPARE.items())
    + " from m join snap h on h.team=m.home_team and h.date=m.date"
      " join snap a on a.team=m.away_team and a.date=m.date"))
def comparatives(spark, sf_dir):
    out = snapshot.match_features(matches(spark, sf_dir), ["xg", "efficiency"])
    return rounded(out.select("match_id", *_COMPARE))


def _league_family_sql():
    parts, cols = [], []
    for f, (aggs, features, n, gate) in FAMILY_SQL.items():
        parts.append(f"a_{f} as (select team, date, "
                     + ", ".join(f"{e} as {k}" for k, e in aggs.items())
                     + f" from h where age<={n} group by team, date)")
        cols += [f"case when coalesce(c.n,0)>={gate} then {r(e.replace('a.', f'a_{f}.'))} else {d}::double end"
                 f" as {snapshot.FAMILIES[f][1]}{k}" for k, (e, d) in features.items()]
    return (LEAGUE_SQL.format(n=30) + _LEAGUE_SEEN
            + ", c as (select team, date, count(*) as n from h group by team, date), " + ", ".join(parts)
            + " select k.team, k.date, " + ", ".join(cols) + " from k left join c on c.team=k.team and c.date=k.date"
            + "".join(f" left join a_{f} on a_{f}.team=k.team and a_{f}.date=k.date" for f in FAMILY_SQL))


@query("D31_advanced_league", _league_family_sql())
def advanced_league(spark, sf_dir):
    return rounded(snapshot.league_snapshot(matches(spark, sf_dir), list(snapshot.ADVANCED)))
