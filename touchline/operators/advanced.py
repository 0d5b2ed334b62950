"""Advanced families: expected goals, efficiency, clutch and style over a team's last matches.

Every family is a set of aggregates over the last N rows, written against a small interface so the
same definition serves both scopes: window frames on a team's timeline (``TeamFrame``) and sums over
league history (``Moments``).  Random terms of the estimates are replaced by their means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.operators.asof import last_n
from touchline.operators.temporal import KEY, Feature

XG_LAST, EFFICIENCY_LAST, CLUTCH_LAST, STYLE_LAST = 30, 15, 20, 20
XG_GATE, EFFICIENCY_GATE, CLUTCH_GATE, STYLE_GATE = 5, 3, 5, 8

# Means of the random terms in the estimates.
MEAN_EXTRA_SHOTS = 6
MEAN_EXTRA_CHANCES = 1
MEAN_EXTRA_ACTIONS = 5
NO_SPREAD = 1e-20


class TeamFrame:
    """Aggregates over the last n rows of a team's timeline."""

    def __init__(self, n: int):
        self.frame = last_n(KEY, n)

    def mean(self, value: Column) -> Column:
        return F.avg(value).over(self.frame)

    def total(self, value: Column) -> Column:
        return F.sum(value).over(self.frame)

    def count(self, value: Column) -> Column:
        return F.count(value).over(self.frame)

    def variance(self, value: Column) -> Column:
        return F.var_pop(value).over(self.frame)

    def deviation(self, value: Column) -> Column:
        return F.stddev_pop(value).over(self.frame)

    def covariance(self, x: Column, y: Column) -> Column:
        return F.covar_pop(x, y).over(self.frame)


class Moments:
    """The same aggregates as expressions over sums of row terms, which add up over any parts of the rows.

    ``Moments()(n)`` looks at rows of ``age`` up to n. ``terms`` holds what must be summed per row; the aggregates
    then read the summed columns of the same names.
    """

    LEAST = 1e-12      # a smaller variance of values that are tenths at the finest is rounding noise

    def __init__(self, terms: dict[str, Column] | None = None, n: int = 0):
        self.terms = {} if terms is None else terms
        self.n = n

    def __call__(self, n: int) -> Moments:
        return Moments(self.terms, n)

    def _sum(self, value: Column) -> Column:
        name = f"t{len(self.terms)}"
        self.terms[name] = F.when(F.col("age") <= self.n, value)
        return F.col(name)

    def total(self, value: Column) -> Column:
        return self._sum(value.cast("double"))

    def count(self, value: Column) -> Column:
        return self._sum(F.when(value.isNotNull(), 1.0))

    def mean(self, value: Column) -> Column:
        return F.try_divide(self.total(value), self.count(value))

    def covariance(self, x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        n = self.count(x + y)
        spread = F.try_divide(self.total(x * y) - F.try_divide(self.total(x) * self.total(y), n), n)
        return F.when(F.abs(spread) < self.LEAST, 0.0).otherwise(spread)

    def variance(self, value: Column) -> Column:
        return F.greatest(self.covariance(value, value), F.lit(0.0))

    def deviation(self, value: Column) -> Column:
        return F.sqrt(self.variance(value))


def row_columns() -> tuple[Column, Column, Column, Column]:
    return F.col("gf"), F.col("ga"), F.col("gd"), F.col("points")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def choose(*cases: tuple[Column, object], otherwise) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def xg_for() -> Column:
    gf, _, gd, _ = row_columns()
    base = gf * 0.8
    shaped = choose((gd > 0, base + 0.3), (gd < 0, F.greatest(base - 0.2, F.lit(0.1))), otherwise=base)
    return F.greatest(shaped + F.when(F.col("is_home"), 0.1).otherwise(0.0), F.lit(0.1))


def xg_against() -> Column:
    _, ga, gd, _ = row_columns()
    base = ga * 0.8
    shaped = choose((gd > 0, base + 0.2), (gd < 0, base + 0.3), otherwise=base)
    return F.greatest(shaped + F.when(F.col("is_home"), 0.0).otherwise(0.1), F.lit(0.1))


def xg_state(over) -> dict[str, Column]:
    gf, ga, _, _ = row_columns()
    w = over(XG_LAST)
    return {
        "xg_f": w.mean(xg_for()), "xg_a": w.mean(xg_against()),
        "xg_gf": w.mean(gf), "xg_ga": w.mean(ga),
        "xg_var": w.variance(xg_for()), "xg_gvar": w.variance(gf),
        "xg_cov": w.covariance(gf.cast("double"), xg_for()),
        "xg_n": w.count(gf),
    }


def xg_features() -> dict[str, Feature]:
    s = lambda c: F.col(f"s.xg_{c}")
    n = s("n")
    conceded = F.greatest(s("ga") * n, F.lit(0.1))
    # a constant series has no correlation: read as 0
    varied = (s("var") > NO_SPREAD) & (s("gvar") > NO_SPREAD)
    corr = F.when(varied, s("cov") / F.sqrt(s("var") * s("gvar"))).otherwise(0.0)
    values = {
        "avg_xg_for": (s("f"), 1.5), "avg_xg_against": (s("a"), 1.5),
        "avg_actual_goals_for": (s("gf"), 1.5), "avg_actual_goals_against": (s("ga"), 1.5),
        "xg_diff": (s("f") - s("a"), 0.0), "actual_goal_diff": (s("gf") - s("ga"), 0.0),
        "xg_outperformance_for": (s("gf") - s("f"), 0.0),
        "xg_outperformance_against": (s("a") - s("ga"), 0.0),
        "finishing_quality": (clip(s("gf") / s("f") - 1.0, -1.0, 1.0), 0.0),
        "defensive_resilience": (clip(s("a") * n / conceded - 1.0, -1.0, 1.0), 0.0),
        "xg_variance": (s("var"), 0.5), "goal_variance": (s("gvar"), 0.5),
        "xg_consistency": (1.0 / (1.0 + s("var")), 0.5),
        "performance_sustainability": ((corr + 1.0) / 2.0, 0.5),
    }
    return {k: Feature(v, XG_GATE, d) for k, (v, d) in values.items()}


def efficiency_state(over) -> dict[str, Column]:
    gf, ga, gd, _ = row_columns()
    w = over(EFFICIENCY_LAST)
    possession = 50.0 + choose((gd > 0, 10.0), (gd < 0, -10.0), otherwise=0.0)
    return {
        "ef_n": w.count(gf), "ef_gf": w.total(gf), "ef_ga": w.total(ga),
        "ef_att": w.mean(F.least(gf / 3.0, F.lit(1.0))),
        "ef_def": w.mean(F.greatest(1.0 - ga / 3.0, F.lit(0.0))),
        "ef_cs": w.mean(F.when(ga == 0, 1.0).otherwise(0.0)),
        "ef_press": w.mean(choose((ga == 0, 1.0), (ga == 1, 0.7), (ga == 2, 0.4), otherwise=0.1)),
        "ef_poss": w.mean(possession),
        "ef_gd": w.mean(gd),
        "ef_mgmt": w.mean(choose((gd > 0, 0.8), (gd == 0, 0.6), otherwise=0.4)),
    }


def efficiency_features() -> dict[str, Feature]:
    s = lambda c: F.col(f"s.ef_{c}")
    shots = F.greatest(s("gf") * 4 + s("n") * MEAN_EXTRA_SHOTS, F.lit(1))
    chances = F.greatest(s("gf") + s("n") * MEAN_EXTRA_CHANCES, F.lit(1))
    actions = s("n") * (15 + MEAN_EXTRA_ACTIONS)
    values = {
        "goals_per_shot_ratio": (s("gf") / shots, 0.15),
        "shots_per_goal_ratio": (shots / F.greatest(s("gf"), F.lit(1)), 6.0),
        "big_chances_conversion": (s("gf") / chances, 0.4),
        "attacking_third_efficiency": (s("att"), 0.5),
        "defensive_actions_per_goal_conceded": (actions / F.greatest(s("ga"), F.lit(1)), 20.0),
        "clean_sheet_probability": (s("cs"), 0.3),
        "defensive_third_efficiency": (s("def"), 0.5),
        "pressure_resistance": (s("press"), 0.5),
        "possession_efficiency": (s("poss") / 100.0, 0.5),
        "territory_control": (s("poss") * 0.9 / 100.0, 0.5),
        "tempo_control": ((50.0 + s("gd") * 5.0 + 50.0) / 100.0, 0.5),
        "tactical_discipline": (s("def"), 0.5),
        "game_management": (s("mgmt"), 0.5),
        "adaptability_index": (0.5 + s("gd") * 0.1, 0.5),
    }
    return {k: Feature(v, EFFICIENCY_GATE, d) for k, (v, d) in values.items()}


def clutch_state(over) -> dict[str, Column]:
    gf, ga, gd, points = row_columns()
    w = over(CLUTCH_LAST)
    close = F.abs(gd) <= 1
    one_goal = F.abs(gd) == 1
    response = choose((gd >= 0, 0.7 + gd * 0.1), otherwise=0.3 + gd * 0.1)
    stakes = response * F.when(close, 0.7).otherwise(0.5)
    comeback = (gd >= 0) & (ga > 0)
    resilience = choose((comeback & (gd > 0), 1.0), (comeback, 0.5), (ga > 0, 0.2), otherwise=0.8)
    led = gf > 0
    return {
        "cl_n": w.count(gf), "cl_gf": w.mean(gf), "cl_ga": w.mean(ga),
        "cl_close_win": w.mean(F.when(close, F.when(gd > 0, 1.0).otherwise(0.0))),
        "cl_close_pts": w.mean(F.when(close, points)),
        "cl_one_win": w.mean(F.when(one_goal, F.when(gd > 0, 1.0).otherwise(0.0))),
        "cl_resp": w.mean(response), "cl_resp_sd": w.deviation(response),
        "cl_stakes": w.mean(stakes),
        "cl_back": w.mean(F.when(comeback, 1.0).otherwise(0.0)),
        "cl_back_win": w.mean(F.when(comeback, F.when(gd > 0, 1.0).otherwise(0.0))),
        "cl_resil": w.mean(resilience),
        "cl_lead": w.mean(F.when(led, F.when(gd >= 0, 1.0).otherwise(0.0))),
    }


def clutch_features() -> dict[str, Feature]:
    s = lambda c: F.col(f"s.cl_{c}")
    some_close = s("close_win").isNotNull()
    values = {
        "late_game_goals_for": (s("gf") * 0.25, 0.25),
        "late_game_goals_against": (s("ga") * 0.25, 0.25),
        "late_game_goal_differential": ((s("gf") - s("ga")) * 0.25, 0.0),
        "clutch_goal_ratio": (F.lit(0.25), 0.25),
        "close_match_win_rate": (F.when(some_close, s("close_win")).otherwise(0.33), 0.33),
        "close_match_points_per_game": (F.when(some_close, s("close_pts")).otherwise(1.0), 1.0),
        "one_goal_game_performance": (
            F.when(some_close, F.coalesce(s("one_win"), F.lit(0.0))).otherwise(0.5), 0.5),
        "pressure_response_index": (s("resp"), 0.5),
        "high_stakes_performance": (s("stakes"), 0.5),
        "mental_strength_score": (F.least(s("resp") + 1.0 - s("resp_sd"), F.lit(1.0)), 0.5),
        "comeback_frequency": (s("back"), 0.2),
        "comeback_success_rate": (F.coalesce(s("back_win"), F.lit(0.0)), 0.5),
        "resilience_after_conceding": (s("resil"), 0.5),
        "lead_protection_ability": (F.coalesce(s("lead"), F.lit(0.0)), 0.7),
    }
    return {k: Feature(v, CLUTCH_GATE, d) for k, (v, d) in values.items()}


def style_state(over) -> dict[str, Column]:
    gf, ga, gd, points = row_columns()
    w = over(STYLE_LAST)
    share = lambda c: w.mean(F.when(c, 1.0).otherwise(0.0))
    tg = gf + ga
    aggression = choose((gd >= 0, 0.7 + gf * 0.1), otherwise=0.3 + gd * 0.1)
    rhythm = choose((gd >= 0, 0.7 + gf * 0.1), otherwise=0.3)
    return {
        "st_gf": w.mean(gf), "st_ga": w.mean(ga),
        "st_threat": share(gf >= 2),
        "st_variety": w.mean(F.when(gf > 0, F.least(gf / 3.0, F.lit(1.0)))),
        "st_counter": share((gd > 0) & (ga == 0)),
        "st_cs": share(ga == 0),
        "st_aggr": w.mean(clip(aggression, 0.0, 1.0)),
        "st_pts": w.mean(points), "st_pts_sd": w.deviation(points),
        "st_gf_sd": w.deviation(gf),
        "st_many": share(gf > 2),
        "st_tempo": w.mean(choose((tg >= 3, 0.8), (tg == 2, 0.6), otherwise=0.3)),
        "st_rhythm": w.mean(clip(rhythm, 0.0, 1.0)),
        "st_moment": w.mean(clip(0.5 + gd * 0.1, 0.0, 1.0)),
    }


def style_features() -> dict[str, Feature]:
    s = lambda c: F.col(f"s.st_{c}")
    values = {
        "attacking_intensity": (F.least(s("gf") / 2.5, F.lit(1.0)), 0.5),
        "goal_threat_level": (s("threat"), 0.3),
        "attacking_variety": (F.coalesce(s("variety"), F.lit(0.3)), 0.4),
        "counter_attack_propensity": (s("counter"), 0.2),
        "defensive_solidity": (s("cs"), 0.3),
        "defensive_aggression": (s("aggr"), 0.5),
        "pressing_intensity": (F.greatest(1.0 - s("ga") / 3.0, F.lit(0.0)), 0.5),
        "defensive_line_height": ((s("cs") + s("aggr")) / 2.0, 0.5),
        "tactical_flexibility": (clip(1.0 - s("pts_sd") / 1.5, 0.0, 1.0), 0.5),
        "formation_consistency": (clip(1.0 - s("gf_sd") / 2.0, 0.0, 1.0), 0.6),
        "game_control_preference": (s("pts") / 3.0, 0.5),
        "set_piece_effectiveness": (F.least(s("many"), F.lit(0.5)) / 0.5, 0.3),
        "tempo_preference": (s("tempo"), 0.5),
        "rhythm_consistency": (s("rhythm"), 0.5),
        "momentum_management": (s("moment"), 0.5),
    }
    return {k: Feature(v, STYLE_GATE, d) for k, (v, d) in values.items()}


def comparatives() -> dict[str, Column]:
    """Home-minus-away comparisons over a match row carrying both sides."""
    h, a = (lambda c: F.col(f"home_{c}")), (lambda c: F.col(f"away_{c}"))
    return {
        "xg_advantage_home": h("xg_avg_xg_for") - a("xg_avg_xg_for"),
        "xg_defensive_advantage_home": a("xg_avg_xg_against") - h("xg_avg_xg_against"),
        "finishing_advantage_home": h("xg_finishing_quality") - a("xg_finishing_quality"),
        "xg_consistency_advantage_home": h("xg_xg_consistency") - a("xg_xg_consistency"),
        "attacking_efficiency_advantage_home":
            h("eff_goals_per_shot_ratio") - a("eff_goals_per_shot_ratio"),
        "defensive_efficiency_advantage_home":
            h("eff_defensive_actions_per_goal_conceded")
            - a("eff_defensive_actions_per_goal_conceded"),
        "possession_advantage_home": h("eff_possession_efficiency") - a("eff_possession_efficiency"),
    }
