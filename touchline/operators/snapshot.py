"""Builds the (team, date) snapshot table for any choice of families and attaches it to matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.geo import travel_km
from touchline.operators import advanced, contextual, temporal
from touchline.operators.asof import (
    before, day_state, league_recent, match_sides, recent_rows, running_totals, timeline,
    with_outcome,
)
from touchline.operators.temporal import KEY, Feature
from touchline.session import stored

# family -> (rows needed per date, prefix of its columns on a match row)
FAMILIES = {
    "rolling": (max(temporal.ROLLING_WINDOWS), ""),
    "momentum": (10, ""),
    "form": (max(temporal.FORM_WINDOWS), ""),
    "streaks": (5, ""),
    "home": (contextual.HOME_LAST, ""),
    "travel": (contextual.TRAVEL_LAST, "travel_"),
    "season": (10, "seasonal_"),
    "xg": (advanced.XG_LAST, "xg_"),
    "efficiency": (advanced.EFFICIENCY_LAST, "eff_"),
    "clutch": (advanced.CLUTCH_LAST, "clutch_"),
    "style": (advanced.STYLE_LAST, "style_"),
}
TEMPORAL = ("rolling", "momentum", "form", "streaks")
CONTEXTUAL = ("home", "travel", "season")
ADVANCED = ("xg", "efficiency", "clutch", "style")

_STATES = {
    "rolling": temporal.rolling_state,
    "momentum": temporal.momentum_state,
    "form": temporal.form_state,
    "streaks": temporal.streak_state,
    "home": contextual.home_state,
    "travel": contextual.travel_state,
    "season": contextual.season_state,
    "xg": lambda: advanced.xg_state(advanced.TeamFrame),
    "efficiency": lambda: advanced.efficiency_state(advanced.TeamFrame),
    "clutch": lambda: advanced.clutch_state(advanced.TeamFrame),
    "style": lambda: advanced.style_state(advanced.TeamFrame),
}
_FEATURES = {
    "rolling": temporal.rolling_features,
    "momentum": temporal.momentum_features,
    "form": temporal.form_features,
    "streaks": temporal.streak_features,
    "home": contextual.home_features,
    "travel": contextual.travel_features,
    "xg": advanced.xg_features,
    "efficiency": advanced.efficiency_features,
    "clutch": advanced.clutch_features,
    "style": advanced.style_features,
}


def gated(features: dict[str, Feature]) -> dict[str, Column]:
    enough = {g: F.col("n") >= g for g in {f.gate for f in features.values()}}
    return {name: F.when(enough[f.gate], f.value).otherwise(f.default) for name, f in features.items()}


def family_columns(family: str) -> dict[str, Column]:
    if family == "season":
        return contextual.season_features()
    return gated(_FEATURES[family]())


def _prepared(rows: DataFrame, families: Sequence[str]) -> DataFrame:
    recent = recent_rows(rows, KEY, max(FAMILIES[f][0] for f in families))
    if "travel" in families:
        recent = recent.withColumn("km", F.when(F.col("is_home"), 0.0).otherwise(
            travel_km(F.col("team"), F.col("venue_team"))))
    if "form" in families:
        recent = recent.withColumn("form", temporal.form_score())
    if {"form", "momentum"} & set(families):
        recent = recent.withColumn("pos", F.row_number().over(timeline(KEY)))
    if "home" in families:
        recent = contextual.with_venue_weights(recent)
    return recent


def team_snapshot(
    matches: DataFrame, families: Sequence[str], probes: DataFrame | None = None,
) -> DataFrame:
    """Features of every team as it stood strictly before each date it is asked about."""
    sides = match_sides(matches)
    rows = with_outcome(sides)
    asked = sides
    if probes is not None:
        asked = sides.unionByName(match_sides(probes).withColumn("finished", F.lit(False)))
    gd = F.col("gf") - F.col("ga")
    won, drawn = F.col("finished") & (gd > 0), F.col("finished") & (gd == 0)
    points = F.when(won, 3).when(drawn, 1).otherwise(0)
    names = F.when(F.col("finished"), F.struct(
        F.when(F.col("is_home"), F.col("team")).otherwise(F.col("opponent")).alias("home_team"),
        F.when(F.col("is_home"), F.col("opponent")).otherwise(F.col("team")).alias("away_team")))
    days = asked.groupBy(KEY, "date").agg(
        F.count_if("finished").alias("n_day"),
        F.sum(points).alias("points_day"), F.sum(points * points).alias("points2_day"),
        F.count_if(won).alias("wins_day"), F.count_if(drawn).alias("draws_day"),
        F.sum(F.when(F.col("finished"), gd)).alias("gd_day"),
        F.min_by(names, F.when(F.col("finished"), F.col("match_id"))).alias("first_day"),
    )
    columns = {}
    for family in families:
        columns |= _STATES[family]()
    days = days.join(day_state(_prepared(rows, families), KEY, columns), [KEY, "date"], "left")
    w = before(KEY)
    history = {
        "n": "n_day", "h_points": "points_day", "h_points2": "points2_day",
        "h_wins": "wins_day", "h_draws": "draws_day", "h_gd": "gd_day",
    }
    extra: dict[str, Column] = {}
    if "momentum" in families:
        days = temporal.with_decayed_history(days.join(temporal.decayed_days(rows), [KEY, "date"], "left"))
        extra["h_decayed"] = F.coalesce(F.lag("decayed").over(Window.partitionBy(KEY).orderBy("date")), F.lit(0.0))
    if "streaks" in families:
        days = days.join(temporal.streak_days(rows), [KEY, "date"], "left")
        extra |= temporal.streak_asof()
    if "season" in families:
        extra |= contextual.season_asof()
    asof = days.select(
        KEY, "date",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in history.items()],
        F.last("state", ignorenulls=True).over(w).alias("s"),
        *[c.alias(n) for n, c in extra.items()],
    )
    if "season" in families:
        ranked = running_totals(
            rows.select(KEY, "date", "match_id", F.lit(1).alias("one"), "points", "gd"),
            KEY, ["one", "points", "gd"])
        asof = contextual.late_half(asof, ranked)
    return asof.select(
        KEY, "date", F.col("n").alias("matches_before"),
        *[c.alias(FAMILIES[f][1] + name) for f in families for name, c in family_columns(f).items()],
    )


def attach_sides(matches: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Join the snapshot twice, as ``home_*`` and ``away_*`` columns."""
    features = [c for c in snapshot.columns if c not in (KEY, "date")]
    out = matches
    for side in ("home", "away"):
        mine = snapshot.select(
            F.col(KEY).alias(f"{side}_team"), "date",
            *[F.col(c).alias(f"{side}_{c}") for c in features])
        out = out.join(mine, [f"{side}_team", "date"], "left")
    return out


def finish_travel(rows: DataFrame) -> DataFrame:
    """Replace the raw rest days of both sides by the current-trip features."""
    for side in ("home", "away"):
        made = contextual.trip(F.col(f"{side}_team"), F.col("home_team"),
                               F.col(f"{side}_travel_rest_days"))
        rows = rows.withColumns({f"{side}_travel_{k}": c for k, c in made.items()})
        rows = rows.drop(f"{side}_travel_rest_days")
    return rows


def match_features(
    matches: DataFrame, families: Sequence[str], as_of=None, probes: DataFrame | None = None,
) -> DataFrame:
    """One row per match (or per probe) with every feature of the chosen families.

    The snapshot is written once and read by both sides, so its windows run once and the join plan
    stays small.
    """
    target = matches if probes is None else probes
    snapshot = stored(
        team_snapshot(matches, families, probes).drop("matches_before"), "snapshot")
    out = attach_sides(target, snapshot)
    if "travel" in families:
        out = finish_travel(out)
    if as_of is not None:
        out = contextual.attach_h2h(matches, as_of, probes, onto=out)
    if {"rolling", "momentum", "form"} <= set(families):
        out = out.withColumns(temporal.differentials())
    if {"xg", "efficiency"} <= set(families):
        out = out.withColumns(advanced.comparatives())
    return out


_LEAGUE_STATES = {"xg": advanced.xg_state, "efficiency": advanced.efficiency_state,
                  "clutch": advanced.clutch_state, "style": advanced.style_state}


def _seen_from(recent: DataFrame, hosted: bool, *keep: str | Column) -> DataFrame:
    """League rows as the host sees them, or as everybody else does: from the away side."""
    gf, ga = ("home_score", "away_score") if hosted else ("away_score", "home_score")
    gd = F.col(gf) - F.col(ga)
    return recent.select(
        "date", "age", *keep, F.lit(hosted).alias("is_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"),
        gd.alias("gd"), F.when(gd > 0, 3).when(gd == 0, 1).otherwise(0).alias("points"))


def _league_sums(recent: DataFrame, terms: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Sums of the terms per date as a team that hosted nothing sees them, and per (team, date) what a host adds."""
    away = _seen_from(recent, False, "home_team")
    base = away.groupBy("date").agg(F.count("age").alias("n"), *[F.sum(c).alias(k) for k, c in terms.items()])
    gone = away.select(F.col("home_team").alias(KEY), "date", *[(-c).alias(k) for k, c in terms.items()])
    own = _seen_from(recent, True, "home_team").select(
        F.col("home_team").alias(KEY), "date", *[c.alias(k) for k, c in terms.items()])
    changes = [F.count(F.lit(1)).alias("hosted"), *[F.sum(k).alias(f"own_{k}") for k in terms]]
    return base, own.unionByName(gone).groupBy(KEY, "date").agg(*changes)


def league_snapshot(matches: DataFrame, families: Sequence[str]) -> DataFrame:
    """League-wide scope: the last N matches of everybody before the date, seen by each team.

    A match the team did not host is read from the away side, as the league-wide rule has it. Rows are summed once
    per date for a team that hosted none of them, and a host's own matches correct that sum; so rows grow with
    dates times N and with the (team, date) keys, not with their product.
    """
    keys = match_sides(matches).select(KEY, "date").distinct()
    n = max(FAMILIES[f][0] for f in families)
    recent = stored(league_recent(matches, keys, n).select(
        "date", "age", "home_team", "away_team", "home_score", "away_score"), "league")
    moments = advanced.Moments()
    columns = {}
    for family in families:
        if family != "home":
            columns |= _LEAGUE_STATES[family](moments)
    base, own = _league_sums(recent, moments.terms)
    out = keys.join(base, "date", "left").join(own, [KEY, "date"], "left").select(
        KEY, "date", F.coalesce("n", F.lit(0)).alias("n"),
        *[(F.coalesce(t, F.lit(0.0)) + F.coalesce(f"own_{t}", F.lit(0.0))).alias(t) for t in moments.terms])
    out = out.select(KEY, "date", "n", *[c.alias(k) for k, c in columns.items()])
    state = list(columns)
    if "home" in families:
        sides = _seen_from(recent, True, F.col("home_team").alias(KEY)).unionByName(
            _seen_from(recent, False, F.col("away_team").alias(KEY)))
        venue = Window.partitionBy(KEY, "date", "is_home").orderBy("age")
        ranked = sides.where(F.col("age") <= contextual.HOME_LAST).withColumn("venue_rank", F.row_number().over(venue))
        home = contextual.home_grouped()
        out = out.join(
            ranked.groupBy(KEY, "date").agg(*[c.alias(k) for k, c in home.items()]),
            [KEY, "date"], "left").na.fill(0, ["h_n", "a_n"])
        state += list(home)
    out = out.select(KEY, "date", "n", F.struct(*state).alias("s"))
    made = {}
    for family in families:
        if family == "home":
            window = F.least(F.col("n"), F.lit(contextual.HOME_LAST))
            found = gated(contextual.home_features(window))
        else:
            found = family_columns(family)
        made |= {FAMILIES[family][1] + k: c for k, c in found.items()}
    return out.select(KEY, "date", *[c.alias(k) for k, c in made.items()])
