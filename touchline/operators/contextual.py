"""Contextual families: home advantage, head-to-head rivalry, travel fatigue and season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.geo import derby_score, travel_km
from touchline.operators.asof import UNBOUNDED, before, day_state, days_before, last_n, recent_rows, timeline
from touchline.operators.advanced import clip
from touchline.operators.temporal import KEY, Feature

HOME_LAST, HOME_GATE = 50, 5
TRAVEL_LAST, LONG_KM, REST_CAP = 5, 500.0, 14
LOOKBACK_DAYS, SEASON_GATE = 360, 10
H2H_GATE, H2H_LAST = 3, 5
RECENT_YEARS_DAYS = 3 * 365
FORM_DECAY = 0.1
VENUE_EPOCH = 1000


# --- home advantage ----------------------------------------------------------------------------

def with_venue_weights(recent: DataFrame) -> DataFrame:
    """Exponential weights by rank within a venue, as per-row terms a plain frame sum can use.

    The k-th newest home match weighs exp(-0.1 k).  With H the running count of home matches that
    is exp(0.1 (H_row - H_end)); H is cut into epochs so the exponent stays small, and the two
    epochs one frame can touch are told apart by parity.
    """
    line = timeline(KEY)
    for venue, here in (("home", F.col("is_home")), ("away", ~F.col("is_home"))):
        recent = recent.withColumn(f"{venue}_i", F.sum(here.cast("int")).over(
            line.rowsBetween(UNBOUNDED, 0)))
    for venue in ("home", "away"):
        recent = recent.withColumn(
            f"{venue}_w", F.exp(FORM_DECAY * (F.col(f"{venue}_i") % VENUE_EPOCH)))
    return recent


def _strength_sums(venue: str, here: Column) -> dict[str, Column]:
    """Frame sums of weight × value and of weight, apart for even and odd epochs."""
    frame = last_n(KEY, HOME_LAST)
    v = venue[0]
    value = F.when(F.col("gd") > 0, 1.0).otherwise(0.0) + F.col("gd") * 0.1
    parity = F.floor(F.col(f"{venue}_i") / VENUE_EPOCH) % 2
    out = {f"{v}_parity": parity}
    for which in (0, 1):
        weight = F.when(here & (parity == which), F.col(f"{venue}_w")).otherwise(0.0)
        out[f"{v}_sum{which}"] = F.sum(weight * value).over(frame)
        out[f"{v}_weight{which}"] = F.sum(weight).over(frame)
    return out


def _venue_strength(venue: str) -> Column:
    s = lambda c: F.col(f"s.{venue}_{c}")
    older = F.exp(F.lit(-FORM_DECAY * VENUE_EPOCH))

    def blended(name: str) -> Column:
        even, odd = s(f"{name}0"), s(f"{name}1")
        return F.when(s("parity") == 0, even + odd * older).otherwise(odd + even * older)

    return F.try_divide(blended("sum"), blended("weight"))


def home_state() -> dict[str, Column]:
    frame = last_n(KEY, HOME_LAST)
    at_home = F.col("is_home")
    out = {}
    for venue, here in (("h", at_home), ("a", ~at_home)):
        won = F.when(F.col("gd") > 0, 1.0).otherwise(0.0)
        out |= {
            f"{venue}_n": F.count(F.when(here, 1)).over(frame),
            f"{venue}_win": F.avg(F.when(here, won)).over(frame),
            f"{venue}_gf": F.avg(F.when(here, F.col("gf"))).over(frame),
            f"{venue}_ga": F.avg(F.when(here, F.col("ga"))).over(frame),
            f"{venue}_gdvar": F.var_samp(F.when(here, F.col("gd"))).over(frame),
        }
    return out | _strength_sums("home", at_home) | _strength_sums("away", ~at_home)


def home_grouped() -> dict[str, Column]:
    """The same aggregates inside groupBy(team, date) over rows with ``age`` and venue rank."""
    out = {}
    for venue, here in (("h", F.col("is_home")), ("a", ~F.col("is_home"))):
        won = F.when(F.col("gd") > 0, 1.0).otherwise(0.0)
        weight = F.when(here, F.exp(-FORM_DECAY * (F.col("venue_rank") - 1)))
        value = won + F.col("gd") * 0.1
        out |= {
            f"{venue}_n": F.count(F.when(here, 1)),
            f"{venue}_win": F.avg(F.when(here, won)),
            f"{venue}_gf": F.avg(F.when(here, F.col("gf"))),
            f"{venue}_ga": F.avg(F.when(here, F.col("ga"))),
            f"{venue}_gdvar": F.var_samp(F.when(here, F.col("gd"))),
            f"{venue}_str": F.try_divide(F.sum(weight * value), F.sum(weight)),
        }
    return out


def home_features(in_window: Column | None = None) -> dict[str, Feature]:
    """``in_window``: matches in the league's last-50 window; None reads the team's own timeline."""
    s = lambda c: F.col(f"s.{c}")
    both = (s("h_n") > 0) & (s("a_n") > 0)
    own = in_window is None
    total = s("h_n") + s("a_n") if own else in_window
    strength = {v: _venue_strength(v) if own else s(f"{v}_str") for v in ("h", "a")}
    values = {
        "home_advantage_win_rate": (s("h_win") - s("a_win"), 0.0),
        "home_advantage_goals_for": (s("h_gf") - s("a_gf"), 0.0),
        "home_advantage_goals_against": (s("a_ga") - s("h_ga"), 0.0),
        "home_advantage_goal_diff": ((s("h_gf") - s("h_ga")) - (s("a_gf") - s("a_ga")), 0.0),
        "home_matches_ratio": (s("h_n") / total, 0.5),
        "home_form_strength": (strength["h"], 0.0),
        "away_form_strength": (strength["a"], 0.0),
        "venue_consistency": (1.0 / (1.0 + F.abs(s("h_gdvar") - s("a_gdvar"))), 0.5),
    }
    return {k: Feature(F.when(both, v).otherwise(F.lit(d)), HOME_GATE, d)
            for k, (v, d) in values.items()}


# --- travel ------------------------------------------------------------------------------------

def travel_state() -> dict[str, Column]:
    """Totals of the last trips; dates and distances stay raw, fatigue is finished at the probe."""
    frame = last_n(KEY, TRAVEL_LAST)
    return {
        "tr_n": F.count(F.lit(1)).over(frame),
        "tr_total": F.sum("km").over(frame),
        "tr_long": F.sum(F.when(F.col("km") > LONG_KM, 1.0).otherwise(0.0)).over(frame),
        "tr_last": F.col("date"),
        "tr_trips": F.collect_list(F.struct("date", "km")).over(frame),
    }


def rest_adequacy(days: Column, km: Column) -> Column:
    needed = 2 + F.when(km > LONG_KM, km / 1000).otherwise(0.0)
    return F.least(days / needed, F.lit(1.0))


def travel_features() -> dict[str, Feature]:
    """Features of the trip-independent part; the current trip needs the match, see ``trip``."""
    s = lambda c: F.col(f"s.tr_{c}")
    fatigue = F.aggregate(
        s("trips"), F.lit(0.0),
        lambda acc, t: acc + t["km"] / 1000 * F.pow(
            F.lit(0.8), F.datediff(F.col("date"), t["date"]) / 7))
    rest = F.datediff(F.col("date"), s("last"))
    return {
        "rest_days": Feature(rest.cast("double"), 1, None),
        "days_since_last_match": Feature(F.least(rest, F.lit(REST_CAP)).cast("double"), 1, 7.0),
        "recent_total_travel": Feature(s("total"), 1, 0.0),
        "avg_recent_travel": Feature(s("total") / s("n"), 1, 0.0),
        "travel_frequency": Feature(s("long") / s("n"), 1, 0.0),
        "cumulative_fatigue": Feature(F.least(fatigue, F.lit(1.0)), 1, 0.0),
    }


def trip(team: Column, venue_team: Column, rest_days: Column) -> dict[str, Column]:
    """Current-trip features; a team without history gets the neutral defaults."""
    km = travel_km(team, venue_team)
    known = rest_days.isNotNull()
    return {
        "current_travel_distance": F.when(known, km).otherwise(0.0),
        "is_long_distance_travel": F.when(known & (km > LONG_KM), 1.0).otherwise(0.0),
        "rest_adequacy": F.when(known, rest_adequacy(rest_days, km)).otherwise(1.0),
    }


# --- season ------------------------------------------------------------------------------------

def season_progress(date: Column) -> Column:
    """Position in the August 1 .. May 31 season, 0..1."""
    start_year = F.year(date) - F.when(F.month(date) >= 8, 0).otherwise(1)
    start = F.make_date(start_year, F.lit(8), F.lit(1))
    end = F.make_date(start_year + 1, F.lit(5), F.lit(31))
    return clip(F.datediff(date, start) / F.datediff(end, start), 0.0, 1.0)


def calendar_flags(date: Column) -> dict[str, Column]:
    month, day = F.month(date), F.dayofmonth(date)

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    return {
        "month_of_year": month.cast("double"),
        "is_winter_period": flag(month.isin(12, 1, 2)),
        "is_spring_period": flag(month.isin(3, 4, 5)),
        "is_summer_period": flag(month.isin(6, 7, 8)),
        "is_autumn_period": flag(month.isin(9, 10, 11)),
        "christmas_period": flag((month == 12) & (day > 15)),
        "new_year_period": flag((month == 1) & (day < 15)),
    }


def performance(points: Column, goal_diff: Column, n: Column) -> Column:
    return clip((points / n + goal_diff / n + 3) / 6, 0.0, 1.0)


def season_state() -> dict[str, Column]:
    home_points = F.when(F.col("is_home"), F.col("points")).otherwise(
        F.when(F.col("gd") > 0, 0).when(F.col("gd") == 0, 1).otherwise(3))
    return {
        "se_last10": F.collect_list(F.struct(
            F.col("venue_team").alias("home"), home_points.alias("points"))).over(last_n(KEY, 10)),
        "se_pts5": F.sum("points").over(last_n(KEY, 5)),
        "se_gd5": F.sum("gd").over(last_n(KEY, 5)),
    }


def season_asof() -> dict[str, Column]:
    look = days_before(KEY, LOOKBACK_DAYS)
    return {
        "lb_n": F.coalesce(F.sum("n_day").over(look), F.lit(0)),
        "lb_points": F.coalesce(F.sum("points_day").over(look), F.lit(0)),
        "lb_gd": F.coalesce(F.sum("gd_day").over(look), F.lit(0)),
        "lb_first": F.first("first_day", ignorenulls=True).over(look),
    }


def late_half(asof: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add ``late_points``/``late_gd``: sums over the later half of the 360-day history.

    The half point is a position on the team's timeline, so the sums up to it are one equi-join on
    (team, position) against running totals.
    """
    split = F.col("n") - F.col("lb_n") + F.floor(F.col("lb_n") / 2)
    marks = ranked.select(
        KEY, F.col("run_one").alias("split"),
        F.col("run_points").alias("mark_points"), F.col("run_gd").alias("mark_gd"))
    return (
        asof.withColumn("split", F.when(F.col("lb_n") >= SEASON_GATE, split))
        .join(marks, [KEY, "split"], "left")
        .withColumn("late_points", F.col("h_points") - F.col("mark_points"))
        .withColumn("late_gd", F.col("h_gd") - F.col("mark_gd"))
        .drop("split", "mark_points", "mark_gd")
    )


def season_features() -> dict[str, Column]:
    """Season features need the 360-day gate, so they come as finished columns."""
    date = F.col("date")
    progress = season_progress(date)
    enough = F.col("lb_n") >= SEASON_GATE
    own = F.transform(
        F.filter(F.col("s.se_last10"),
                 lambda r: (r["home"] == F.col("lb_first.home_team"))
                 | (r["home"] == F.col("lb_first.away_team"))),
        lambda r: r["points"].cast("double"))
    size = F.size(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)
    spread = F.when(size > 0, (size * squares - total * total) / (size * size)).otherwise(0.0)
    pressure = F.least(progress * progress + spread / 9 * 0.5, F.lit(1.0))

    late_n = F.col("lb_n") - F.floor(F.col("lb_n") / 2)
    early_n = F.floor(F.col("lb_n") / 2)
    late = performance(F.col("late_points"), F.col("late_gd"), late_n)
    early = performance(F.col("lb_points") - F.col("late_points"),
                        F.col("lb_gd") - F.col("late_gd"), F.greatest(early_n, F.lit(1)))
    trend = clip(late - early, -1.0, 1.0)

    month, day = F.month(date), F.dayofmonth(date)
    recent = performance(F.col("s.se_pts5"), F.col("s.se_gd5"), F.lit(5.0))
    motivation = (
        0.5
        + F.when(progress < 0.2, 0.2).when(progress > 0.8, 0.3).otherwise(0.0)
        + F.when(recent < 0.3, 0.2).when(recent > 0.7, 0.1).otherwise(0.0)
        - F.when(((month == 12) & (day > 20)) | ((month == 1) & (day < 10)), 0.1).otherwise(0.0)
    )
    return {
        "season_progress": progress,
        **calendar_flags(date),
        "end_season_pressure": F.when(enough, pressure).otherwise(0.5),
        "seasonal_form_trend": F.when(enough, trend).otherwise(0.0),
        "motivation_index": F.when(enough, clip(motivation, 0.0, 1.0)).otherwise(0.5),
    }


# --- head to head ------------------------------------------------------------------------------

# Head-to-head figures of pairs that met fewer than three times.
H2H_DEFAULTS = {
    "h2h_total_matches": 0.0, "h2h_home_team_wins": 0.0, "h2h_away_team_wins": 0.0,
    "h2h_draws": 0.0, "h2h_home_team_win_rate": 0.33, "h2h_away_team_win_rate": 0.33,
    "h2h_draw_rate": 0.33, "h2h_recent_form_home": 0.33, "h2h_avg_goals_home_team": 1.5,
    "h2h_avg_goals_away_team": 1.5, "h2h_competitive_balance": 0.5, "h2h_match_volatility": 1.0,
}


def with_pair(matches: DataFrame) -> DataFrame:
    lo = F.least("home_team", "away_team")
    return matches.withColumn("pair", F.struct(lo.alias("lo"), F.greatest("home_team", "away_team").alias("hi"))) \
        .withColumn("home_is_lo", F.col("home_team") == lo)


def pair_snapshot(matches: DataFrame, as_of, probes: DataFrame | None = None) -> DataFrame:
    """Per (pair, date): the pair's meetings before that date, oriented to its smaller name."""
    base = with_pair(matches).withColumn(
        "finished", F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    points = base if probes is None else base.unionByName(
        with_pair(probes).withColumn("finished", F.lit(False)), allowMissingColumns=True)
    lo_goals = F.when(F.col("home_is_lo"), F.col("home_score")).otherwise(F.col("away_score"))
    hi_goals = F.when(F.col("home_is_lo"), F.col("away_score")).otherwise(F.col("home_score"))
    points = points.select(
        "match_id", "date", "pair", "finished", lo_goals.alias("lo"), hi_goals.alias("hi"))
    gap = F.abs(F.col("lo") - F.col("hi"))
    days = points.groupBy("pair", "date").agg(
        F.count_if("finished").alias("n"),
        F.count_if(F.col("lo") > F.col("hi")).alias("lo_wins"),
        F.count_if(F.col("lo") < F.col("hi")).alias("hi_wins"),
        F.sum("lo").alias("lo_goals"), F.sum("hi").alias("hi_goals"),
        F.sum(gap).alias("gap"), F.sum(gap * gap).alias("gap2"),
        F.count_if(F.col("finished") & (F.col("date") > F.date_sub(as_of, RECENT_YEARS_DAYS)))
        .alias("n3y"),
    )
    recent = recent_rows(points.where("finished"), "pair", H2H_LAST)
    frame = last_n("pair", H2H_LAST)
    state = day_state(recent, "pair", {
        "lo5": F.avg(F.when(F.col("lo") > F.col("hi"), 1.0).otherwise(0.0)).over(frame),
        "hi5": F.avg(F.when(F.col("lo") < F.col("hi"), 1.0).otherwise(0.0)).over(frame),
    })
    w = before("pair")
    sums = ["n", "lo_wins", "hi_wins", "lo_goals", "hi_goals", "gap", "gap2", "n3y"]
    return days.join(state, ["pair", "date"], "left").select(
        "pair", "date",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(c) for c in sums],
        F.last("state", ignorenulls=True).over(w).alias("s"),
    )


def h2h_features() -> dict[str, Column]:
    """Columns over a match row (with ``pair``, ``home_is_lo``) joined to the pair snapshot."""
    def oriented(name: str, side: str) -> Column:
        mine, other = ("lo", "hi") if side == "home" else ("hi", "lo")
        return F.when(F.col("home_is_lo"), F.col(name.format(mine))).otherwise(
            F.col(name.format(other)))

    n = F.col("n")
    home_wins, away_wins = oriented("{}_wins", "home"), oriented("{}_wins", "away")
    draws = n - F.col("lo_wins") - F.col("hi_wins")
    values = {
        "h2h_total_matches": n,
        "h2h_home_team_wins": home_wins, "h2h_away_team_wins": away_wins, "h2h_draws": draws,
        "h2h_home_team_win_rate": home_wins / n, "h2h_away_team_win_rate": away_wins / n,
        "h2h_draw_rate": draws / n,
        "h2h_recent_form_home": oriented("s.{}5", "home"),
        "h2h_avg_goals_home_team": oriented("{}_goals", "home") / n,
        "h2h_avg_goals_away_team": oriented("{}_goals", "away") / n,
        "h2h_competitive_balance": 1.0 - F.abs(F.col("lo_wins") - F.col("hi_wins")) / n,
        "h2h_match_volatility": F.sqrt(n * F.col("gap2") - F.col("gap") * F.col("gap")) / n,
    }
    derby = derby_score(F.col("home_team"), F.col("away_team"))
    intensity = (
        F.least(n / 20, F.lit(1.0)) * 0.3 + F.least(F.col("n3y") / 6, F.lit(1.0)) * 0.3
        + F.greatest(1.0 - F.col("gap") / n / 3, F.lit(0.0)) * 0.2 + derby * 0.5
    )
    out = {k: F.when(n >= H2H_GATE, v).otherwise(F.lit(H2H_DEFAULTS[k])) for k, v in values.items()}
    out["is_derby"] = derby
    out["rivalry_intensity"] = F.when(n > 0, F.least(intensity, F.lit(1.0))).otherwise(0.0)
    return out


def attach_h2h(matches: DataFrame, as_of, probes: DataFrame | None = None,
               onto: DataFrame | None = None) -> DataFrame:
    rows = with_pair(onto if onto is not None else (matches if probes is None else probes))
    snapshot = pair_snapshot(matches, as_of, probes)
    keep = [c for c in rows.columns if c not in ("pair", "home_is_lo")]
    return rows.join(snapshot, ["pair", "date"], "left").select(
        *keep, *[c.alias(k) for k, c in h2h_features().items()])
