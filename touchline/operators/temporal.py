"""Temporal families: rolling stats, momentum, form and streaks of one team before a date."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators.asof import UNBOUNDED, before, id_block_of, last_n, running_totals, timeline

KEY = "team"
ROLLING_WINDOWS = (3, 5, 10, 20)
FORM_WINDOWS = (5, 10, 15)
MOMENTUM_DECAY = 0.95
# Weights of the last five results, oldest first.
RECENT_WEIGHTS = (0.5, 0.7, 0.9, 1.0, 1.2)


class Feature(NamedTuple):
    value: Column      # over the as-of row: state struct ``s``, ``n`` and additive history
    gate: int          # finished matches needed
    default: float | None


def _rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


# --- rolling -----------------------------------------------------------------------------------

ROLLING_STATS = {
    "goals_per_game": (lambda: F.avg("gf"), 1.0),
    "goals_conceded_per_game": (lambda: F.avg("ga"), 1.0),
    "goal_difference_per_game": (lambda: F.avg("gd"), 0.0),
    "win_rate": (lambda: _rate(F.col("gd") > 0), 0.33),
    "draw_rate": (lambda: _rate(F.col("gd") == 0), 0.33),
    "loss_rate": (lambda: _rate(F.col("gd") < 0), 0.33),
    "points_per_game": (lambda: F.avg("points"), 1.0),
    "clean_sheet_rate": (lambda: _rate(F.col("ga") == 0), 0.25),
    "failed_to_score_rate": (lambda: _rate(F.col("gf") == 0), 0.25),
    "over_2_5_rate": (lambda: _rate(F.col("gf") + F.col("ga") > 2), 0.5),
    "under_1_5_rate": (lambda: _rate(F.col("gf") + F.col("ga") < 2), 0.25),
}


def rolling_state() -> dict[str, Column]:
    aggregates = {stat: agg() for stat, (agg, _) in ROLLING_STATS.items()}
    out = {}
    for n in ROLLING_WINDOWS:
        frame = last_n(KEY, n)
        out |= {f"{stat}_{n}g": a.over(frame) for stat, a in aggregates.items()}
    return out


def rolling_features() -> dict[str, Feature]:
    return {
        f"{stat}_{n}g": Feature(F.col(f"s.{stat}_{n}g"), min(ROLLING_WINDOWS), default)
        for n in ROLLING_WINDOWS for stat, (_, default) in ROLLING_STATS.items()
    }


# --- momentum ----------------------------------------------------------------------------------

def decayed_days(rows: DataFrame) -> DataFrame:
    """``day_decayed``: sum of points * q**age over the matches of one (team, date), age 0 being its last match.

    Ages are counted inside blocks of ids, and a block's sum is then aged by the matches of the date's later
    blocks, so a date with any number of matches is never one window.
    """
    q = F.lit(MOMENTUM_DECAY)
    rows = rows.select(KEY, "date", "match_id", "points").withColumn("blk", id_block_of(rows, [KEY, "date"]))
    newest = Window.partitionBy(KEY, "date", "blk").orderBy(F.col("match_id").desc())
    blocks = rows.withColumn("age", F.row_number().over(newest) - 1).groupBy(KEY, "date", "blk").agg(
        F.sum(F.col("points") * F.pow(q, F.col("age"))).alias("decayed"), F.count(F.lit(1)).alias("n"))
    later = F.coalesce(F.sum("n").over(
        Window.partitionBy(KEY, "date").orderBy(F.col("blk").desc()).rowsBetween(UNBOUNDED, -1)), F.lit(0))
    return blocks.withColumn("later", later).groupBy(KEY, "date").agg(
        F.sum(F.col("decayed") * F.pow(q, F.col("later"))).alias("day_decayed"))


def with_decayed_history(days: DataFrame) -> DataFrame:
    """``decayed``: the decayed sum over a team's whole history up to and with each date.

    A stretch of dates is summarised by its decayed sum and its number of matches; two neighbouring stretches make
    one: (older * q**matches of the newer + newer, matches added). Doubling the stretch each step, a date
    reaches back over all dates in as many steps as the calendar has binary digits. No match is left out.
    """
    span = days.agg(F.datediff(F.max("date"), F.min("date")).alias("d")).first()["d"] or 0
    line = Window.partitionBy(KEY).orderBy("date")
    out = days.withColumns({"decayed": F.coalesce("day_decayed", F.lit(0.0)), "reach": F.col("n_day").cast("double")})
    for step in range(span.bit_length()):
        older, length = F.lag("decayed", 1 << step).over(line), F.lag("reach", 1 << step).over(line)
        out = out.select(*days.columns, "decayed", "reach", older.alias("older"), length.alias("length")).select(
            *days.columns,
            (F.col("decayed") + F.coalesce(F.col("older") * F.pow(F.lit(MOMENTUM_DECAY), F.col("reach")), F.lit(0.0))).alias("decayed"),
            (F.col("reach") + F.coalesce("length", F.lit(0.0))).alias("reach"))
    return out.drop("reach", "day_decayed")


def momentum_state() -> dict[str, Column]:
    line = timeline(KEY)
    newest_first = tuple(reversed(RECENT_WEIGHTS))
    lagged = [F.lag("points", k).over(line) if k else F.col("points") for k in range(5)]
    weighted = sum(
        (F.coalesce(v, F.lit(0)) * w for v, w in zip(lagged, newest_first, strict=True)), F.lit(0.0))
    weights = sum(
        (F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(lagged, newest_first, strict=True)),
        F.lit(0.0))
    return {
        "trend": _slope(F.col("points").cast("double"), 10),
        "strength": weighted / weights / 3.0,
        "spread10": F.stddev_pop("points").over(last_n(KEY, 10)),
    }


def _slope(value: Column, n: int) -> Column:
    """Least-squares slope of the last n values against their position."""
    return F.regr_slope(value, F.col("pos").cast("double")).over(last_n(KEY, n))


def momentum_features() -> dict[str, Feature]:
    n = F.col("n").cast("double")
    weight = (1 - F.pow(F.lit(MOMENTUM_DECAY), n)) / (1 - MOMENTUM_DECAY)
    variance = (n * F.col("h_points2") - F.col("h_points") * F.col("h_points")) / (n * n)
    return {
        "momentum_points": Feature(F.col("h_decayed") / weight, 3, 1.0),
        "momentum_trend": Feature(F.col("s.trend"), 3, 0.0),
        "recent_form_strength": Feature(F.col("s.strength"), 3, 0.5),
        "consistency": Feature(1.0 / (1.0 + variance), 3, 0.5),
        "volatility": Feature(
            F.when(F.col("n") >= 10, F.col("s.spread10")).otherwise(1.0), 3, 1.0),
    }


# --- form --------------------------------------------------------------------------------------

def form_score() -> Column:
    """Per-match form: result, margin (tanh) and a small venue correction, clipped to 0..1."""
    base = F.when(F.col("gd") > 0, 1.0).when(F.col("gd") == 0, 0.5).otherwise(0.0)
    margin = F.tanh(F.col("gd") / 3.0) * 0.3
    venue = F.when(F.col("is_home"), -0.05).otherwise(0.05)
    return F.least(F.greatest(base + margin + venue, F.lit(0.0)), F.lit(1.0))


FORM_DEFAULTS = {
    "form_rating": 0.5, "form_trend": 0.0, "form_stability": 0.5, "peak_form": 0.5, "worst_form": 0.5,
}


def form_state() -> dict[str, Column]:
    out = {}
    for n in FORM_WINDOWS:
        frame = last_n(KEY, n)
        out |= {
            f"form_rating_{n}f": F.avg("form").over(frame),
            f"form_trend_{n}f": _slope(F.col("form"), n),
            f"form_stability_{n}f": 1.0 - F.stddev_pop("form").over(frame),
            f"peak_form_{n}f": F.max("form").over(frame),
            f"worst_form_{n}f": F.min("form").over(frame),
        }
    return out


def form_features() -> dict[str, Feature]:
    return {
        f"{stat}_{n}f": Feature(F.col(f"s.{stat}_{n}f"), min(FORM_WINDOWS), default)
        for n in FORM_WINDOWS for stat, default in FORM_DEFAULTS.items()
    }


# --- streaks -----------------------------------------------------------------------------------

# run kind -> flag of a match that ends it
RUN_BREAKS = {"win": "not_won", "unbeaten": "lost", "loss": "not_lost"}


def streak_days(rows: DataFrame) -> DataFrame:
    """Per (team, date): where each run last broke, and the longest run reached on that date.

    A run is an island between two breaks, so its number is the running count of breaks.  Island
    sizes are counted with map-side combine; nothing gathers a whole run or a whole team.
    """
    flagged = rows.select(
        KEY, "date", "match_id", F.lit(1).alias("one"),
        (F.col("gd") <= 0).cast("int").alias("not_won"),
        (F.col("gd") < 0).cast("int").alias("lost"),
        (F.col("gd") >= 0).cast("int").alias("not_lost"),
    )
    numbered = running_totals(flagged, KEY, ["one", *RUN_BREAKS.values()])
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"run_{stop}").alias("island"),
                 (F.col(stop) == 1).alias("broke"))
        for kind, stop in RUN_BREAKS.items()]))
    pieces = numbered.select(KEY, "date", "run_one", kinds.alias("r")).groupBy(
        KEY, F.col("r.kind").alias("kind"), F.col("r.island").alias("island"), "date",
    ).agg(F.count_if(~F.col("r.broke")).alias("len"),
          F.max(F.when(F.col("r.broke"), F.col("run_one"))).alias("broke_at"))
    island = Window.partitionBy(KEY, "kind", "island").orderBy("date").rowsBetween(UNBOUNDED, 0)
    grown = pieces.withColumn("len", F.sum("len").over(island))
    return grown.groupBy(KEY, "date").agg(*[
        a for kind in RUN_BREAKS for a in (
            F.max(F.when(F.col("kind") == kind, F.col("broke_at"))).alias(f"{kind}_break"),
            F.max(F.when(F.col("kind") == kind, F.col("len"))).alias(f"{kind}_run"))])


def streak_asof() -> dict[str, Column]:
    w = before(KEY)
    return {
        f"h_{c}": F.coalesce(F.max(c).over(w), F.lit(0))
        for c in ("win_break", "unbeaten_break", "loss_break", "win_run", "unbeaten_run")
    }


def streak_state() -> dict[str, Column]:
    value = F.when(F.col("gd") > 0, 1.0).when(F.col("gd") == 0, 0.5).otherwise(0.0)
    return {"result5": F.avg(value).over(last_n(KEY, 5))}


def streak_features() -> dict[str, Feature]:
    n = F.col("n").cast("double")
    # results coded W=2, D=1, L=0 over all history, from exact integer sums
    total = 2 * F.col("h_wins") + F.col("h_draws")
    squares = 4 * F.col("h_wins") + F.col("h_draws")
    spread = F.sqrt((n * squares - total * total) / (n * n)) / 2.0
    five = F.col("n") >= 5
    return {
        "current_win_streak": Feature(n - F.col("h_win_break"), 3, 0.0),
        "current_unbeaten_streak": Feature(n - F.col("h_unbeaten_break"), 3, 0.0),
        "current_loss_streak": Feature(n - F.col("h_loss_break"), 3, 0.0),
        "longest_win_streak": Feature(F.col("h_win_run").cast("double"), 3, 0.0),
        "longest_unbeaten_streak": Feature(F.col("h_unbeaten_run").cast("double"), 3, 0.0),
        "streak_volatility": Feature(F.when(five, spread).otherwise(0.5), 3, 0.5),
        "recent_streak_strength": Feature(
            F.when(five, F.col("s.result5")).otherwise(0.5), 3, 0.5),
    }


DIFF_FORM_SOURCE = {
    # both sides are compared on the longest window only
    "form_rating": f"form_rating_{max(FORM_WINDOWS)}f",
    "form_trend": f"form_trend_{max(FORM_WINDOWS)}f",
    "form_stability": f"form_stability_{max(FORM_WINDOWS)}f",
    "peak_form": f"peak_form_{max(FORM_WINDOWS)}f",
    "worst_form": f"worst_form_{max(FORM_WINDOWS)}f",
}


def differentials() -> dict[str, Column]:
    """``diff_*`` columns over a match row that already carries home_* and away_* features."""
    names = {k: k for k in [*rolling_features(), *momentum_features()]} | DIFF_FORM_SOURCE
    return {f"diff_{k}": F.col(f"home_{src}") - F.col(f"away_{src}") for k, src in names.items()}
