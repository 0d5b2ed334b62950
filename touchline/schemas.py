"""Explicit read schemas of the nested match document."""

from __future__ import annotations

from pyspark.sql import types as T

# The statistics a document may carry, whole numbers except expected goals.
STATISTICS = [
    "possession", "goal_attempts", "shots_on_goal", "shots_off_goal", "blocked_shots",
    "corner_kicks", "goalkeeper_saves", "offsides", "fouls", "yellow_cards", "red_cards",
    "big_chances", "shots_inside_box", "shots_outside_box", "expected_goals",
]


def _pair(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("home", kind), T.StructField("away", kind)])


STATS_SCHEMA = T.StructType([
    T.StructField(s, _pair(T.DoubleType() if s == "expected_goals" else T.IntegerType()))
    for s in STATISTICS])


def _market(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    base = [T.StructField(n, T.StringType()) for n in ("bookmaker", "timestamp", "period")]
    return T.ArrayType(T.StructType(base + [T.StructField(n, k) for n, k in fields]))


D, S = T.DoubleType(), T.StringType()
ODDS_SCHEMA = T.StructType([
    T.StructField("match_winner", _market(("home_win", D), ("draw", D), ("away_win", D))),
    T.StructField("over_under", _market(("total", D), ("over", D), ("under", D))),
    T.StructField("both_teams_to_score", _market(("yes", D), ("no", D))),
    T.StructField("asian_handicap", _market(("handicap", D), ("home", D), ("away", D))),
    T.StructField("double_chance", _market(
        ("home_or_draw", D), ("draw_or_away", D), ("home_or_away", D))),
    T.StructField("draw_no_bet", _market(("home", D), ("away", D))),
    T.StructField("correct_score", _market(("score", S), ("odds", D))),
    T.StructField("halftime_fulltime", _market(("result_combination", S), ("odds", D))),
    T.StructField("odd_even", _market(("odd", D), ("even", D))),
    # older writers used one key per line
    T.StructField("over_under_2_5", _market(("over", D), ("under", D))),
])

MATCH_SCHEMA = T.StructType([
    T.StructField("match_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("competition", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("home_score", T.IntegerType()),
    T.StructField("away_score", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("referee", T.StringType()),
    T.StructField("attendance", T.IntegerType()),
    T.StructField("weather", T.StringType()),
    T.StructField("full_time_stats", STATS_SCHEMA),
    T.StructField("first_half_stats", STATS_SCHEMA),
    T.StructField("second_half_stats", STATS_SCHEMA),
    T.StructField("odds", ODDS_SCHEMA),
    T.StructField("url", T.StringType()),
])
SEASON_FIELD = T.StructField("season", T.StringType())
CORRUPT_FIELD = T.StructField("_corrupt_record", T.StringType())
