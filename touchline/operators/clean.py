"""Cleaning, derived columns, input contracts and data-quality reports on flat matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("date", "home_team", "away_team", "home_score", "away_score")
MIN_ROWS = 10
# Columns that are never features.
NON_FEATURES = [
    "match_id", "date", "home_team", "away_team", "home_score", "away_score", "season",
    "competition", "stage", "status", "file_path", "year", "result",
]
# The final column list must also leave out everything read off the match's own score.
SCORE_DERIVED = [
    "total_goals", "both_teams_scored", "goal_difference", "abs_goal_difference", "is_high_scoring",
    "is_low_scoring", "margin_of_victory", "conversion_rate_home", "conversion_rate_away",
]


def result_hda(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def result_wdl(home: Column, away: Column) -> Column:
    return F.when(home > away, "W").when(home < away, "L").when(home == away, "D")


def outcome_1x2(home: Column, away: Column) -> Column:
    return F.when(home > away, "1").when(home < away, "2").when(home == away, "X")


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def with_score_columns(matches: DataFrame) -> DataFrame:
    h, a = F.col("home_score"), F.col("away_score")
    return matches.withColumns({
        "result": result_hda(h, a), "total_goals": h + a,
        "both_teams_scored": (h > 0) & (a > 0), "goal_difference": h - a,
    })


def with_margins(matches: DataFrame) -> DataFrame:
    gap = F.abs("goal_difference")
    return matches.withColumns({
        "abs_goal_difference": gap,
        "is_high_scoring": F.col("total_goals") >= 3,
        "is_low_scoring": F.col("total_goals") <= 1,
        "margin_of_victory": F.when(F.col("result") != "D", gap).otherwise(0),
    })


def with_shot_ratios(matches: DataFrame) -> DataFrame:
    made = {}
    for side in ("home", "away"):
        on_target = F.col(f"shots_on_target_{side}")
        made[f"shot_accuracy_{side}"] = ratio_or_zero(on_target, F.col(f"total_shots_{side}"))
        made[f"conversion_rate_{side}"] = ratio_or_zero(F.col(f"{side}_score"), on_target)
    return matches.withColumns(made)


def with_parsed_date(matches: DataFrame) -> DataFrame:
    if isinstance(matches.schema["date"].dataType, T.StringType):
        return matches.withColumn("date", F.try_to_timestamp(F.col("date")).cast("date"))
    return matches


def _playable() -> Column:
    return (F.col("date").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
            & (F.col("home_score") >= 0) & (F.col("away_score") >= 0))


def clean(matches: DataFrame) -> DataFrame:
    """Drop unusable rows; null scores fail the comparison and leave with them."""
    return with_parsed_date(matches).where(_playable())


def clean_report(matches: DataFrame) -> DataFrame:
    """before / after / removed share in one pass."""
    usable = F.count_if(F.coalesce(_playable(), F.lit(False)))
    return with_parsed_date(matches).agg(F.count("*").alias("before"), usable.alias("after")).select(
        "before", "after", (F.col("before") - F.col("after")).alias("removed"),
        F.try_divide((F.col("before") - F.col("after")) * 100.0, F.col("before"))
        .alias("removed_percent"))


def possession_to_100(home: Column, away: Column) -> list[Column]:
    total = home + away
    return [F.try_divide(home * 100.0, total), F.try_divide(away * 100.0, total)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, extra_excluded: Sequence[str] = ()) -> list[str]:
    gone = {*NON_FEATURES, *SCORE_DERIVED, *extra_excluded}
    return [c for c in df.columns if c not in gone]


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], small: int = 50_000) -> dict[str, list[float]]:
    """Exact quantiles, linear between neighbours, of all columns in bounded memory; columns without values are left out.

    An exact percentile keeps every distinct value, so it is only taken once the bracket of a quantile
    holds few of them; until then each pass over the data narrows all brackets around the two ranks
    asked for by approximate percentiles, whose rank error is bounded.
    """
    accuracy = 10_000
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    asked = [(c, q, n) for c, n in zip(columns, sizes, strict=True) if n for q in shares]
    if not asked:
        return {}
    places = [(n - 1) * q for _, q, n in asked]
    ranks = [(int(p), min(int(p) + 1, n - 1)) for p, (_, _, n) in zip(places, asked, strict=True)]
    low, high = [float("-inf")] * len(asked), [float("inf")] * len(asked)
    below, held = [0] * len(asked), [0] * len(asked)

    def value(i: int) -> Column:
        return F.col(asked[i][0]).cast("double")

    def inside(i: int) -> Column:
        return F.when(value(i).between(low[i], high[i]), value(i))

    wide = list(range(len(asked)))
    while wide:
        row = df.agg(*[a for i in wide for a in (
            F.count_if(value(i) < low[i]).alias(f"b{i}"), F.count(inside(i)).alias(f"n{i}"),
            F.approx_count_distinct(inside(i)).alias(f"d{i}"))]).first()
        for i in wide:
            below[i], held[i] = row[f"b{i}"], row[f"n{i}"]
        wide = [i for i in wide if row[f"d{i}"] > small]
        if wide:
            def share(i: int, rank: int, slack: float) -> float:
                return min(max((rank - below[i]) / held[i] + slack, 0.0), 1.0)
            row = df.agg(*[a for i in wide for a in (
                F.percentile_approx(inside(i), share(i, ranks[i][0], -2 / accuracy), accuracy).alias(f"l{i}"),
                F.percentile_approx(inside(i), share(i, ranks[i][1], 2 / accuracy), accuracy).alias(f"h{i}"))]).first()
            for i in wide:
                low[i], high[i] = row[f"l{i}"], row[f"h{i}"]

    def at(i: int, rank: int) -> Column:
        return F.percentile(inside(i), (rank - below[i]) / max(held[i] - 1, 1))

    row = df.agg(*[at(i, rank).alias(f"v{i}_{k}") for i in range(len(asked)) for k, rank in enumerate(ranks[i])]).first()
    out: dict[str, list[float]] = {}
    for i, (c, _, _) in enumerate(asked):
        first, second = row[f"v{i}_0"], row[f"v{i}_1"]
        out.setdefault(c, []).append(first + (places[i] - ranks[i][0]) * (second - first))
    return out


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = 50_000) -> dict[str, float]:
    return {c: v for c, (v,) in exact_quantiles(df, columns, [0.5], small).items()}


def impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median for numbers (0 where a column is all null), 'unknown' for text."""
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    words = [f.name for f in df.schema if f.name in set(columns) and isinstance(f.dataType, T.StringType)]
    middle = exact_medians(df, numbers)
    return df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(middle.get(c, 0.0))).alias(c) if c in set(numbers)
        else F.coalesce(F.col(c), F.lit("unknown")).alias(c) if c in set(words)
        else F.col(c)
        for c in df.columns])


def weighted_columns(df: DataFrame, weight: str, skip: Sequence[str] = ()) -> DataFrame:
    chosen = [c for c in numeric_columns(df) if c != weight and c not in skip]
    return df.select("*", *[(F.col(c) * F.col(weight)).alias(f"{c}_weighted") for c in chosen])


# --- contracts ---------------------------------------------------------------------------------

def missing_fields() -> Column:
    return F.filter(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in ("home_team", "away_team", "date")]),
        lambda x: x.isNotNull())


def stat_violations(possession_home, possession_away, shots: Sequence[Column]) -> Column:
    negative = F.lit(False)
    for s in shots:
        negative = negative | F.coalesce(s < 0, F.lit(False))
    return F.filter(F.array(
        F.when(possession_home.isNull() | possession_away.isNull()
               | (F.abs(possession_home + possession_away - 100) > 0.1), F.lit("possession")),
        F.when(negative, F.lit("shots")),
    ), lambda x: x.isNotNull())


def odds_violations(bookmaker: Column, prices: Sequence[Column]) -> Column:
    bad = F.lit(False)
    for p in prices:
        bad = bad | F.coalesce(p <= 0, F.lit(True))
    return F.filter(F.array(
        F.when(bad, F.lit("price")),
        F.when(F.coalesce(bookmaker, F.lit("")) == "", F.lit("bookmaker")),
    ), lambda x: x.isNotNull())


def check_input(matches: DataFrame) -> DataFrame:
    """Input contract: required columns (raises), row count, dates that do not parse."""
    lacking = [c for c in REQUIRED if c not in matches.columns]
    if lacking:
        raise ValueError(f"missing required columns: {lacking}")
    date = F.col("date")
    if isinstance(matches.schema["date"].dataType, T.StringType):
        date = F.try_to_timestamp(date)
    return matches.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("date").isNotNull() & date.isNull()).alias("bad_dates"),
    ).select("rows", "bad_dates", (F.col("rows") < MIN_ROWS).alias("few_rows"))


def check_training(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    cells = F.count("*") * len(features)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in features), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(label).alias("classes"),
        F.count_if(F.col(label).isNull()).alias("unlabelled"),
        F.try_divide(nulls.cast("double"), cells).alias("missing_ratio"),
    ).select("*", (F.col("missing_ratio") > 0.5).alias("mostly_missing"),
             ((F.col("rows") > 0) & (F.col("classes") >= 2) & (F.col("unlabelled") == 0)).alias("ok"))


# --- quality -----------------------------------------------------------------------------------

def column_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: nulls, infinities, sample variance, from a single aggregate."""
    numbers = set(numeric_columns(df))

    def infinite(c: str) -> Column:
        if c not in numbers:
            return F.lit(0).cast("bigint")
        return F.count_if(F.abs(F.col(c).cast("double")) == float("inf"))

    def spread(c: str) -> Column:
        return F.var_samp(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")

    packed = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"),
                 F.count_if(F.col(c).isNull()).alias("nulls"), infinite(c).alias("infinities"),
                 spread(c).alias("variance")) for c in columns]).alias("q"))
    return packed.select(F.inline("q"))
