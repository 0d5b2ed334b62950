"""Table-level summaries: team table, odds means, counts, shares, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.clean import exact_quantiles

INVALID_NAMES = ("", "nan", "None")


def team_names(matches: DataFrame) -> DataFrame:
    """Distinct valid team names over both sides."""
    names = matches.select(F.explode(F.array("home_team", "away_team")).alias("team"))
    return names.where(F.col("team").isNotNull() & ~F.col("team").isin(*INVALID_NAMES)).distinct()


def team_table(sides: DataFrame) -> DataFrame:
    """Seventeen figures per team.  Unscored matches count as matches without goals."""
    gf, ga = F.coalesce("gf", F.lit(0)), F.coalesce("ga", F.lit(0))
    won, drawn = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga")
    home = F.col("is_home")
    n = F.col("total_matches")

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    base = sides.groupBy("team").agg(
        F.count("*").alias("total_matches"),
        F.count_if(won).alias("wins"), F.count_if(drawn).alias("draws"),
        F.sum(gf).alias("goals_scored"), F.sum(ga).alias("goals_conceded"),
        F.count_if(home).alias("home_matches"), F.count_if(~home).alias("away_matches"),
        F.count_if(home & won).alias("home_wins"), F.count_if(~home & won).alias("away_wins"),
    )
    return base.select(
        "team", "total_matches", "wins", "draws", (n - F.col("wins") - F.col("draws")).alias("losses"),
        rate(F.col("wins"), n).alias("win_rate"), rate(F.col("draws"), n).alias("draw_rate"),
        rate(n - F.col("wins") - F.col("draws"), n).alias("loss_rate"),
        "goals_scored", "goals_conceded",
        rate(F.col("goals_scored"), n).alias("goals_per_game"),
        rate(F.col("goals_conceded"), n).alias("conceded_per_game"),
        (F.col("goals_scored") - F.col("goals_conceded")).alias("goal_difference"),
        "home_matches", "away_matches",
        rate(F.col("home_wins"), F.col("home_matches")).alias("home_win_rate"),
        rate(F.col("away_wins"), F.col("away_matches")).alias("away_win_rate"),
    )


def mean_odds(quotes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Mean price per match and selection over every quote, leaving out missing and zero prices."""
    return quotes.groupBy("match_id").agg(
        *[F.avg(F.when(F.col(f) > 0, F.col(f))).alias(f"odds_{f}") for f in fields])


def implied_probability(odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), odds)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Normalised value counts; the total is a one-row aggregate of the counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(
        column, "n", (F.col("n") / F.col("total")).alias("share"))


def distinct_counts(matches: DataFrame) -> DataFrame:
    teams = matches.select(F.explode(F.array("home_team", "away_team")).alias("team")).agg(
        F.countDistinct("team").alias("teams"))
    return matches.agg(
        F.countDistinct("match_id").alias("matches"),
        F.countDistinct("competition").alias("competitions")).join(F.broadcast(teams))


def coverage(matches: DataFrame) -> DataFrame:
    return matches.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn(
        "days", F.datediff("last_date", "first_date"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per column; null where a column has no values."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        cuts = quartiles.get(c, [None] * 3)
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(x).alias("mean"),
                        F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                        *[F.lit(v).cast("double").alias(n) for n, v in zip(("q25", "median", "q75"), cuts, strict=True)],
                        F.max(x).alias("max"))

    return df.agg(F.array(*[one(c) for c in columns]).alias("d")).select(F.inline("d"))


def long_odds(quotes: DataFrame) -> DataFrame:
    """1X2 quotes to the long table (match_id, market, period, bookmaker, ts, line, selection, price)."""
    picks = F.array(*[
        F.struct(F.lit(s).alias("selection"), F.col(s).alias("price"))
        for s in ("home_win", "draw", "away_win")])
    return quotes.select(
        "match_id", F.lit("match_winner").alias("market"), "period", "bookmaker", "ts",
        F.lit(None).cast("double").alias("line"), F.explode(picks).alias("p"),
    ).select("match_id", "market", "period", "bookmaker", "ts", "line", "p.selection", "p.price")


def market_summary(odds: DataFrame) -> DataFrame:
    return odds.groupBy("market").agg(
        F.count("*").alias("entries"), F.countDistinct("match_id").alias("matches"))


def run_summary(log: DataFrame) -> DataFrame:
    """successful / failed / skipped and the success rate of an ingest log."""
    by = {s: F.count_if(F.col("status") == s) for s in ("successful", "failed", "skipped")}
    return log.agg(F.count("*").alias("total"), *[c.alias(s) for s, c in by.items()]).withColumn(
        "success_rate", F.try_divide(F.col("successful") * 100.0, F.col("total")))
