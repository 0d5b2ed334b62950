"""Value bets, stakes, backtest and risk over predictions and the long odds table.

The source only declares these results; the formulas are the ordinary ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Outcome of each 1X2 selection.
SELECTIONS = {"home_win": "H", "draw": "D", "away_win": "A"}


def value_bets(predictions: DataFrame, odds: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Best price per (match, selection), its expected value and whether to bet."""
    best = odds.where((F.col("market") == "match_winner") & (F.col("price") > 1)).groupBy(
        "match_id", "selection").agg(F.max("price").alias("price"),
                                     F.max_by("bookmaker", F.struct("price", "bookmaker")).alias("bookmaker"))
    p = F.coalesce(*[F.when(F.col("selection") == s, F.col(f"p_{o}")) for s, o in SELECTIONS.items()])
    return predictions.join(best, "match_id").withColumn("probability", p).withColumn(
        "expected_value", F.col("probability") * F.col("price") - 1).withColumn(
        "should_bet", F.col("expected_value") > threshold)


def settle(bets: DataFrame, stake: float = 1.0) -> DataFrame:
    """Flat stakes against the final result (``label`` H/D/A)."""
    outcome = F.coalesce(*[F.when(F.col("selection") == s, F.lit(o)) for s, o in SELECTIONS.items()])
    won = outcome == F.col("label")
    return bets.where("should_bet").withColumn("stake", F.lit(stake)).withColumn("won", won).withColumn(
        "profit", F.when(won, (F.col("price") - 1) * stake).otherwise(-stake))


def daily(settled: DataFrame, bankroll: float = 1000.0, fraction: float = 0.01) -> DataFrame:
    """Per day: bets, profit, flat bankroll, and the bankroll of staking a fraction of it daily.

    Bets of one day share that day's opening bankroll, so a day is a factor and the running bankroll
    a sum of logarithms over the calendar.
    """
    days = settled.groupBy("date").agg(
        F.count("*").alias("bets"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit"),
        F.count_if("won").alias("wins"))
    line = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 + fraction * F.col("profit") / F.col("staked")
    return days.withColumn("bankroll", bankroll + F.sum("profit").over(line)).withColumn(
        "fraction_bankroll", bankroll * F.exp(F.sum(F.log(factor)).over(line))).withColumn(
        "peak", F.max("bankroll").over(line)).withColumn(
        "drawdown", (F.col("peak") - F.col("bankroll")) / F.col("peak"))


def backtest(days: DataFrame, bankroll: float = 1000.0) -> DataFrame:
    return days.agg(
        F.sum("bets").alias("num_bets"), F.sum("profit").alias("profit"),
        (F.sum("profit") / F.sum("staked")).alias("roi"), (F.sum("wins") / F.sum("bets")).alias("win_rate"),
        (F.sum("staked") / F.sum("bets")).alias("average_stake"),
        (F.sum("profit") / bankroll).alias("total_return"), F.max("drawdown").alias("max_drawdown"))


def risk(days: DataFrame) -> DataFrame:
    """Sharpe ratio of daily profit, value at risk (5%) and expected shortfall over the calendar."""
    edge = days.agg(F.percentile("profit", 0.05).alias("var95"))
    return days.join(F.broadcast(edge)).agg(
        F.try_divide(F.avg("profit"), F.stddev_samp("profit")).alias("sharpe"),
        F.max("var95").alias("var95"),
        F.avg(F.when(F.col("profit") <= F.col("var95"), F.col("profit"))).alias("expected_shortfall"))
