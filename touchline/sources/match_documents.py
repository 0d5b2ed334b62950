"""Nested documents and quotes derived from the given tables, written once per session and scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schemas import STATISTICS
from touchline.session import fresh_dir
from touchline.sources import documents, quotes
from touchline.sources.views import matches, table


def stat_sql(stat: str) -> tuple[str, str]:
    """Home and away value of a derived statistic, in SQL both engines read; some are missing."""
    i = STATISTICS.index(stat)
    if stat == "possession":
        home, away = "30+match_id%41", "70-match_id%41"
    elif stat == "expected_goals":
        home, away = "cast(match_id%37 as double)/10", "cast(match_id%29 as double)/10"
    else:
        home, away = f"(match_id*{i + 3})%{i + 6}", f"(match_id*{i + 2}+1)%{i + 5}"
    gone = f"match_id%17={i}"
    return f"case when {gone} then null else {home} end", f"case when {gone} then null else {away} end"


# Prices of the other markets, from the columns of a line item; each line item quotes one of them.
OTHER_MARKETS = {
    "both_teams_to_score": {"yes": "1.1+l_quantity/20", "no": "1.3+l_discount*8"},
    "asian_handicap": {"handicap": "l_linenumber/4-1", "home": "1.4+l_tax*9", "away": "1.6+l_quantity/50"},
    "double_chance": {"home_or_draw": "1.1+l_tax*4", "draw_or_away": "1.2+l_discount*3", "home_or_away": "1.05+l_quantity/99"},
    "draw_no_bet": {"home": "1.3+l_quantity/40", "away": "1.7+l_tax*6"},
    "correct_score": {"score": "cast(l_quantity%4 as int)||'-'||cast(l_linenumber%3 as int)", "odds": "6.0+l_quantity/5"},
    "halftime_fulltime": {"result_combination": "case l_suppkey%3 when 0 then 'Home/Home' when 1 then 'Draw/Away' else 'Away/Draw' end",
                          "odds": "3.0+l_discount*40"},
    "odd_even": {"odd": "1.8+l_tax", "even": "2.0-l_tax"},
}
TOTAL_SQL = "1.5+l_linenumber%3"
PERIOD_SQL = "case when l_suppkey%5=0 then '1st Half' else 'Full Time' end"


def raw_quotes(items: DataFrame) -> DataFrame:
    """Quote records of every line item, which knows its season: its 1X2 prices, its totals, and one of the other markets."""
    winner = {"home_win": "1.2+l_quantity/10", "draw": "2.0+l_discount*10", "away_win": "1.5+l_tax*50"}
    totals = {"total": TOTAL_SQL, "over": "(1.2+l_quantity/10)*0.5+1", "under": "(1.5+l_tax*50)*0.5+1"}
    chosen = F.coalesce(F.expr("cast((l_orderkey+l_linenumber)%7 as int)"), F.lit(len(OTHER_MARKETS) - 1))   # without a number: the last
    records = [(F.col("record") == 0, "MATCH_WINNER", winner), (F.col("record") == 1, " over_under ", totals)] + [
        ((F.col("record") == 2) & (chosen == i), m, v) for i, (m, v) in enumerate(OTHER_MARKETS.items())]

    def of(values: list[tuple[Column, Column]], kind) -> Column:
        out = F.lit(None)
        for mine, value in reversed(values):
            out = F.when(mine, value).otherwise(out)
        return out.cast(kind)

    three = items.withColumn("record", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return three.select(
        F.col("l_orderkey").alias("match_id"), F.concat(F.lit("BOOK_"), (F.col("l_suppkey") % 8).cast("string")).alias("bookmaker"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), "season",
        of([(mine, F.lit(m)) for mine, m, _ in records], "string").alias("kind"),
        F.when(F.col("record") == 0, "Full Time").otherwise(F.expr(PERIOD_SQL)).alias("period"),
        *[of([(mine, F.expr(v[n]).cast(k)) for mine, _, v in records if n in v], k).alias(n) for n, k in quotes.VALUES.items()])


def market_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all markets with the season of their match. Line items are joined before they become three records
    each, so what is shuffled is as narrow as it gets."""
    season = matches(spark, sf_dir).select(F.col("match_id").alias("l_orderkey"), "season")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return quotes.dispatched(raw_quotes(items.join(season, "l_orderkey")), F.col("kind"))


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    full = {s: stat_sql(s) for s in STATISTICS}
    half = {s: stat_sql(s) for s in ("possession", "shots_on_goal")}
    whole = documents.statistics_struct(full)
    part = documents.statistics_struct(half)
    return m.select(
        F.col("match_id").cast("string").alias("match_id"),
        F.date_format("date", "yyyy-MM-dd'T'00:00:00").alias("date"),
        "season", "competition",
        F.when(F.col("match_id") % 5 == 0, "Final").otherwise("Regular Season").alias("stage"),
        "home_team", "away_team", "home_score", "away_score", "status",
        whole.alias("full_time_stats"),
        F.when(F.col("match_id") % 2 == 0, part).alias("first_half_stats"),
        F.when(F.col("match_id") % 3 == 0, part).alias("second_half_stats"),
        F.concat(F.lit("https://www.example.com/match/"), F.col("match_id").cast("string"), F.lit("/"))
        .alias("url"),
    )


_WRITTEN: dict[tuple[str, str, str], str] = {}


def document_store(spark: SparkSession, sf_dir: str) -> str:
    """Path of the JSON documents of this scale, one directory per season."""
    key = (spark.sparkContext.applicationId, sf_dir, "documents")
    if key not in _WRITTEN:
        path = fresh_dir(spark, "documents")
        documents.save_matches(match_documents(spark, sf_dir), path, F.lit("2001-08-02T00:00:00"))
        _WRITTEN[key] = path
    return _WRITTEN[key]


def quote_store(spark: SparkSession, sf_dir: str) -> str:
    """Path of the quotes of this scale, by season and market."""
    key = (spark.sparkContext.applicationId, sf_dir, "quotes")
    if key not in _WRITTEN:
        path = fresh_dir(spark, "quotes")
        quotes.save_quotes(market_quotes(spark, sf_dir), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
