"""Match-domain views over the provided star-schema tables (whole tables, no sampling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import tune

# Words the derived team names are made of.
TEAM_CITIES = ["Madrid", "Barcelona", "Valencia", "Sevilla", "Bilbao", "Vigo", "Oviedo", "Getafe"]
TEAM_PREFIXES = ["Real", "Atletico", "FC", "CF", "SC"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def team_name(index):
    cities = F.array(*[F.lit(c) for c in TEAM_CITIES])
    prefixes = F.array(*[F.lit(p) for p in TEAM_PREFIXES])
    return F.concat_ws(
        " ",
        F.element_at(prefixes, (F.floor(index / 8) + 1).cast("int")),
        F.element_at(cities, (index % 8 + 1).cast("int")),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match per order; 'P' orders are scheduled fixtures without a score."""
    o = table(spark, sf_dir, "orders")
    scheduled = F.col("o_orderstatus") == "P"
    date = F.col("o_orderdate").cast("date")
    home = F.col("o_custkey") % 40
    away = (F.col("o_custkey") % 40 + 1 + F.col("o_orderkey") % 39) % 40
    season = F.year(date) - F.when(F.month(date) >= 8, 0).otherwise(1)
    return o.select(
        F.col("o_orderkey").alias("match_id"),
        date.alias("date"),
        season.cast("string").alias("season"),
        F.col("o_orderpriority").alias("competition"),
        team_name(home).alias("home_team"),
        team_name(away).alias("away_team"),
        F.when(~scheduled, (F.floor("o_totalprice") % 5).cast("int")).alias("home_score"),
        F.when(~scheduled, (F.floor(F.col("o_totalprice") / 5) % 4).cast("int")).alias("away_score"),
        F.when(scheduled, "SCHEDULED").otherwise("FINISHED").alias("status"),
    )


MATCHES_SQL = """
m as (
  select o_orderkey as match_id, cast(o_orderdate as date) as date,
    cast(year(o_orderdate) - case when month(o_orderdate) >= 8 then 0 else 1 end as varchar) as season,
    o_orderpriority as competition,
    (['Real','Atletico','FC','CF','SC'])[(o_custkey%40)//8+1] || ' ' ||
    (['Madrid','Barcelona','Valencia','Sevilla','Bilbao','Vigo','Oviedo','Getafe'])[(o_custkey%40)%8+1] as home_team,
    (['Real','Atletico','FC','CF','SC'])[((o_custkey%40+1+o_orderkey%39)%40)//8+1] || ' ' ||
    (['Madrid','Barcelona','Valencia','Sevilla','Bilbao','Vigo','Oviedo','Getafe'])[((o_custkey%40+1+o_orderkey%39)%40)%8+1] as away_team,
    case when o_orderstatus='P' then null else cast(cast(floor(o_totalprice) as bigint)%5 as int) end as home_score,
    case when o_orderstatus='P' then null else cast(cast(floor(o_totalprice/5) as bigint)%4 as int) end as away_score,
    case when o_orderstatus='P' then 'SCHEDULED' else 'FINISHED' end as status
  from orders)"""


def odds_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1X2 quotes, one per line item; a match/bookmaker pair may be quoted repeatedly."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.concat(F.lit("BOOK_"), (F.col("l_suppkey") % 8).cast("string")).alias("bookmaker"),
        F.col("l_shipdate").alias("ts"),
        F.lit("Full Time").alias("period"),
        (F.lit(1.2) + F.col("l_quantity") / 10).alias("home_win"),
        (F.lit(2.0) + F.col("l_discount") * 10).alias("draw"),
        (F.lit(1.5) + F.col("l_tax") * 50).alias("away_win"),
    )


ODDS_SQL = """
q as (
  select l_orderkey as match_id, 'BOOK_' || cast(l_suppkey%8 as varchar) as bookmaker, l_shipdate as ts,
    'Full Time' as period,
    1.2::double + l_quantity/10 as home_win, 2.0::double + l_discount*10 as draw, 1.5::double + l_tax*50 as away_win
  from lineitem)"""
