"""Temporal weights and their quartiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY_RATE, MIN_WEIGHT = 0.001, 0.1
PIPELINE_DECAY_RATE = 0.0005
RECENT_ABOVE, HISTORICAL_BELOW = 0.8, 0.3


def temporal_weight(date: Column, as_of: Column, rate: float = DECAY_RATE,
                    floor: float = MIN_WEIGHT) -> Column:
    return F.greatest(F.exp(F.datediff(as_of, date) * -rate), F.lit(floor))


def with_weights(matches: DataFrame, as_of: Column, rate: float = PIPELINE_DECAY_RATE,
                 floor: float = MIN_WEIGHT) -> DataFrame:
    w = F.col("temporal_weight")
    return matches.withColumn("temporal_weight", temporal_weight(F.col("date"), as_of, rate, floor)) \
        .withColumn("is_recent", w > RECENT_ABOVE).withColumn("is_historical", w < HISTORICAL_BELOW)


def with_quartiles(weighted: DataFrame) -> DataFrame:
    """Right-closed quartiles by interpolated edges; equal edges collapse into the lower quartile.

    Weights depend on the date only, so the edges are taken from (weight, count) pairs: a table as
    long as the calendar, whatever the number of matches.
    """
    counts = weighted.groupBy("temporal_weight").agg(F.count("*").alias("c"))
    edges = counts.agg(F.percentile("temporal_weight", [0.25, 0.5, 0.75], F.col("c")).alias("e")).first()
    q1, q2, q3 = edges["e"] if edges["e"] is not None else (None, None, None)
    w = F.col("temporal_weight")
    return weighted.withColumn("weight_quartile", F.when(w <= q1, "Q1").when(w <= q2, "Q2").when(
        w <= q3, "Q3").otherwise("Q4"))


def weighting_info(weighted: DataFrame) -> DataFrame:
    w = F.col("temporal_weight")
    return weighted.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min(w).alias("min_weight"), F.max(w).alias("max_weight"), F.avg(w).alias("avg_weight"),
        (F.count_if(w > RECENT_ABOVE) / F.count("*")).alias("recent_data_ratio"))
