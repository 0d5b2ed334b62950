"""Incremental ingest: store only new, valid matches, then refresh the touched teams' features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.asof import match_sides
from touchline.operators.clean import missing_fields
from touchline.operators.snapshot import team_snapshot
from touchline.session import stored

TEAM_BUCKETS = 64
KEY = ["season", "match_id"]


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): required fields present and scores not negative."""
    reasons = F.array_compact(F.concat(missing_fields(), F.array(
        F.when((F.col("home_score") < 0) | (F.col("away_score") < 0), F.lit("score")))))
    checked = batch.withColumn("reasons", reasons)
    return (checked.where(F.size("reasons") == 0).drop("reasons"),
            checked.where(F.size("reasons") > 0))


def one_per_match(batch: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Of rows with the same season and id the greatest: by the columns of ``order``, then by all others."""
    rank = [*order, *(c for c in batch.columns if c not in order)]
    rows = batch.groupBy(*KEY).agg(F.max_by(F.struct(*batch.columns), F.struct(*rank)).alias("row"))
    return rows.select("row.*")


def new_matches(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose season and id are not stored yet. Of a store partitioned by season only the seasons of the batch
    are read, and of those the ids; rows without a season are compared with each other."""
    seasons = [row["season"] for row in batch.select("season").distinct().toLocalIterator()]   # an entry per season
    season = F.col("season")
    there = store.where(season.isin([s for s in seasons if s is not None])
                        | (season.isNull() if None in seasons else F.lit(False))).select(*KEY)
    same = (F.col("new.match_id") == F.col("old.match_id")) & F.col("new.season").eqNullSafe(F.col("old.season"))
    return batch.alias("new").join(there.alias("old"), same, "left_anti").select("new.*")


def outcomes(valid: DataFrame, fresh: DataFrame, bad: DataFrame) -> DataFrame:
    """The log of a batch: season, match_id, status, reasons. Stored matches were successful, those that stood in the
    store before were skipped, and every quarantined row failed, for the reasons given."""
    done = new_matches(valid, fresh).select(*KEY, F.lit("skipped").alias("status")).unionByName(
        fresh.select(*KEY, F.lit("successful").alias("status")))
    return done.withColumn("reasons", F.lit("")).unionByName(
        bad.select(*KEY, F.lit("failed").alias("status"), F.array_join("reasons", ",").alias("reasons")))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the store does not exist before the first batch
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def ingest_batch(store: str, quarantine: str, refresh: Callable[[DataFrame], None] | None = None,
                 order: Sequence[str] = (), log: str | None = None):
    """``foreachBatch`` body. Idempotent: a replayed batch finds its ids stored and adds nothing, its bad
    rows replace those of the same batch, and the refresh sees all its valid rows again, so a batch that
    failed between the append and the end of the refresh is completed.

    With ``log`` the outcome of every row is written there, by batch, before anything is stored; a replayed batch
    keeps the log of its first run, which is the one that counts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid, bad = split_valid(batch)
        valid = stored(one_per_match(valid, order), "valid")
        fresh = stored(new_matches(valid, _read(spark, store, batch.schema)), "fresh")
        if log is not None:
            written = _read(spark, log, "batch_id bigint").where(F.col("batch_id") == batch_id)
            if written.isEmpty():
                (outcomes(valid, fresh, bad).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(log))
        fresh.write.mode("append").partitionBy("season").parquet(store)
        (bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(quarantine))
        if refresh is not None:
            refresh(valid)
    return run


def start_ingest(source: DataFrame, store: str, quarantine: str, checkpoint: str,
                 refresh: Callable[[DataFrame], None] | None = None, event_time: str | None = None,
                 late: str = "7 days", log: str | None = None) -> StreamingQuery:
    """Run over everything available, then stop.

    With ``event_time`` repeats within the watermark are dropped in stream state; repeats that come
    later still meet the anti-join on the store.
    """
    if event_time is not None:
        source = source.withWatermark(event_time, late).dropDuplicatesWithinWatermark(KEY)
    return (
        source.writeStream.foreachBatch(ingest_batch(store, quarantine, refresh, (event_time,) if event_time else (), log))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def refresh_touched(store: str, features: str, families: list[str], schema) -> Callable[[DataFrame], None]:
    """Rebuild the snapshots of teams that appear in the new rows; other teams' buckets stay."""
    def bucket(column):
        return F.pmod(F.xxhash64(column), F.lit(TEAM_BUCKETS)).cast("int")

    def run(fresh: DataFrame) -> None:
        spark = fresh.sparkSession
        touched = match_sides(fresh).select("team").distinct().withColumn("bucket", bucket(F.col("team")))
        buckets = touched.select("bucket").distinct()
        whole = _read(spark, store, schema)
        # a match is needed when either side falls into a bucket being rebuilt
        sides = whole.withColumn("bucket", F.explode(F.array_distinct(F.array(
            bucket(F.col("home_team")), bucket(F.col("away_team"))))))
        needed = sides.join(buckets, "bucket", "left_semi").drop("bucket").dropDuplicates(KEY)
        rebuilt = team_snapshot(needed, families).withColumn("bucket", bucket(F.col("team"))).join(
            buckets, "bucket", "left_semi")
        (rebuilt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(features))
    return run
