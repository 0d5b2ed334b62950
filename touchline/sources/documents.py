"""Match documents: nested JSON by season, and the store operations over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.schemas import CORRUPT_FIELD, MATCH_SCHEMA, SEASON_FIELD, STATISTICS
from touchline.session import stored
from touchline.sources.quotes import FLAT_ODDS, flat_odds, unnested


def read_documents(
    spark: SparkSession, path: str, season: str | None = None, multi_line: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Nested documents below ``path``; a season is a partition, so asking for one lists only it."""
    fields = [*MATCH_SCHEMA.fields, SEASON_FIELD] + ([CORRUPT_FIELD] if keep_corrupt else [])
    reader = spark.read.schema(T.StructType(fields)).option("multiLine", multi_line)
    if keep_corrupt:
        reader = reader.option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT_FIELD.name)
    df = reader.json(path)
    return df if season is None else df.where(F.col("season") == season)


def read_match_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a plain store: one file per match, indented or not, in folders of any depth.

    A document without a season takes the name of its folder. A file that is no JSON gives a row with its
    content in the corrupt field, so ``split_corrupt`` can set it aside; nothing turns into nulls unseen.
    """
    schema = T.StructType([*MATCH_SCHEMA.fields, *([] if "season" in MATCH_SCHEMA.names else [SEASON_FIELD]), CORRUPT_FIELD])
    documents = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
                 .option("multiLine", True).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT_FIELD.name).json(path))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:season=)?([^/]+)/[^/]+$", 1)
    return documents.select(*[F.coalesce("season", folder).alias("season") if c == "season" else F.col(c)
                              for c in documents.columns])


def split_corrupt(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined) documents."""
    bad = F.col(CORRUPT_FIELD.name).isNotNull()
    return documents.where(~bad).drop(CORRUPT_FIELD.name), documents.where(bad)


def save_matches(documents: DataFrame, path: str, scraped_at: Column) -> None:
    """Add or replace documents by id; only the touched season partitions are rewritten."""
    spark = documents.sparkSession
    stamped = documents.withColumn("_metadata", F.struct(
        scraped_at.cast("string").alias("scraped_at"), F.col("season").alias("season")))
    if _exists(spark, path):
        current = _raw(spark, path)
        touched = _of_seasons(current, stamped)
        kept = touched.join(stamped.select("season", "match_id"), ["season", "match_id"], "left_anti")
        # staged copy: a partition cannot be overwritten while it is being read
        stamped = stored(kept.unionByName(stamped, allowMissingColumns=True), "save")
    _write(stamped, path)


def delete_matches(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete (season, match_id) rows by rewriting only their partitions."""
    current = _raw(spark, path)
    touched = _of_seasons(current, ids)
    kept = stored(touched.join(ids, ["season", "match_id"], "left_anti"), "delete")
    emptied = ids.select("season").distinct().join(
        kept.select("season").distinct(), "season", "left_anti")
    _write(kept, path)
    for row in emptied.toLocalIterator():  # one entry per fully emptied season
        _drop_partition(spark, f"{path}/season={row['season']}")


def load_match(spark: SparkSession, path: str, season: str, match_id: str) -> DataFrame:
    return read_documents(spark, path, season).where(F.col("match_id") == match_id)


def list_matches(spark: SparkSession, path: str, season: str | None = None) -> DataFrame:
    return read_documents(spark, path, season).select("season", "match_id").distinct()


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Documents per season directory, from the file paths."""
    where = F.regexp_extract(F.col("_metadata.file_path"), r"season=([^/]+)", 1)
    return spark.read.schema("match_id string").json(path).select(
        where.alias("year")).groupBy("year").agg(F.count("*").alias("n_documents"))


def safe_extract(path: str, default=None) -> Column:
    value = F.col(path)
    return value if default is None else F.coalesce(value, F.lit(default))


# Flat column, document statistic, default when absent.
FULL_TIME_COLUMNS = [
    ("possession", "possession", 50), ("shots_on_target", "shots_on_goal", 0),
    ("shots_off_target", "shots_off_goal", 0), ("total_shots", "goal_attempts", 0),
    ("blocked_shots", "blocked_shots", 0), ("corners", "corner_kicks", 0), ("fouls", "fouls", 0),
    ("yellow_cards", "yellow_cards", 0), ("red_cards", "red_cards", 0),
    ("goalkeeper_saves", "goalkeeper_saves", 0), ("offsides", "offsides", 0),
]
HALF_COLUMNS = [("possession", "possession"), ("shots_on_target", "shots_on_goal")]


def flatten(documents: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """Nested document to the flat 54-column match row, with the loader's defaults.

    ``odds``: match_id and mean odds of every match (``quotes.flat_odds``); without it they are taken over all
    quotes nested in the documents.
    """
    home, away = F.col("home_score"), F.col("away_score")
    stats = []
    for name, stat, default in FULL_TIME_COLUMNS:
        for side in ("home", "away"):
            stats.append(safe_extract(f"full_time_stats.{stat}.{side}", default)
                         .alias(f"{name}_{side}"))
    for half, block in (("1h", "first_half_stats"), ("2h", "second_half_stats")):
        for name, stat in HALF_COLUMNS:
            for side in ("home", "away"):
                stats.append(safe_extract(f"{block}.{stat}.{side}").alias(f"{name}_{half}_{side}"))
    documents = documents.withColumn("file_path", F.col("_metadata.file_path"))
    if odds is None:
        odds = flat_odds(unnested(documents))
    documents = documents.join(odds, "match_id", "left")
    flat = documents.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("match_id", "date", "home_team", "away_team")],
        "home_score", "away_score",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("season", "competition", "stage", "status")],
        F.when(home > away, "H").when(home < away, "A").when(home == away, "D").alias("result"),
        (home + away).alias("total_goals"),
        ((home > 0) & (away > 0)).alias("both_teams_scored"),
        (home - away).alias("goal_difference"),
        *stats,
        *[f"odds_{k}" for k in FLAT_ODDS],
        "file_path", F.regexp_extract("file_path", r"season=([^/]+)", 1).alias("year"),
    )
    implied = {"home": "home_win", "draw": "draw", "away": "away_win"}
    made = [F.try_divide(F.lit(1.0), F.col(f"odds_{v}")).alias(f"implied_prob_{k}")
            for k, v in implied.items()]
    columns = flat.columns
    at = columns.index("odds_under_2_5") + 1
    return flat.select(*columns[:at], *made, *columns[at:])


def wide_statistics(long: DataFrame, keys: list[str]) -> DataFrame:
    """(match_id, key, value text) to one numeric column per known key; unknown text becomes null."""
    return long.groupBy("match_id").pivot("key", keys).agg(
        F.first(F.col("value").try_cast("double"), ignorenulls=True))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    meta = T.StructType([T.StructField("scraped_at", T.StringType()),
                         T.StructField("season", T.StringType())])
    schema = T.StructType([*MATCH_SCHEMA.fields, T.StructField("_metadata", meta), SEASON_FIELD])
    return spark.read.schema(schema).json(path)


def _of_seasons(documents: DataFrame, others: DataFrame) -> DataFrame:
    """Documents of the seasons that ``others`` hold.

    A season is a directory, so there are few and they are broadcast: dealt out by season, the documents of one
    would all be in one task, and the join by season and id that follows would leave them there.
    """
    return documents.join(F.broadcast(others.select("season").distinct()), "season", "left_semi")


def _write(documents: DataFrame, path: str) -> None:
    """One directory per season; AQE evens out the tasks and splits a season that is too large.

    Texts are compressed: field names make up most of a document.
    """
    (documents.hint("rebalance", F.col("season"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
     .partitionBy("season").json(path))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def _drop_partition(spark: SparkSession, path: str) -> None:
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)


def statistics_struct(exprs: dict[str, tuple[str, str]]) -> Column:
    """Struct of (home, away) pairs from SQL texts; absent statistics are null."""
    out = []
    for stat in STATISTICS:
        kind = "double" if stat == "expected_goals" else "int"
        if stat in exprs:
            h, a = exprs[stat]
            pair = F.struct(F.expr(h).cast(kind).alias("home"), F.expr(a).cast(kind).alias("away"))
        else:
            pair = F.lit(None).cast(f"struct<home:{kind},away:{kind}>")
        out.append(pair.alias(stat))
    return F.struct(*out)
