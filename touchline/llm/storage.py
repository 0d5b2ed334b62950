"""Reading tables and cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import fresh_dir, tune

# Rows per Arrow batch, for short texts; long texts make smaller batches (maxBytesPerBatch, 64 MB).
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """A written copy in the shared folder: a lost executor costs a re-read, not a recompute."""
    path = fresh_dir(df.sparkSession, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``row_no``, which tells repeated rows apart once the result is stored."""
    return docs.select(*columns, F.monotonically_increasing_id().alias("row_no"))


def unused(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


# Narrow rows that may be broadcast once they have been counted; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table, marked for broadcast only if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= rows else df
