"""Exact splits without a global sort: ranks are counted per block and offset by the blocks before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.operators.asof import running_totals

HASH_BLOCK_SHIFT = 44  # top 20 bits of the hash: 2**40 rows make a million blocks of a million rows


def blocked_rank(df: DataFrame, group: str, block: Column, *order: Column) -> DataFrame:
    """``rank`` (1..n) within ``group`` by (block, order), and the group's size ``group_rows``.

    ``block`` must be monotone in the order; it bounds what one task sorts.
    """
    df = df.withColumn("_block", block)
    sizes = df.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    line = Window.partitionBy(group).orderBy("_block")
    offsets = sizes.select(
        group, "_block",
        F.coalesce(F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_offset"),
        F.sum("_size").over(Window.partitionBy(group)).alias("group_rows"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside)).join(offsets, [group, "_block"])
        .withColumn("rank", F.col("_rn") + F.col("_offset")).drop("_block", "_rn", "_offset")
    )


def shuffled_rank(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    h = F.xxhash64(F.lit(seed), F.col(key))
    return blocked_rank(df, group, F.shiftrightunsigned(h, HASH_BLOCK_SHIFT), h, F.col(key))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, every class spread evenly, in hashed order."""
    return shuffled_rank(df, label, key, seed).withColumn(
        "fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_rows")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train``: exactly the rounded share of every class."""
    return shuffled_rank(df, label, key, seed).withColumn(
        "is_train", F.col("rank") <= F.round(F.col("group_rows") * share)).drop("rank", "group_rows")


def time_index(df: DataFrame) -> DataFrame:
    """``idx`` 0..n-1 by (date, match_id) and the row count ``rows``."""
    numbered = running_totals(
        df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), "_all", ["_one"])
    total = df.agg(F.count("*").alias("rows"))
    return numbered.withColumn("idx", F.col("run__one") - 1).drop("_all", "_one", "run__one").join(
        F.broadcast(total))


def expanding_folds(indexed: DataFrame, k: int = 5) -> DataFrame:
    """(row, fold, part): fold i tests one slice and trains on everything earlier."""
    test = F.floor(F.col("rows") / (k + 1))
    return _parts(indexed, k, lambda i: (F.lit(0), F.col("rows") - (k - i) * test,
                                         F.col("rows") - (k - i) * test,
                                         F.col("rows") - (k - i - 1) * test))


def blocked_folds(indexed: DataFrame, k: int = 5) -> DataFrame:
    """Fold 0 trains on the two blocks after it, every other fold on all blocks before it."""
    size = F.floor(F.col("rows") / k)

    def bounds(i: int):
        if i == 0:
            return size, F.least(size * 3, F.col("rows")), F.lit(0), size
        return F.lit(0), size * i, size * i, F.least(size * (i + 1), F.col("rows"))

    return _parts(indexed, k, bounds)


def _parts(indexed: DataFrame, k: int, bounds) -> DataFrame:
    idx = F.col("idx")
    roles = []
    for i in range(k):
        a, b, c, d = bounds(i)
        part = F.when((idx >= c) & (idx < d), "test").when((idx >= a) & (idx < b), "train")
        roles.append(F.when(part.isNotNull(), F.struct(F.lit(i).alias("fold"), part.alias("part"))))
    return indexed.withColumn("_role", F.explode(F.array_compact(F.array(*roles)))).select(
        *indexed.columns, "_role.fold", "_role.part")
