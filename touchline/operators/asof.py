"""Point-in-time recipes shared by every feature family.

All matches of one team on one date share one history (strictly earlier dates), so state is kept
per (team, date), never per match.  A team's timeline is therefore as long as the calendar, however
many matches one team owns:

* additive history (counts, sums) is pre-aggregated per (team, date) with map-side combine;
* last-N history keeps at most N rows per (team, date) before anything is shuffled by team
  (``row_number() <= N`` becomes a partial group limit on the map side);
* order-dependent history (streaks, medians by rank) uses ``running_totals``, a prefix sum in three
  levels whose windows never span more than one block, one day or one calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ID_BLOCK_BITS = 20
ID_PREFIX = 8
UNBOUNDED = Window.unboundedPreceding


def match_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one per team, from a single scan."""
    def side(team, opponent, gf, ga, home):
        return F.struct(
            F.col(team).alias("team"), F.col(opponent).alias("opponent"),
            F.lit(home).alias("is_home"),
            F.col(gf).alias("gf"), F.col(ga).alias("ga"),
        )

    both = F.array(
        side("home_team", "away_team", "home_score", "away_score", True),
        side("away_team", "home_team", "away_score", "home_score", False),
    )
    return (
        matches.select("match_id", "date", F.explode(both).alias("s"))
        .select("match_id", "date", "s.*")
        .withColumn("finished", F.col("gf").isNotNull() & F.col("ga").isNotNull())
    )


def with_outcome(sides: DataFrame) -> DataFrame:
    """Goal difference, points and result flags from the side's own view (finished rows only)."""
    gd = F.col("gf") - F.col("ga")
    return sides.where("finished").select(
        "match_id", "date", "team", "opponent", "is_home", "gf", "ga",
        gd.alias("gd"),
        F.when(gd > 0, 3).when(gd == 0, 1).otherwise(0).alias("points"),
        F.when(F.col("is_home"), F.col("team")).otherwise(F.col("opponent")).alias("venue_team"),
    )


def probe_keys(sides: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Distinct (team, date) points to take a snapshot for, finished or scheduled."""
    keys = sides.select("team", "date")
    if probes is not None:
        keys = keys.unionByName(match_sides(probes).select("team", "date"))
    return keys.distinct()


def recent_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows that can still be among the last ``n`` of some snapshot: the newest n per (key, date)."""
    newest = Window.partitionBy(key, "date").orderBy(F.col("match_id").desc())
    return rows.withColumn("day_rank", F.row_number().over(newest)).where(F.col("day_rank") <= n)


def timeline(key: str):
    return Window.partitionBy(key).orderBy("date", "match_id")


def last_n(key: str, n: int):
    return timeline(key).rowsBetween(-(n - 1), 0)


def day_state(recent: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Evaluate window columns and keep one row per (key, date): the state after that date."""
    return (
        recent.select(key, "date", "day_rank", *[c.alias(n) for n, c in columns.items()])
        .where(F.col("day_rank") == 1)
        .select(key, "date", F.struct(*columns).alias("state"))
    )


def before(key: str):
    """Frame over a day table: every earlier date of the same key."""
    return Window.partitionBy(key).orderBy("date").rowsBetween(UNBOUNDED, -1)


def days_before(key: str, days: int):
    """Frame over a day table: dates in [d - days, d)."""
    return Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(-days, -1)


def text_prefix(rows: DataFrame, by: Sequence[str], bits: int = ID_BLOCK_BITS) -> int:
    """Least number of leading characters of ``match_id``, ``ID_PREFIX`` at least, at which no (by, prefix) holds more
    than 2**bits rows; if only whole ids do, their length.

    What all ids begin with is skipped, then each step counts the rows by a prefix of one more character.
    """
    match_id = F.col("match_id")
    n, longest, first, last = rows.agg(F.count(match_id), F.max(F.length(match_id)), F.min(match_id), F.max(match_id)).first()
    if n <= 1 << bits:
        return ID_PREFIX
    length = max(ID_PREFIX, len(commonprefix([first, last])) + 1)
    while length < longest:
        counted = rows.groupBy(*by, F.substring(match_id, 1, length).alias("blk")).count()
        if counted.agg(F.max("count")).first()[0] <= 1 << bits:
            break
        length += 1
    return length


def id_block_of(rows: DataFrame, by: Sequence[str], bits: int = ID_BLOCK_BITS) -> Column:
    """Coarse, order-preserving block of a match id, with at most 2**bits unique ids in a (by, block): the leading
    bits of a number, or as many leading characters of a text as that takes."""
    if isinstance(rows.schema["match_id"].dataType, T.IntegralType):
        return F.shiftright("match_id", bits)
    return F.substring("match_id", 1, text_prefix(rows, by, bits))


def running_totals(
    rows: DataFrame, key: str, measures: Sequence[str], bits: int = ID_BLOCK_BITS,
) -> DataFrame:
    """Inclusive running totals ``run_<m>`` per key in (date, match_id) order.

    Three levels, so that no task ever holds a whole key: inside a (key, date, block), over the
    blocks of one date, over the dates of one key.
    """
    rows = rows.withColumn("blk", id_block_of(rows, [key, "date"], bits))
    inside = (
        Window.partitionBy(key, "date", "blk").orderBy("match_id").rowsBetween(UNBOUNDED, 0)
    )
    blocks = rows.groupBy(key, "date", "blk").agg(*[F.sum(m).alias(m) for m in measures])
    over_blocks = Window.partitionBy(key, "date").orderBy("blk").rowsBetween(UNBOUNDED, -1)
    days = blocks.groupBy(key, "date").agg(*[F.sum(m).alias(m) for m in measures]).select(
        key, "date",
        *[F.coalesce(F.sum(m).over(before(key)), F.lit(0)).alias(f"day_{m}") for m in measures],
    )
    offsets = (
        blocks.select(
            key, "date", "blk",
            *[F.coalesce(F.sum(m).over(over_blocks), F.lit(0)).alias(f"off_{m}") for m in measures],
        )
        .join(days, [key, "date"])
        .select(key, "date", "blk",
                *[(F.col(f"off_{m}") + F.col(f"day_{m}")).alias(f"off_{m}") for m in measures])
    )
    return (
        rows.select("*", *[F.sum(m).over(inside).alias(f"in_{m}") for m in measures])
        .join(offsets, [key, "date", "blk"])
        .select(*[c for c in rows.columns if c != "blk"],
                *[(F.col(f"in_{m}") + F.col(f"off_{m}")).alias(f"run_{m}") for m in measures])
    )


def league_recent(matches: DataFrame, dates: DataFrame, n: int) -> DataFrame:
    """Last ``n`` finished matches of the whole league strictly before each date, with ``age`` 1..n.

    Only the newest n rows per date take part; the global order is a running count over the
    calendar (one row per distinct date), and each date asks for n consecutive positions.
    """
    finished = matches.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    counts = finished.groupBy("date").agg(F.count("*").alias("n_day"))
    asked = dates.select("date").distinct()
    calendar = (
        counts.unionByName(asked.select("date", F.lit(0).cast("bigint").alias("n_day")))
        .groupBy("date").agg(F.sum("n_day").alias("n_day"))
        .select("date", "n_day",
                F.coalesce(F.sum("n_day").over(
                    Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(UNBOUNDED, -1)),
                    F.lit(0)).alias("cum_before"))
    )
    newest = Window.partitionBy("date").orderBy(F.col("match_id").desc())
    placed = (
        finished.withColumn("day_rank", F.row_number().over(newest))
        .where(F.col("day_rank") <= n)
        .join(calendar, "date")
        .withColumn("g", F.col("cum_before") + F.col("n_day") - F.col("day_rank") + 1)
        .withColumnRenamed("date", "played")
        .drop("n_day", "cum_before", "day_rank")
    )
    wanted = (
        asked.join(calendar, "date").where(F.col("cum_before") > 0)
        .select("date", "cum_before",
                F.explode(F.sequence(F.greatest(F.col("cum_before") - n + 1, F.lit(1)),
                                     F.col("cum_before"))).alias("g"))
    )
    return (
        wanted.join(placed, "g")
        .withColumn("age", (F.col("cum_before") - F.col("g") + 1).cast("int"))
        .drop("g", "cum_before")
    )
