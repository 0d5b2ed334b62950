"""Exact dedup with a heavy-hitter split.

Every text is reduced to a digest. Misra-Gries counters find digests that may be frequent; a second
pass counts those exactly and picks the row that stays. The verified winners, at most ``1/support``
of them, are broadcast, so rows of frequent texts are settled on the map side. All other digests
are grouped by an ordinary shuffle of narrow rows; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import keep, numbered, table

SUPPORT = 0.001
WHITESPACE = r"[\x20\x09-\x0D]"


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of ``WHITESPACE``; a null text
    counts as empty. The row with the most code points in the original text stays, then the smallest
    id; null ids come last, and of fully repeated rows exactly one stays. Equality is taken from the
    SHA-256 of the normalised text. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = numbered(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id", "text")
    digests = keep(rows.select(
        "id", "row_no",
        F.length(text).alias("n_points"),
        F.sha2(F.regexp_replace(text, WHITESPACE + "+", ""), 256).alias("digest")), "digests")

    # Order in which rows of a group are preferred: least first.
    rank = F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("n"),
                    F.col("id").alias("id"), F.col("row_no").alias("row_no"))
    best = [F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")]

    frequent = F.lit(support * digests.count())
    suspected = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        digests.join(F.broadcast(suspected), "digest")   # at most 1/support rows
        .groupBy("digest").agg(*best).where(F.col("group_size") >= frequent))
    winners = F.broadcast(keep(winners, "winners"))

    settled = digests.join(winners, "digest")
    others = digests.join(winners, "digest", "left_anti")
    grouped = others.join(others.groupBy("digest").agg(*best), "digest")
    return settled.unionByName(grouped).select(
        F.col("id").alias(id_column),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.col("digest").alias("text_sha256"))


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x
  from documents)
select doc_id,
  first_value(doc_id) over (partition by x order by n_points desc, doc_id) as keep_id,
  count(*) over (partition by x) as group_size,
  row_number() over (partition by x order by n_points desc, doc_id) = 1 as kept,
  sha256(x) as text_sha256
from t"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
