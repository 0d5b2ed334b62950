"""Training-corpus pipeline: stages over ``documents``, each applying one operator of ``touchline.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``docs``. ``run`` writes each result as Parquet in the shared folder and reads it again as
the next stage's input. Rows are told apart by their place in that stored input, so repeated ids do no
harm. Nulls, empty texts and empty tables go through every stage as its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.decontamination import contaminated
from touchline.llm.language_id import UNKNOWN, fit, identified
from touchline.llm.line_dedup import without_repeated_lines
from touchline.llm.near_dedup import near_groups
from touchline.llm.packing import packed
from touchline.llm.storage import bounded, keep, prepare, table, unused

MIN_LANGUAGE_SCORE = 0.3   # least part of a text's n-grams that its language must know


def placed(docs: DataFrame, name: str = "row_no") -> DataFrame:
    return docs.withColumn(name, F.monotonically_increasing_id())


def compared(docs: DataFrame) -> DataFrame:
    """What the operators on pairs look at; other columns, whatever their names, stay out."""
    return placed(docs.select("doc_id", "text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``gone`` (row_no)."""
    row = unused(docs, "__row")
    gone = bounded(keep(gone.select(F.col("row_no").alias(row)).distinct(), "gone"))
    return placed(docs, row).join(gone, row, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose best language knows few of their n-grams."""
    prepare(spark)
    name = unused(docs, "__language")
    found = docs.withColumn(name, identified(docs, fit(docs)))
    sure = (F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines of any length and nearly repeated long ones out of the texts; a text that loses every
    line goes. Empty lines stay.

    ``n_chars`` becomes the length of the new text where it changed.
    """
    prepare(spark)
    row, changed = unused(docs, "__row_no"), unused(docs, "__lines_gone")
    left = without_repeated_lines(placed(docs, row), row, changed=changed)
    length = F.length("text").cast("bigint")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(changed) > 0, length).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    prepare(spark)
    return without(docs, near_groups(compared(docs)).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = contaminated(compared(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two length, one sequence each."""
    prepare(spark)
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None  # similarity search and token ids have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
