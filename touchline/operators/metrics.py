"""Classification metrics over a predictions table (…, label, predicted, p_H, p_D, p_A).

Everything is counted in Spark; only class-sized tables are pivoted.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.probability import OUTCOMES

TINY = 1e-15
SCORE_BINS = 100_000


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "predicted").agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; classes seen as label or prediction count."""
    cells = confusion(predictions, by)
    roles = cells.select(*by, "n", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("is_label"), F.lit(0).alias("is_predicted"),
                 (F.col("label") == F.col("predicted")).cast("int").alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("is_label"),
                 F.lit(1).alias("is_predicted"), F.lit(0).alias("hit")))).alias("r"))
    sums = roles.groupBy(*by, F.col("r.class").alias("class")).agg(
        F.sum(F.col("n") * F.col("r.hit")).alias("tp"),
        F.sum(F.col("n") * F.col("r.is_label")).alias("support"),
        F.sum(F.col("n") * F.col("r.is_predicted")).alias("claimed"))
    tp = F.col("tp").cast("double")
    zero = F.lit(0.0)
    return sums.select(
        *by, "class",
        F.coalesce(F.try_divide(tp, F.col("claimed")), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(tp * 2, F.col("claimed") + F.col("support")), zero).alias("f1"),
        "support", "tp")


def macro_scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_report(predictions, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))


def fold_summary(per_fold: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of each score over the folds."""
    scores = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
    return per_fold.groupBy(*by).agg(*[
        a for s in scores for a in (F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"))])


def label_probability() -> Column:
    out = None
    for o in OUTCOMES:
        out = F.when(F.col("label") == o, F.col(f"p_{o}")) if out is None else out.when(
            F.col("label") == o, F.col(f"p_{o}"))
    return out


def log_loss() -> Column:
    p = F.least(F.greatest(label_probability(), F.lit(TINY)), F.lit(1 - TINY))
    return F.avg(-F.log(p))


def brier() -> Column:
    return F.avg(sum(
        (F.pow(F.col(f"p_{o}") - F.when(F.col("label") == o, 1.0).otherwise(0.0), 2) for o in OUTCOMES),
        F.lit(0.0)))


def pairwise_auc(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One-vs-one macro AUC by rank sums.

    Scores are counted first (distinct score, positives, negatives); the cumulative negatives are
    taken inside narrow score bins and over the bins, so no task walks a whole score list.
    """
    pairs = [F.struct(F.lit(i).alias("pos"), F.lit(j).alias("neg"), F.col(f"p_{i}").alias("score"))
             for i, j in permutations(OUTCOMES, 2)]
    rows = predictions.select(*by, "label", F.explode(F.array(*pairs)).alias("q")).where(
        (F.col("label") == F.col("q.pos")) | (F.col("label") == F.col("q.neg")))
    keys = [*by, "pos", "neg"]
    counts = rows.groupBy(*by, F.col("q.pos").alias("pos"), F.col("q.neg").alias("neg"),
                          F.col("q.score").alias("score")).agg(
        F.count_if(F.col("label") == F.col("q.pos")).alias("n_pos"),
        F.count_if(F.col("label") == F.col("q.neg")).alias("n_neg"),
    ).withColumn("bin", F.floor(F.col("score") * SCORE_BINS))
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n_neg").alias("bin_neg"))
    line = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_neg").over(line), F.lit(0))).drop("bin_neg")
    inside = Window.partitionBy(*keys, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("in_bin", F.coalesce(F.sum("n_neg").over(inside), F.lit(0))).join(
        bins, [*keys, "bin"])
    below = F.col("before") + F.col("in_bin") + F.col("n_neg") / 2
    one = placed.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n_pos") * below), F.sum("n_pos") * F.sum("n_neg")).alias("auc"))
    return one.groupBy(*by).agg(F.avg("auc").alias("auc_ovo"))


def missing_share(df: DataFrame, columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns)
