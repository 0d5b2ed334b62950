"""Outcome models of MLlib: forest and two boosted variants, one probability contract (p_H, p_D, p_A)."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.probability import OUTCOMES, best_outcome, normalised
from touchline.operators import boosting
from touchline.operators.folds import stratified_folds
from touchline.operators.metrics import macro_scores

CLASSES = ("A", "D", "H")  # label order of an alphabetical encoder
SEED = 42
FIT_THREADS = 8          # fits that wait for their many small jobs side by side
FIT_PARTITION = 20_000   # rows of a partition that is fitted on, at least; a smaller table has fewer partitions
GROWN = {"maxIter", "maxDepth", "stepSize", "minInstancesPerNode"}    # what ``boosting.grow`` knows; it draws no rows or features
# Search ranges (low, high) or choices per model type.
SEARCH_SPACE = {
    "boosted_a": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3),
                  "subsamplingRate": (0.6, 1.0), "colsample": (0.6, 1.0)},
    "boosted_b": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3),
                  "subsamplingRate": (0.6, 1.0), "colsample": (0.6, 1.0),
                  "minInstancesPerNode": (5, 100)},
    "forest": {"numTrees": (50, 300), "maxDepth": (3, 20), "minSplit": (2, 20), "minInstancesPerNode": (1, 20),
               "featureSubsetStrategy": ["sqrt", "log2", "all"], "bootstrap": [True, False]},
}
DEFAULTS = {
    "boosted_a": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
    "boosted_b": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "minInstancesPerNode": 20},
    "forest": {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt"},
}


def label_index():
    """Classes as 0, 1, 2 in alphabetical order."""
    out = F.when(F.col("label") == CLASSES[0], 0.0)
    for i, c in enumerate(CLASSES[1:], 1):
        out = out.when(F.col("label") == c, float(i))
    return out


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero-fill and pack the features in their stored order."""
    filled = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                             for i, c in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(filled).drop(*names)


@dataclass
class OutcomeModel:
    """A fitted model with the feature order and classes it was trained on."""

    kind: str
    features: list[str]
    parts: dict[str, object] = field(default_factory=dict)  # class -> binary model, or "all"
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Add p_H, p_D, p_A (sum 1), predicted, confidence and model."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        out = assemble(df, self.features)
        if "all" in self.parts:
            forest = self.parts["all"].setFeaturesCol("_x").setPredictionCol("_y") \
                .setRawPredictionCol("_raw").setProbabilityCol("_p")
            out = forest.transform(out)
            p = vector_to_array("_p")
            raw = {c: p[i] for i, c in enumerate(CLASSES)}
            out = out.withColumns({f"_p_{c}": e for c, e in raw.items()}).drop("_y", "_raw", "_p")
        else:
            for c, binary in self.parts.items():
                binary = binary.setFeaturesCol("_x").setPredictionCol("_y") \
                    .setRawPredictionCol("_raw").setProbabilityCol("_p")
                out = binary.transform(out).withColumn(f"_p_{c}", vector_to_array("_p")[1]) \
                    .drop("_y", "_raw", "_p")
            for c in set(CLASSES) - set(self.parts):
                out = out.withColumn(f"_p_{c}", F.lit(0.0))
        shares = normalised([F.col(f"_p_{o}") for o in OUTCOMES])
        out = out.withColumns({f"p_{o}": s for o, s in zip(OUTCOMES, shares, strict=True)})
        parts = [F.col(f"p_{o}") for o in OUTCOMES]
        return out.drop("_x", *[f"_p_{c}" for c in CLASSES]).withColumns({
            "predicted": best_outcome(parts), "confidence": F.greatest(*parts),
            "model": F.lit(name or self.kind)})

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), the binary parts of a boosted model averaged."""
        vectors = [m.featureImportances.toArray() for m in self.parts.values()]
        mean = sum(vectors) / len(vectors)
        return spark.createDataFrame(
            [(f, float(v)) for f, v in zip(self.features, mean, strict=True)],
            "feature string, importance double")

    def save(self, path: str, spark: SparkSession) -> None:
        for name, part in self.parts.items():
            part.write().overwrite().save(f"{path}/part={name}")
        meta = json.dumps({"kind": self.kind, "features": self.features, "classes": CLASSES,
                           "parts": list(self.parts), "params": self.params})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> OutcomeModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    loader = RandomForestClassificationModel if meta["kind"] == "forest" else GBTClassificationModel
    return OutcomeModel(meta["kind"], meta["features"],
                        {p: loader.load(f"{path}/part={p}") for p in meta["parts"]}, meta["params"])


def fit(kind: str, df: DataFrame, features: Sequence[str], params: dict | None = None,
        seed: int = SEED) -> OutcomeModel:
    """Fit on rows with a label H/D/A.  Boosting is binary in MLlib, so one model per class, side by side.

    Trees take one small job per level, so a small table is kept in few partitions. ``minSplit`` of a search has no
    counterpart in MLlib and is left out.
    """
    features = list(features)
    params = {**DEFAULTS[kind], **(params or {})}
    if kind != "forest" and set(params) <= GROWN:
        return _boosted([(kind, df, features, params)], seed)[0]
    options = {k: v for k, v in params.items() if k != "minSplit"}
    data = assemble(df, features).select("_x", label_index().alias("_label"), "label")
    whole = data.persist()
    try:
        parts = max(1, -(-whole.count() // FIT_PARTITION))
        data = whole.coalesce(parts) if parts < whole.rdd.getNumPartitions() else whole
        if kind == "forest":
            forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", seed=seed, **options)
            return OutcomeModel(kind, features, {"all": forest.fit(data)}, params)
        if "colsample" in options:
            options["featureSubsetStrategy"] = str(options.pop("colsample"))

        def binary(c: str):
            one = data.withColumn("_is", F.when(F.col("label") == c, 1.0).otherwise(0.0))
            return GBTClassifier(featuresCol="_x", labelCol="_is", seed=seed, **options).fit(one)

        with ThreadPoolExecutor(len(CLASSES)) as pool:
            return OutcomeModel(kind, features, dict(zip(CLASSES, pool.map(binary, CLASSES), strict=True)), params)
    finally:
        whole.unpersist()


def _boosted(wanted: Sequence[tuple], seed: int = SEED) -> list[OutcomeModel]:
    """Boosted models of several (kind, rows, features, params), whose trees grow in the same jobs."""
    spark = wanted[0][1].sparkSession
    grown = boosting.grow(spark, [(boosting.rows_of(assemble(df, features).select("_x", label_index().alias("_label"))),
                                   len(features), params) for _, df, features, params in wanted], len(CLASSES))
    with ThreadPoolExecutor(FIT_THREADS) as pool:
        parts = [[pool.submit(boosting.as_model, spark, ensemble, borders, seed) for ensemble in ensembles]
                 for ensembles, borders in grown]
        return [OutcomeModel(kind, list(features), {c: part.result() for c, part in zip(CLASSES, mine, strict=True)}, params)
                for (kind, _, features, params), mine in zip(wanted, parts, strict=True)]


def fit_all(wanted: Sequence[tuple], threads: int = FIT_THREADS) -> list[OutcomeModel]:
    """Models of several (kind, rows, features, params): the boosted ones in the same jobs, then the others side by side
    (beside them, every small job of boosting would wait for tasks of a forest)."""
    wanted = [(kind, rows, features, {**DEFAULTS[kind], **((more and more[0]) or {})}) for kind, rows, features, *more in wanted]
    together = [i for i, (kind, _, _, params) in enumerate(wanted) if kind != "forest" and set(params) <= GROWN]
    found = dict(zip(together, _boosted([wanted[i] for i in together]), strict=True)) if together else {}
    alone = [i for i in range(len(wanted)) if i not in found]
    with ThreadPoolExecutor(threads) as pool:
        found |= zip(alone, pool.map(lambda i: fit(*wanted[i]), alone), strict=True)
    return [found[i] for i in range(len(wanted))]


def draw_params(kind: str, rng: random.Random) -> dict:
    out = {}
    for name, span in SEARCH_SPACE[kind].items():
        if isinstance(span, list):
            out[name] = rng.choice(span)
        elif all(isinstance(v, int) for v in span):
            out[name] = rng.randint(*span)
        else:
            out[name] = rng.uniform(*span)
    return out


def without_folds(kind: str, folded: DataFrame, features: Sequence[str], k: int, params: dict | None = None) -> list[tuple]:
    """What ``fit_all`` is asked for models that each leave out one fold."""
    return [(kind, folded.where(F.col("fold") != i), features, params) for i in range(k)]


def out_of_fold(kind: str, folded: DataFrame, features: Sequence[str], k: int,
                params: dict | None = None, keep: Sequence[str] = ("match_id", "label", "fold"),
                fitted: Sequence[OutcomeModel] | None = None) -> DataFrame:
    """Predictions for every row by a model that did not see its fold (``fitted``: these models, if made already)."""
    fitted = fitted or fit_all(without_folds(kind, folded, features, k, params))
    parts = [model.transform(folded.where(F.col("fold") == i)).select(
        *keep, "model", "predicted", "confidence", "p_H", "p_D", "p_A") for i, model in enumerate(fitted)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(kind: str, df: DataFrame, features: Sequence[str], key: str = "match_id", trials: int = 50,
           k: int = 5, seed: int = SEED, narrow: dict | None = None) -> tuple[dict, DataFrame]:
    """Seeded random search with stratified k-fold accuracy by fitting every trial on all rows; returns (best params,
    trial table). ``search.search_forests`` is the quicker way for forests."""
    rng = random.Random(seed)
    spark = df.sparkSession
    drawn = [{**draw_params(kind, rng), **(narrow or {})} for _ in range(trials)]
    folded = stratified_folds(df, "label", key, k, seed).persist()
    folded.count()
    rows = []
    for t, params in enumerate(drawn):
        scores = macro_scores(out_of_fold(kind, folded, features, k, params), ["fold"])
        rows.append((t, json.dumps(params), float(scores.agg(F.avg("accuracy")).first()[0])))
    folded.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))
    return json.loads(best[1]), spark.createDataFrame(rows, "trial int, params string, accuracy double")
