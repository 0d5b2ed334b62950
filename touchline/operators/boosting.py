"""Boosted trees for many binary problems at once: MLlib's algorithm, with one job per level for all of them.

``GBTClassifier`` runs jobs of its own for every class, fold and level. Here the rows of all wanted models lie side by side
as blocks of binned features; a job counts, for the open nodes of all trees that grow, rows and residuals by feature and
bin, and the driver picks the splits from these sums. Splits, leaves, weights and loss are those of MLlib: candidate
thresholds of at most 32 bins, variance as impurity, residuals 4y / (1 + exp(2yF)) of the logistic loss, a first tree of
weight 1 and later ones of the step size. The trees are written in MLlib's format, so a model is a
``GBTClassificationModel``.

What a task sends back is a table of fixed size per tree; tables of many tasks are added up before they reach the driver.
"""

from __future__ import annotations

import functools
import json
import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import fresh_dir

BINS = 32
EXACT_ROWS = 10_000     # up to here thresholds come from every value, beyond from as many quantiles of all rows
BLOCK_ROWS = 1 << 16     # rows of a block, about
LEAST_BLOCK = 1 << 14    # the same where there are few rows; holds a table of EXACT_ROWS
PARTITION_ROWS = 20_000 # rows of a partition, at least
RESTART = 25            # rounds after which scores are summed again from the stored bins, which keeps the lineage short
PAIRED = 8              # open nodes up to which features are counted in pairs: tables of more nodes cost more than they save
DIRECT = 64             # tables that the driver adds up itself
KEPT = StorageLevel(True, True, False, True)    # blocks are bytes: memory, then disk, nothing to serialise
NOISE = 1e-12           # share of a node's squares that a gain must exceed


# --- thresholds -----------------------------------------------------------------------------------

def thresholds(values: np.ndarray, splits: int) -> np.ndarray:
    """MLlib's candidates among ``values`` (one column): middles between neighbours, at about equal counts."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= splits:
        return middles
    stride, found = len(values) / (splits + 1), []
    below, target = np.cumsum(counts), len(values) / (splits + 1)
    for i in range(1, len(distinct)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def all_thresholds(rows: DataFrame, width: int, total: int) -> list[np.ndarray]:
    """Thresholds of every feature of ``rows`` (x); the driver sees at most ``EXACT_ROWS`` values of a feature."""
    splits = min(BINS, total) - 1
    if total <= EXACT_ROWS:
        values = np.array(rows.select("x").toArrow().column("x").to_pylist(), float).reshape(total, width)
        return [thresholds(values[:, i], splits) for i in range(width)]
    at = ",".join(f"{(i + 0.5) / EXACT_ROWS:.6g}" for i in range(EXACT_ROWS))
    places = F.split(F.lit(at), ",").cast("array<double>")
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], places, EXACT_ROWS).alias(f"q{i}") for i in range(width)]).toArrow()
    return [thresholds(np.array(found.column(f"q{i}")[0].as_py(), float), splits) for i in range(width)]


# --- trees ----------------------------------------------------------------------------------------

@dataclass
class Ensemble:
    """What is grown for one binary problem."""

    depth: int
    step: float
    least: int
    trees: list[dict]


def root() -> dict:
    """A tree of one node; arrays over nodes. A leaf is its own child and sends all rows there."""
    return {"feature": np.zeros(1, np.int64), "cut": np.full(1, BINS, np.int64), "child": np.zeros(1, np.int64),
            "stats": np.zeros((1, 3)), "gain": np.full(1, -1.0), "value": np.zeros(1)}


def positions(tree: dict, flat: np.ndarray, n: int, steps: int, at: np.ndarray) -> np.ndarray:
    """Node of every row of a block after ``steps`` steps; ``flat``: bins by feature, then row."""
    node = np.zeros(n, np.int64)
    offset = tree["feature"] * n
    for _ in range(steps):
        place = offset.take(node)
        place += at
        right = flat.take(place) > tree["cut"].take(node)
        node = tree["child"].take(node)
        node += right
    return node


def residuals(signs: np.ndarray, scores: np.ndarray, small: bool = False) -> np.ndarray:
    """Of ``small`` tables with the exponential of the C library, which rounds like Java's."""
    power = 2.0 * signs * scores
    return 4.0 * signs / (1.0 + (np.array([math.exp(p) for p in power.tolist()]) if small else np.exp(power)))


def signs_of(classes: np.ndarray, c: int) -> np.ndarray:
    return np.where(classes == c, 1.0, -1.0)


def counted(keys: np.ndarray, bins: np.ndarray, nodes: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """Sums by (feature, node, bin), every sum in the order of the rows; ``keys``: node * bins."""
    return [np.stack([np.bincount(keys + b, w, nodes * BINS).reshape(nodes, BINS) for b in bins]).astype(float) for w in weights]


def counted_in_pairs(keys: np.ndarray, pairs: np.ndarray, nodes: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """The same sums, two features in one pass over their pairs of bins; ``keys``: node * bins * bins."""
    out = [np.empty((2 * len(pairs), nodes, BINS)) for _ in weights]
    for i, pair in enumerate(pairs):
        cell = keys + pair
        for sums, w in zip(out, weights, strict=True):
            table = np.bincount(cell, w, nodes * BINS * BINS).reshape(nodes, BINS, BINS)
            sums[2 * i], sums[2 * i + 1] = table.sum(axis=2), table.sum(axis=1)
    return out


def level_sums(blocks, trees: dict, level: int, depths: dict, first: bool, small: set[int]) -> Iterator[dict]:
    """For every ensemble the sums of its open nodes: by feature, node and bin rows and residuals (on the deepest level
    and for ``small`` units squared residuals too), by node squared residuals."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for unit, bins, classes, scores in blocks:
        width, n = bins.shape
        single = bins.astype(np.int64)
        wide = single if width % 2 == 0 else np.vstack([single, np.zeros((1, n), np.int64)])
        pairs = None if unit in small else wide[0::2] * BINS + wide[1::2]
        flat, at = bins.reshape(-1), np.arange(n)
        for c in range(len(scores)):
            if (unit, c) not in trees:
                continue
            tree, begin = trees[unit, c]
            nodes = len(tree["child"]) - begin
            signs = signs_of(classes, c)
            rest = signs if first else residuals(signs, scores[c], unit in small)
            node = positions(tree, flat, n, level, at) - begin
            paired = pairs is not None and nodes <= PAIRED
            mine = pairs if paired else single
            if level and node.min() < 0:                 # rows that came to a leaf above
                open_rows = np.flatnonzero(node >= 0)
                node, rest, mine = node[open_rows], rest[open_rows], mine[:, open_rows]
            squares = rest * rest
            weights = [None, rest, squares] if unit in small or level == depths[unit, c] - 1 else [None, rest]
            sums = counted_in_pairs(node * (BINS * BINS), mine, nodes, weights) if paired else counted(node * BINS, mine, nodes, weights)
            sums = [s[:width] for s in sums] + [np.bincount(node, squares, nodes)]
            if (unit, c) in found:
                for a, b in zip(found[unit, c], sums, strict=True):
                    a += b
            else:
                found[unit, c] = sums
    yield found


def added(a: dict, b: dict) -> dict:
    for key, sums in b.items():
        if key in a:
            for x, y in zip(a[key], sums, strict=True):
                x += y
        else:
            a[key] = sums
    return a


def split(tree: dict, begin: int, least: int, sums: list[np.ndarray], small: bool) -> tuple[dict, int]:
    """``tree`` with the open nodes (from ``begin``) split where it gains; their children are the open nodes then.

    Of equal gains the first feature's first cut counts. Gains of a ``small`` table are computed step by step as MLlib does,
    so that ties end alike.
    """
    squares, nodes = sums[-1], len(tree["child"]) - begin
    below = [s.cumsum(axis=2) for s in sums[:-1]]
    total, whole = below[0][0, :, -1], below[1][0, :, -1]
    left_rows, left = below[0][..., :-1], below[1][..., :-1]
    right_rows, right = below[0][..., -1:] - left_rows, below[1][..., -1:] - left
    fits = (left_rows >= least) & (right_rows >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        if small:
            def impurity(n, s, q):
                return (q - s * s / n) / n

            least_gain = 0.0
            left_squares = below[2][..., :-1]
            own = tree["stats"][begin:] if begin else np.stack([b[0, :, -1] for b in below], axis=1)    # as the split above left them
            gains = impurity(*own.T)[None, :, None] - left_rows / total[None, :, None] * impurity(
                left_rows, left, left_squares) - right_rows / total[None, :, None] * impurity(
                right_rows, right, below[2][..., -1:] - left_squares)
        else:
            least_gain = NOISE * squares / total
            gains = (left * left / left_rows + right * right / right_rows - (whole * whole / total)[None, :, None]) / total[None, :, None]
    by_node = np.where(fits, gains, -1.0).transpose(1, 0, 2).reshape(nodes, -1)
    best = by_node.argmax(axis=1)
    at, cuts = np.arange(nodes), BINS - 1
    feature, cut = best // cuts, best % cuts
    gain = by_node[at, best]
    kept = np.flatnonzero(gain > least_gain)
    out = {k: v.copy() for k, v in tree.items()}
    mine = slice(begin, begin + nodes)
    whole_stats = np.stack([total, whole, squares], axis=1)
    out["stats"][mine], out["value"][mine] = whole_stats, whole / total
    made = begin + nodes
    fresh = np.arange(made, made + 2 * len(kept))
    out["gain"][begin + kept], out["feature"][begin + kept], out["cut"][begin + kept] = gain[kept], feature[kept], cut[kept]
    out["child"][begin + kept] = fresh[::2]
    stats = np.zeros((len(kept), 2, 3))
    for i, s in enumerate(below):
        stats[:, 0, i] = s[feature[kept], kept, cut[kept]]
        stats[:, 1, i] = s[feature[kept], kept, -1] - stats[:, 0, i]
    if len(below) == 2:
        stats[:, 1, 2] = squares[kept]      # not known apart
    stats = stats.reshape(-1, 3)
    new = {"feature": np.zeros(len(fresh), np.int64), "cut": np.full(len(fresh), BINS, np.int64), "child": fresh, "stats": stats,
           "gain": np.full(len(fresh), -1.0), "value": stats[:, 1] / stats[:, 0]}
    return {k: np.concatenate([out[k], new[k]]) for k in out}, made


def with_scores(blocks, trees: dict[int, list[list[tuple[dict, float]]]], depth: dict[int, int]):
    """Blocks with the weighted values of ``trees`` (by unit and class, in their order) added to the scores."""
    for unit, bins, classes, scores in blocks:
        n = bins.shape[1]
        flat, at, scores = bins.reshape(-1), np.arange(n), scores.copy()
        for c, some in enumerate(trees[unit]):
            for tree, weight in some:
                scores[c] += weight * tree["value"].take(positions(tree, flat, n, depth[unit], at))
        yield unit, bins, classes, scores


# --- growing --------------------------------------------------------------------------------------

def binned(unit: int, rows: DataFrame, borders: list[np.ndarray], most: int):
    """An RDD of blocks (unit, bins by feature, class) of ``rows`` (x, y), of about ``most`` rows."""
    width = len(borders)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(parts):
            bins, label = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_pydict({"n": [len(label)], "bins": [bins.tobytes()], "label": [label.tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, width)
            held.append((np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)]).astype(np.uint8),
                         batch.column("y").to_numpy().astype(np.uint8)))
            n += batch.num_rows
            if n >= most:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    def unpack(r):
        bins = np.frombuffer(bytes(r.bins), np.uint8).reshape(width, r.n)
        return unit, bins, np.frombuffer(bytes(r.label), np.uint8)

    return rows.mapInArrow(pack, "n bigint, bins binary, label binary").rdd.map(unpack)


def dealt(blocks, parts: int, classes: int):
    """Blocks spread over ``parts`` partitions, with scores of zero."""
    every = blocks.getNumPartitions()
    placed = blocks.mapPartitionsWithIndex(lambda p, some: ((j * every + p, b) for j, b in enumerate(some)))
    return placed.partitionBy(parts, lambda at: at).map(lambda x: (*x[1], np.zeros((classes, len(x[1][2])))))


def grow(spark: SparkSession, wanted: Sequence[tuple[DataFrame, int, dict]], classes: int) -> list[tuple[list[Ensemble], list]]:
    """Per (rows, number of features, parameters) the ensembles of all classes against the rest, and the thresholds.

    Rows have x (array of doubles) and y (class as 0, 1, ...; another number is of no class).
    """
    sc, blocks, borders, parts = spark.sparkContext, [], [], 0
    cores = sc.defaultParallelism
    models: dict[tuple[int, int], Ensemble] = {}
    small: set[int] = set()     # few rows: sums are made in the order of MLlib
    held = [rows.persist() for rows, _, _ in wanted]
    try:
        for unit, (rows, (_, width, params)) in enumerate(zip(held, wanted, strict=True)):
            total = rows.count()
            if not total:
                raise ValueError("no rows to fit on")
            borders.append(all_thresholds(rows, width, total))
            if total <= EXACT_ROWS:
                small.add(unit)
            enough = -(-total // PARTITION_ROWS)
            few = rows.coalesce(enough) if enough < rows.rdd.getNumPartitions() else rows
            blocks.append(binned(unit, few, borders[-1], min(BLOCK_ROWS, max(LEAST_BLOCK, total // (4 * cores)))))
            parts += enough
            for c in range(classes):
                models[unit, c] = Ensemble(params["maxDepth"], params["stepSize"], params.get("minInstancesPerNode", 1), [])
        parts = min(parts, cores)
        base = dealt(sc.union(blocks), parts, classes).persist(KEPT)
        base.count()
    finally:
        for rows in held:
            rows.unpersist()
    rounds = [params["maxIter"] for _, _, params in wanted]
    depths = {key: model.depth for key, model in models.items()}
    deepest = {unit: depths[unit, 0] for unit in range(len(wanted))}
    state = base
    try:
        for m in range(max(rounds)):
            if m:
                again = m % RESTART == 0
                trees = {unit: [[(t, weight(models[unit, c], i)) for i, t in enumerate(models[unit, c].trees) if again or i == m - 1]
                                for c in range(classes)] for unit in range(len(wanted))}
                shared = sc.broadcast(trees)
                new = (base if again else state).mapPartitions(
                    lambda b, shared=shared: with_scores(b, shared.value, deepest)).persist(KEPT)
            else:
                new = base
            growing = {key: (root(), 0) for key in models if m < rounds[key[0]]}
            for level in range(max(deepest.values())):
                asked = {key: x for key, x in growing.items() if level < depths[key] and len(x[0]["child"]) > x[1]}
                if not asked:
                    break
                tables = new.mapPartitions(lambda b, a=asked, v=level, m=m: level_sums(b, a, v, depths, m == 0, small))
                sums = tables.treeReduce(added, 2) if parts > DIRECT else functools.reduce(added, tables.collect(), {})
                if level == 0 and state is not base and state is not new:
                    state.unpersist()
                for key, (tree, begin) in asked.items():
                    growing[key] = split(tree, begin, models[key].least, sums[key], key[0] in small)
            for key, (tree, _) in growing.items():
                models[key].trees.append(tree)
            state = new
    finally:
        state.unpersist()
        base.unpersist()
    return [([models[unit, c] for c in range(classes)], borders[unit]) for unit in range(len(wanted))]


def weight(model: Ensemble, i: int) -> float:
    return model.step if i else 1.0


# --- MLlib's format -------------------------------------------------------------------------------

NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
         "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def nodes_of(number: int, tree: dict, borders: list[np.ndarray]) -> list[tuple]:
    """Rows of one tree in the order of MLlib: a node, its left part, its right part. Two leaves of one value are one."""
    same: dict[int, bool] = {}
    for i in range(len(tree["child"]) - 1, -1, -1):
        child = int(tree["child"][i])
        leaf = child == i
        if not leaf and same[child] and same[child + 1] and tree["value"][child] == tree["value"][child + 1]:
            leaf = True
        same[i] = leaf
    out: list[list] = []

    def put(i: int) -> int:
        mine = len(out)
        n, s, q = (float(x) for x in tree["stats"][i])
        out.append([mine, float(tree["value"][i]), (q - s * s / n) / n, [n, s, q], int(n), -1.0, -1, -1, (-1, [], -1)])
        if not same[i]:
            f, cut, child = int(tree["feature"][i]), int(tree["cut"][i]), int(tree["child"][i])
            left, right = put(child), put(child + 1)
            out[mine][5:] = [float(tree["gain"][i]), left, right, (f, [float(borders[f][cut])], -1)]
        return mine

    put(0)
    return [(number, tuple(r)) for r in out]


def as_model(spark: SparkSession, model: Ensemble, borders: list[np.ndarray], seed: int) -> GBTClassificationModel:
    """The ensemble as MLlib's model, by way of its files in the shared folder."""
    path, now = fresh_dir(spark, "boosted"), int(time.time() * 1000)
    common = {"maxDepth": model.depth, "seed": seed, "minInstancesPerNode": model.least, "featuresCol": "_x", "labelCol": "_is", "impurity": "variance"}

    def about(kind: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": now, "sparkVersion": spark.version, "uid": uid, **more})

    trees = [(i, about("regression.DecisionTreeRegressionModel", f"dtr_{i}", paramMap=common, defaultParamMap={}), weight(model, i))
             for i in range(len(model.trees))]
    head = about("classification.GBTClassificationModel", "GBTClassifier_boosting", defaultParamMap={}, numFeatures=len(borders),
                 numTrees=len(trees), paramMap={**common, "maxIter": len(trees), "stepSize": model.step, "lossType": "logistic"})
    rows = [r for i, t in enumerate(model.trees) for r in nodes_of(i, t, borders)]
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(rows, NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def rows_of(assembled: DataFrame) -> DataFrame:
    """(x, y) of assembled rows (_x, _label)."""
    return assembled.select(vector_to_array("_x").alias("x"), F.coalesce(F.col("_label").cast("int"), F.lit(255)).alias("y"))
