"""Exact top-n cosine neighbours by ball bounds.

Vectors are gathered round pivots. Of a ball, its centre and its widest angle tell how similar any of its vectors
can be to a query: not nearer than the angle to the centre less the ball's own. A query first looks at the vectors
packed with it, which gives it a similarity that its n-th neighbour reaches at least; after that it is compared with
the balls only whose bound reaches it. Comparisons are products of packed matrices, joined by ball.

Equal vectors are one item: of their names the first n + 1 are kept, which is all that a result can show.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.session import stored

PIVOTS = 1024          # at most; the root of the number of vectors where that is less
PACK = 512             # vectors compared at once
SLACK = 1e-9           # bounds are widened by this against rounding


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    found = np.array(rows, float).reshape(len(rows), -1)
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, norms, out=np.zeros_like(found), where=norms > 0)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def distinct_vectors(queries: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Vectors (vid, vector, is_query, first: the first item name or null) and the item names kept (vid, name)."""
    first = Window.partitionBy("vector").orderBy("name")
    kept = stored(items.select("name", "vector").where("vector is not null").withColumn(
        "rn", F.row_number().over(first)).where(F.col("rn") <= n + 1), "similar_names")
    every = queries.where("vector is not null").select("vector", F.lit(True).alias("is_query"), F.lit(None).cast("string").alias("name"))
    every = every.unionByName(kept.where("rn = 1").select("vector", F.lit(False).alias("is_query"), "name"))
    vectors = stored(every.groupBy("vector").agg(F.max("is_query").alias("is_query"), F.min("name").alias("first"))
                     .withColumn("vid", F.monotonically_increasing_id()), "similar_vectors")
    return vectors, kept.join(vectors.select("vid", "vector"), "vector").select("vid", "name")


def packed_balls(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Packs of vectors of one ball (ball, vids, vectors, firsts, is_query, least), the pivots, and the balls' angles.

    ``least``: for a query vector, a similarity that its n-th neighbour has at least; filled in by ``neighbours``.
    """
    chosen = min(PIVOTS, math.isqrt(vectors.count()) + 1)
    pivots = _matrix(vectors.orderBy(F.xxhash64("vector"), "vid").limit(chosen).select("vector").toArrow().column(0))

    def assign(batches):
        for batch in batches:
            angles = _angles(_matrix(batch.column(1)), pivots)
            ball = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ball.astype(np.int32)), pa.array(angles[np.arange(len(ball)), ball])], ["vid", "ball", "angle"])

    placed = stored(vectors.join(
        vectors.select("vid", "vector").mapInArrow(assign, "vid bigint, ball int, angle double"), "vid"), "similar_balls")
    widest = np.zeros(len(pivots))
    for row in placed.groupBy("ball").agg(F.max("angle").alias("angle")).collect():    # a row per pivot
        widest[row.ball] = row.angle

    def pack(batches):
        held, ball = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["ball"] != ball or len(held) == PACK):
                    yield _pack(ball, held)
                    held = []
                ball = row["ball"]
                held.append(row)
        if held:
            yield _pack(ball, held)

    ordered = placed.repartitionByRange("ball", "angle", "vid").sortWithinPartitions("ball", "angle", "vid")
    packs = ordered.select("ball", "vid", "vector", "first", "is_query").mapInArrow(
        pack, "ball int, vids array<bigint>, vectors array<array<double>>, firsts array<string>, queries array<boolean>")
    return stored(packs, "similar_packs"), pivots, widest


def _pack(ball: int, rows: list[dict]) -> pa.RecordBatch:
    columns = {"ball": ([ball], pa.int32()), "vids": ([[r["vid"] for r in rows]], pa.list_(pa.int64())),
               "vectors": ([[r["vector"] for r in rows]], pa.list_(pa.list_(pa.float64()))),
               "firsts": ([[r["first"] for r in rows]], pa.list_(pa.string())),
               "queries": ([[r["is_query"] for r in rows]], pa.list_(pa.bool_()))}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def asked_balls(packs: DataFrame, pivots: np.ndarray, widest: np.ndarray, n: int) -> DataFrame:
    """asked_ball, vids, vectors: the queries of each pack that must be compared with the items of ``asked_ball``."""
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(pa.array(row["vectors"]))
                asked = np.flatnonzero(row["queries"])
                if not len(asked):
                    continue
                items = np.array([f is not None for f in row["firsts"]])
                near = x[asked] @ x.T
                near[:, ~items] = -np.inf
                near[np.arange(len(asked)), asked] = -np.inf        # other vectors only: each has a name to show
                least = np.sort(near, axis=1)[:, -n] if near.shape[1] >= n else np.full(len(asked), -np.inf)
                bound = np.cos(np.maximum(_angles(x[asked], pivots) - widest - SLACK, 0.0))
                reach = bound + SLACK >= np.maximum(least, 0.0)[:, None]
                for ball in np.flatnonzero(reach.any(axis=0)):
                    mine = asked[reach[:, ball]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(ball)], pa.int32()), pa.array([[row["vids"][i] for i in mine]], pa.list_(pa.int64())),
                         pa.array([[row["vectors"][i] for i in mine]], pa.list_(pa.list_(pa.float64())))],
                        ["ball", "asked", "asked_vectors"])

    return packs.mapInArrow(ask, "ball int, asked array<bigint>, asked_vectors array<array<double>>")


def neighbours(packs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """asked, vid, first, similarity: of every pack compared, the n + 1 best positive ones with their ties."""
    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                similar = _matrix(pa.array(row["asked_vectors"])) @ _matrix(pa.array(row["vectors"])).T
                similar[:, [f is None for f in row["firsts"]]] = -np.inf
                floor = np.sort(similar, axis=1)[:, -min(n + 1, similar.shape[1])]
                q, i = np.nonzero((similar >= floor[:, None] - SLACK) & (similar > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["asked"][k] for k in q], pa.int64()), pa.array([row["vids"][k] for k in i], pa.int64()),
                     pa.array([row["firsts"][k] for k in i], pa.string()), pa.array(similar[q, i])],
                    ["asked", "vid", "first", "similarity"])

    return asked.join(packs, "ball").select("asked", "asked_vectors", "vids", "vectors", "firsts").mapInArrow(
        compare, "asked bigint, vid bigint, first string, similarity double")


def similar(queries: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """query, name, similarity, rank: top-n positive cosines per query; ``queries``/``items``: (name, vector).

    Ties go to the alphabetically first name; a query is not its own neighbour. Null vectors and zero vectors
    have no neighbours.
    """
    vectors, names = distinct_vectors(queries, items, n)
    packs, pivots, widest = packed_balls(vectors)
    found = neighbours(packs, asked_balls(packs, pivots, widest, n), n)
    best = Window.partitionBy("asked").orderBy(F.col("similarity").desc(), "first")
    found = stored(found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= n + 1).drop("rn"), "similar_found")
    shown = queries.join(vectors.select(F.col("vid").alias("asked"), "vector"), "vector").select(
        F.col("name").alias("query"), "asked").join(found, "asked").join(names, "vid")
    rank = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "name")
    return shown.where(F.col("query") != F.col("name")).withColumn("rank", F.row_number().over(rank)).where(
        F.col("rank") <= n).select("query", "name", "similarity", "rank")
