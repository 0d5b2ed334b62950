"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few shares and lengths. Boosting goes round the features in turn; each turn adds one shallow
tree on a single feature to that feature's lookup table, so that no feature crowds out another. Pairs of features
are then ranked by what a shallow tree on both would still gain, and the best get tables of two dimensions in the
same way. Several bags of rows are fitted side by side and their tables averaged. A text's score is the sum
of one table entry per feature and pair, for whole batches at once.
"""

from __future__ import annotations

import functools
import itertools
import operator
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import keep, prepare, table

FIT_ROWS = 20_000       # expected labelled rows learned from per label; all where there are fewer
BINS = 32               # of a feature
PAIR_BINS = 8           # of a feature within a pair
PAIRS = 8
BAGS = 6
ROUNDS = 400
RATE = 0.1
DEPTH = 2
RIDGE = 0.1
LEAST_WEIGHT = 0.1      # hessian that a leaf needs
PATIENCE = 50           # rounds without gain on the rows a bag leaves out
THRESHOLD = 0.3
SLICE = 1_000_000       # characters looked at once

FEATURES = (
    "log_chars", "spaces", "letters", "capitals", "digits", "punctuation", "symbols", "spread",
    "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "plain_words",
    "open_words", "words_per_line", "repeated_lines", "closed_lines",
)
KINDS = {"Lu": 1, "Lt": 1, "L": 2, "M": 2, "N": 3, "P": 4, "S": 5, "Z": 6}   # 0: everything else
CLOSERS = tuple(".!?:;\"')]}»”")


# --- features of a text ---------------------------------------------------------------------------

@functools.cache
def kinds() -> np.ndarray:
    """Kind of every code point."""
    def kind(point: int) -> int:
        char = chr(point)
        category = unicodedata.category(char)
        return 6 if char.isspace() else KINDS.get(category, KINDS.get(category[0], 0))

    return np.array([kind(p) for p in range(sys.maxunicode + 1)], np.uint8)


def slices(text: str) -> Iterator[str]:
    """A text in parts that end at white space."""
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null counts as empty, which has 0 throughout."""
    if not text:
        return [0.0] * len(FEATURES)
    of_kind, points = np.zeros(7), np.zeros(1024)
    words: Counter[str] = Counter()
    n_words = repeats = longest = 0
    last = ""
    for part in slices(text):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        of_kind += np.bincount(kinds()[codes], minlength=7)
        points += np.bincount(codes & 1023, minlength=1024)
        found = part.lower().split()
        if found:
            repeats += sum(map(operator.eq, found, itertools.chain([last], found)))
            longest = max(longest, max(map(len, found)))
            last = found[-1]
        words.update(found)
        n_words += len(found)
    lines = Counter(x for x in map(str.strip, text.split("\n")) if x)
    n_lines = sum(lines.values())
    chars = len(text)
    ink = max(1.0, chars - of_kind[6])
    letters = of_kind[1] + of_kind[2]
    share = points[points > 0] / chars
    each = max(1, n_words)
    return [
        np.log1p(chars), of_kind[6] / chars, letters / ink, of_kind[1] / max(1.0, letters),
        of_kind[3] / ink, of_kind[4] / ink, of_kind[5] / ink, float(-(share * np.log2(share)).sum()),
        np.log1p(n_words), sum(len(w) * n for w, n in words.items()) / each, np.log1p(longest),
        len(words) / each, max(words.values(), default=0) / each, repeats / each,
        sum(n for w, n in words.items() if w.isalpha()) / each,
        sum(n for w, n in words.items() if not w[-1].isalnum()) / each,
        np.log1p(n_words / max(1, n_lines)), 1 - len(lines) / max(1, n_lines),
        sum(n for x, n in lines.items() if x.endswith(CLOSERS)) / max(1, n_lines),
    ]


# --- boosted tables -------------------------------------------------------------------------------

def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain, axis and place of the best cut of a histogram of one or two dimensions."""
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    best = (0.0, 0, 0)
    for axis in range(g.ndim):
        others = tuple(a for a in range(g.ndim) if a != axis)
        g_left, h_left = np.cumsum(g.sum(axis=others))[:-1], np.cumsum(h.sum(axis=others))[:-1]
        g_right, h_right = g.sum() - g_left, h.sum() - h_left
        gain = g_left ** 2 / (h_left + RIDGE) + g_right ** 2 / (h_right + RIDGE) - whole
        gain[(h_left < LEAST_WEIGHT) | (h_right < LEAST_WEIGHT)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), axis, int(gain.argmax()) + 1)
    return best


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, float]:
    """Values of the bins under a tree grown on their gradients and hessians, and its gain."""
    gain, axis, cut = best_cut(g, h) if depth else (0.0, 0, 0)
    if gain <= 0:
        return np.full(g.shape, g.sum() / (h.sum() + RIDGE)), 0.0
    parts = [np.s_[:cut], np.s_[cut:]]
    out = np.empty(g.shape)
    for part in parts:
        at = (part,) if axis == 0 else (slice(None), part)
        out[at], more = shallow_tree(g[at], h[at], depth - 1)
        gain += more
    return out, gain


def histogram(bins: np.ndarray, values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return np.bincount(bins, values, int(np.prod(shape))).reshape(shape)


def boosted(terms: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, weight: np.ndarray,
            learn: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Tables of the terms (flat bin number of every row), boosted in turn on the rows of ``learn`` from the log odds
    ``start``. Stops when the rows left out no longer gain, and returns the tables of the best round."""
    tables = [np.zeros(s) for s in shapes]
    mine, z = [t[learn] for t in terms], start[learn].astype(float)
    rest, z_rest = [t[~learn] for t in terms], start[~learn].astype(float)
    y_mine, w_mine, y_rest, w_rest = y[learn], weight[learn], y[~learn], weight[~learn]

    def loss() -> float:
        p = np.clip(sigmoid(z_rest), 1e-9, 1 - 1e-9)
        return float(-(w_rest * (y_rest * np.log(p) + (1 - y_rest) * np.log(1 - p))).sum())

    best, kept, waited = loss(), [t.copy() for t in tables], 0
    for _ in range(rounds):
        for i, (bins, shape) in enumerate(zip(mine, shapes, strict=True)):
            p = sigmoid(z)
            step, _ = shallow_tree(histogram(bins, w_mine * (y_mine - p), shape), histogram(bins, w_mine * p * (1 - p), shape))
            step *= RATE
            tables[i] += step
            z += step.ravel()[bins]
            z_rest += step.ravel()[rest[i]]
        now = loss()
        if now < best or not len(y_rest):
            best, kept, waited = now, [t.copy() for t in tables], 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    return kept


@dataclass
class Model:
    borders: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    singles: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, rows[:, i], side="right") for i, b in enumerate(self.borders)], axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.intercept)
        if self.borders and len(rows):
            bins = self.bins(rows)
            for i, values in enumerate(self.singles):
                z += values[bins[:, i]]
            for i, j, values in self.pairs:
                z += values[coarse(bins[:, i], len(self.singles[i])), coarse(bins[:, j], len(self.singles[j]))]
        return sigmoid(z)


def coarse(bins: np.ndarray, size: int) -> np.ndarray:
    return bins * PAIR_BINS // size


def borders_of(column: np.ndarray) -> np.ndarray:
    """Borders between at most ``BINS`` bins of about equal rows, half-way between neighbours; equal values share a bin."""
    values = np.sort(column)
    at = np.arange(1, BINS) * len(values) // BINS
    return np.unique(((values[at - 1] + values[at]) / 2)[(at > 0) & (values[at] > values[0])])


def tables_by_bag(spark, bags: int, fit_bag, names: str = "bag bigint, term int, strength double, bins binary") -> list:
    """Runs ``fit_bag(bag)`` for each bag in a task of its own; it yields (term, strength, table)."""
    def run(batches):
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                for term, strength, values in fit_bag(bag):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bag], pa.int64()), pa.array([term], pa.int32()), pa.array([strength], pa.float64()),
                         pa.array([values.astype("<f8").tobytes()], pa.binary())], ["bag", "term", "strength", "bins"])

    return spark.range(0, bags, 1, bags).mapInArrow(run, names).orderBy("term", "bag").collect()   # tables only


def average(found: list, term: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.mean([np.frombuffer(r.bins, "<f8").reshape(shape) for r in found if r.term == term], axis=0)


def fitted(spark, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, bags: int = BAGS, n_pairs: int = PAIRS) -> Model:
    """The model of a bounded sample; rows in a fixed order give the same model on any cluster."""
    if not len(y):
        return Model()
    weight = weight / weight.mean()
    positive = (weight @ y + 1) / (weight.sum() + 2)
    model = Model([borders_of(c) for c in rows.T], float(np.log(positive / (1 - positive))))
    bins = model.bins(rows).astype(np.uint8)
    sizes = [len(b) + 1 for b in model.borders]
    start = np.full(len(y), model.intercept)
    candidates = list(itertools.combinations(range(len(sizes)), 2))

    def left_out(bag: int) -> np.ndarray:
        return np.random.default_rng(bag).random(len(y)) < 1 / max(2, bags)

    def pair_bins(pair: tuple[int, int]) -> np.ndarray:
        i, j = pair
        return coarse(bins[:, i].astype(np.int64), sizes[i]) * PAIR_BINS + coarse(bins[:, j].astype(np.int64), sizes[j])

    def fit_singles(bag: int):
        learn = ~left_out(bag)
        found = boosted([bins[:, i].astype(np.int64) for i in range(len(sizes))], [(s,) for s in sizes], y, weight, learn, start)
        z = start + sum(t[bins[:, i]] for i, t in enumerate(found))
        for i, values in enumerate(found):
            yield i, 0.0, values
        p = sigmoid(z)
        g, h = weight * (y - p), weight * p * (1 - p)
        for k, pair in enumerate(candidates):
            flat, shape = pair_bins(pair)[learn], (PAIR_BINS, PAIR_BINS)
            yield len(sizes) + k, shallow_tree(histogram(flat, g[learn], shape), histogram(flat, h[learn], shape))[1], np.zeros(0)

    found = tables_by_bag(spark, bags, fit_singles)
    model.singles = [average(found, i, (s,)) for i, s in enumerate(sizes)]
    strength = Counter()
    for r in found:
        if r.term >= len(sizes):
            strength[candidates[r.term - len(sizes)]] += r.strength
    chosen = sorted(candidates, key=lambda c: (-strength[c], c))[:n_pairs]
    after = start + sum(t[bins[:, i]] for i, t in enumerate(model.singles))

    def fit_pairs(bag: int):
        found = boosted([pair_bins(c) for c in chosen], [(PAIR_BINS, PAIR_BINS)] * len(chosen), y, weight, ~left_out(bag), after)
        for k, values in enumerate(found):
            yield k, 0.0, values

    found = tables_by_bag(spark, bags, fit_pairs) if chosen else []
    model.pairs = [(*c, average(found, k, (PAIR_BINS, PAIR_BINS))) for k, c in enumerate(chosen)]
    return model


# --- on tables ------------------------------------------------------------------------------------

def held_out(id_column: Column) -> Column:
    """Rows never learned from: 5 divides the crc32 of the id as text. A null id is not held out, but has no label."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
        text_column: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the texts of about ``fit_rows`` labelled rows per label, chosen by a hash of their id.

    Rows that ``held_out`` names are left out. Null labels and null ids are left out, repeated labels count once, and of
    rows that repeat an id one is learned from. Labels other than 1 count as 0. Without labelled rows
    every text scores 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_column).alias("id"), (F.col(label_column) == 1).alias("good")).where(
        "id is not null and good is not null").where(~held_out(F.col("id"))).distinct()
    totals = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}       # two rows at most
    share = F.when(F.col("good"), min(1.0, fit_rows / totals.get(True, 1))).otherwise(min(1.0, fit_rows / totals.get(False, 1)))
    placed = F.pmod(F.xxhash64("id", "good"), F.lit(1_000_003)) / 1_000_003
    chosen = known.withColumn("share", share).where(placed < F.col("share"))                # about 2 * fit_rows ids

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(features(t), float) for t in texts])

    rows = (docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "good", "share", measured("text").alias("x"))
            .groupBy("id", "good").agg(F.max("x").alias("x"), F.max("share").alias("share")))
    found = keep(rows, "quality-rows").orderBy("id", "good").toArrow()
    if not found.num_rows:
        return Model()
    matrix = found.column("x").combine_chunks().flatten().to_numpy().reshape(found.num_rows, len(FEATURES))
    y = found.column("good").to_numpy().astype(float)
    return fitted(spark, matrix, y, 1 / found.column("share").to_numpy())


def scored(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> Column:
    """Column struct<score, predicted>: chance of label 1 by the whole text, and whether it reaches ``threshold``. A null
    text counts as empty; empty texts are scored by the same tables."""
    @F.pandas_udf("score double, predicted int")
    def score(texts: pd.Series) -> pd.DataFrame:
        found = model.scores(np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES)))
        return pd.DataFrame({"score": found, "predicted": (found >= threshold).astype("int32")})

    return score(docs[text_column])


@query("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, model).alias("found")).select(
        "doc_id", "held_out", "found.score", "found.predicted")
