"""Language identification with a bit-sliced Bloom filter of character n-grams.

Each slot of the filter holds one bit per language. The slots of an n-gram, combined with AND, give
the set of all languages that contain it (up to false positives). A text's n-grams are looked up at
once; per language the set bits are counted and corrected for the chance that an n-gram of no
language hits by accident: with hits h of n and the chance p, (h - n p) / (1 - p) are real. The
language with the most real hits is predicted.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import table

GRAM = 4               # code points of an n-gram; all but letters count as one gap character
SLOTS_LOG2 = 20
HASHES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FIT_ROWS = 2_000       # expected labelled rows learned from per language; all where there are fewer
MIN_SHARE = 0.01       # of a language's learned texts that must hold an n-gram
UNKNOWN = "und"
SLICE = 500_000        # characters looked up at once


@functools.cache
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(sys.maxunicode + 1)])


def grams(text: str) -> np.ndarray:
    """Hash of every n-gram of a text with at least GRAM - 1 letters, repeats included."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    codes = np.where(is_letter, points, 32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    key, count = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for i in range(GRAM):
        key = key * np.uint64(0x100000001B3) + codes[i:n + i]
        count += is_letter[i:n + i]
    return key[count >= GRAM - 1]


def sliced(text: str):
    """Overlapping slices that hold every n-gram once."""
    for start in range(0, max(1, len(text) - GRAM + 1), SLICE):
        yield text[start:start + SLICE + GRAM - 1]


@dataclass
class Model:
    languages: list[str]
    shares: np.ndarray            # of the labelled rows, per language: decides where nothing is known
    slots: list[np.ndarray]       # one array per 64 languages

    def __post_init__(self):
        self.false = np.array([
            np.mean((self.slots[i // 64] >> np.uint64(i % 64)).astype(np.uint64) & np.uint64(1)) ** len(HASHES)
            for i in range(len(self.languages))])

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its filter contains."""
        out = np.zeros(len(self.languages))
        places = [(keys * np.uint64(f)) >> np.uint64(64 - SLOTS_LOG2) for f in HASHES]
        for block, slots in enumerate(self.slots):
            found = slots[places[0]]
            for place in places[1:]:
                found &= slots[place]
            for i in range(64 * block, min(64 * block + 64, len(self.languages))):
                out[i] = np.count_nonzero(found & slots.dtype.type(1 << (i % 64)))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for part in sliced(text):
            keys = grams(part)
            hits += self.hits(keys)
            n += len(keys)
        real = np.clip((hits - n * self.false) / np.maximum(1 - self.false, 1e-9), 0, None)
        best = max(range(len(real)), key=lambda i: (real[i], self.shares[i], self.languages[i]))
        return self.languages[best], float(min(1.0, real[best] / n)) if n else 0.0


def in_training(id_column: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, min_share: float = MIN_SHARE) -> Model:
    """Learns from ``text`` and non-null ``lang`` of about ``fit_rows`` rows per language.

    Rows are chosen by a hash of their id, so the choice depends on neither order nor partitioning.
    A table without labelled rows gives a model that answers ``UNKNOWN``.
    """
    spark = docs.sparkSession
    usable = docs.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}   # one row per label
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0), [])
    share = spark.createDataFrame([(lang, fit_rows / n) for lang, n in totals.items()], "lang string, share double")
    place = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    chosen = usable.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(place < F.col("share"))

    def count(batches):
        seen: dict[str, dict[int, int]] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [np.unique(grams(part)) for part in sliced(text)]
                docs_of[lang] = docs_of.get(lang, 0) + 1
                mine = seen.setdefault(lang, {})
                for key in np.unique(np.concatenate(found)).tolist():
                    mine[key] = mine.get(key, 0) + 1
        for lang, mine in seen.items():
            keys = np.fromiter(mine, np.uint64, len(mine)).view(np.int64)
            n = np.fromiter(mine.values(), np.int64, len(mine))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.int64()), pa.array([docs_of[lang]])],
                                             ["lang", "gram", "n"])

    counted = (chosen.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = counted.where(F.col("gram").isNull()).select("lang", F.col("n").alias("size"))
    kept = (counted.where(F.col("gram").isNotNull()).join(F.broadcast(sizes), "lang")
            .where(F.col("n") >= F.col("size") * min_share).select("lang", "gram").toArrow())

    slots = [np.zeros(1 << SLOTS_LOG2, np.uint8 if len(languages) <= 8 else np.uint64)
             for _ in range(0, len(languages), 64)]
    learned = np.array(kept.column("lang").to_pylist(), object)
    keys = kept.column("gram").to_numpy().view(np.uint64)
    for i, lang in enumerate(languages):
        mine = keys[learned == lang]
        for factor in HASHES:
            at = (mine * np.uint64(factor)) >> np.uint64(64 - SLOTS_LOG2)
            slots[i // 64][at] |= slots[0].dtype.type(1 << (i % 64))
    shares = np.array([totals[lang] for lang in languages], float)
    return Model(languages, shares / shares.sum(), slots)


def identified(docs: DataFrame, model: Model, text_column: str = "text") -> Column:
    """Column struct<lang_pred, score>: the predicted language and the share of the text's n-grams that
    it contains, corrected. A text that is null or without letters is ``und`` with score 0."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(docs[text_column])


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", identified(docs, fit(docs)).alias("found"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")
