"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. A shingle weighs its frequency in the document times the mean
inverse document frequency of its words; document frequencies are counted over all documents in
``BUCKETS`` counters addressed by word hash, a table of fixed size that is sent to every task.
Weighting by words, not by whole shingles, keeps the weight of a passage the same however many copies
of it there are.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples whose agreement between two texts
has the probability of their weighted Jaccard similarity. Texts that agree on all samples of a band
are candidates; every link is verified by the exact weighted similarity.

Not all pairs of a bucket are compared, yet no link that could join two classes is lost:

1. Texts with the same words are one node. Each bucket compares its members with one of them, picked
   by hash, so a text in many buckets meets many different partners. Verified links form classes.
2. Members of buckets that still hold several classes are joined by prefix filtering, which is exact:
   ordered from rare to frequent shingles, two similar texts share one of the first shingles that make
   up more than 1 - THRESHOLD of a text's weight, and from there on enough weight is left in both.
   The weights of a few bins of shingles bound what two texts can share at all.
   Variants of one text differ in just the rare shingles, so few pairs of different classes meet.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import connected_components
from touchline.llm.registry import query
from touchline.llm.storage import bounded, keep, table
from touchline.llm.words import windows, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
BUCKETS_LOG2 = 16
ORDER_LOG2 = 18             # counters that order shingles by frequency; any order gives right results
BINS_LOG2 = 6               # bins of shingles whose weights bound what two texts share
FULL = 32_767
BEFORE = 4                  # shingles in front of another by which pairs that met before are told
FAN = 256                   # partners that one copy of a text is compared with
BLOCK = 8192                # shingles sampled at once


# ---- weights and samples --------------------------------------------------------------------------

def word_buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + ln((1 + documents) / (1 + documents with a word of the bucket)), per bucket, over all rows."""
    def count(batches):
        total, n_docs = np.zeros(1 << BUCKETS_LOG2, np.int64), 0
        for batch in batches:
            for words in word_hashes([t or "" for t in batch.column(0).to_pylist()]):
                total[np.unique(word_buckets(words))] += 1
                n_docs += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int64()), pa.array([n_docs, *total[used]], pa.int64())],
                                         ["bucket", "n"])

    rows = (docs.select("text").mapInArrow(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())     # at most one row per bucket
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    found = np.zeros(1 << BUCKETS_LOG2)
    found[bucket[bucket >= 0]] = n[bucket >= 0]
    return (1 + np.log((1 + n[bucket < 0].sum()) / (1 + found))).astype(np.float32)


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in ascending order, weights); shorter texts are one shingle."""
    shingles = windows(words, SHINGLE)
    if not len(shingles):
        return shingles, np.zeros(0, np.float32)
    each, n = idf[word_buckets(words)], min(SHINGLE, len(words))
    mean = each[:len(shingles)].copy()
    for i in range(1, n):            # in this order for every text: equal shingles weigh the same to the bit
        mean += each[i:len(shingles) + i]
    distinct, first, times = np.unique(shingles, return_index=True, return_counts=True)
    return distinct, times.astype(np.float32) * mean[first] / np.float32(n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    union = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared
    return shared / union if union else 0.0


@functools.cache
def draws() -> tuple[np.ndarray, ...]:
    """The random numbers of the sampling, drawn once: a shingle and a sample pick an entry by hash."""
    random = np.random.default_rng(20)
    r = random.gamma(2, 1, 1 << 16).astype(np.float32)
    c = np.log(random.gamma(2, 1, 1 << 16)).astype(np.float32)
    beta = random.random(1 << 16).astype(np.float32)
    factors = random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, c - r, beta, factors


def band_keys(shingles: np.ndarray, weights: np.ndarray) -> list[int]:
    """One key per band from the consistent weighted samples (shingle, quantised weight)."""
    r, c_less_r, beta, factors = draws()
    log_weight = np.log(weights)[:, None]
    best = np.full(len(factors), np.inf, np.float32)
    sample = np.zeros(len(factors), np.uint64)
    columns = np.arange(len(factors))
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at:at + BLOCK]
        pick = ((part[:, None] * factors) >> np.uint64(48)).astype(np.int32)
        rate, shift = r[pick], beta[pick]
        level = np.floor(log_weight[at:at + BLOCK] / rate + shift)
        score = c_less_r[pick] - rate * (level - shift)
        row = score.argmin(axis=0)
        better = score[row, columns] < best
        best = np.where(better, score[row, columns], best)
        found = part[row] ^ (level[row, columns].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sample = np.where(better, found, sample)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for samples in sample.reshape(BANDS, ROWS).T:
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (samples + (key >> np.uint64(29)))
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key.view(np.int64).tolist()


def signatures(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """row_no, doc_id, words (digest of the word sequence, null without words), bands."""
    def sign(batches):
        for batch in batches:
            digests, bands = [], []
            for words in word_hashes([t or "" for t in batch.column(2).to_pylist()]):
                digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                bands.append(band_keys(*weighted_shingles(words, idf)) if len(words) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["row_no", "doc_id", "words", "bands"])

    return keep(rows.select("row_no", "doc_id", "text").mapInArrow(
        sign, "row_no bigint, doc_id bigint, words binary, bands array<bigint>"), "signatures")


# ---- verification ---------------------------------------------------------------------------------

def verified(pairs: DataFrame, rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts reach the threshold.

    The texts of pairs stream past a copy of their partner: partitions are sorted by ``a``, whose text
    comes first. A text with many partners gets a copy per ``FAN`` of them, so no task holds more.
    """
    ids = keep(pairs.select(F.col("a").alias("row_no")).union(pairs.select("b")).distinct(), "candidates")
    texts = keep(rows.select("row_no", "text").join(bounded(ids), "row_no", "left_semi"), "candidate-texts")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("copies"))
    heads = (copies.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
             .join(texts, F.col("a") == F.col("row_no")).select("a", "copy", F.lit(None).cast("bigint").alias("b"), "text"))
    partners = (pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")))
                .join(texts, F.col("b") == F.col("row_no")).select("a", "copy", "b", "text"))

    def compare(batches):
        head = None
        for batch in batches:
            found_a, found_b = [], []
            words = word_hashes(batch.column(2).to_pylist())
            for a, b, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words, strict=True):
                vector = weighted_shingles(w, idf)
                if b is None:
                    head = vector
                elif similarity(head, vector) >= threshold:
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return keep(heads.union(partners).repartition("a", "copy").sortWithinPartitions("a", "copy", "b")
                .select("a", "b", "text").mapInArrow(compare, "a bigint, b bigint"), "links")


def ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def prefixes(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """shingle, node, root, weight, rest, bins, before: the rarest shingles of each text (node, root, text), up to more
    than 1 - threshold of its weight; ``rest`` is what a shingle and all later ones weigh, ``bins`` the parts of the
    text's weight, rounded up, whose shingles have the same ``BINS_LOG2`` bits, ``before`` the shingles just before."""
    def slots(shingles: np.ndarray) -> np.ndarray:
        return (shingles >> np.uint64(64 - ORDER_LOG2)).astype(np.int64)

    def count(batches):
        total = np.zeros(1 << ORDER_LOG2, np.int64)
        for batch in batches:
            for words in word_hashes(batch.column(0).to_pylist()):
                total += np.bincount(slots(weighted_shingles(words, idf)[0]), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    found = (texts.select("text").mapInArrow(count, "slot bigint, n bigint")
             .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())      # at most one row per counter
    frequency = np.zeros(1 << ORDER_LOG2, np.int64)
    frequency[found.column("slot").to_numpy()] = found.column("n").to_numpy()

    def rows_of(nodes: np.ndarray, roots: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        parts, sizes, totals, rests, bins, before, lengths = [], [], [], [], [], [], []
        for words in found:
            shingles, weights = weighted_shingles(words, idf)
            order = np.lexsort((shingles, frequency[slots(shingles)]))
            sums = np.cumsum(weights[order], dtype=np.float64)
            n = int(np.searchsorted(sums, (1 - threshold + 1e-4) * sums[-1], "right")) + 1
            part = shingles[order[:n]].view(np.int64)
            of_bin = np.bincount((shingles & np.uint64((1 << BINS_LOG2) - 1)).astype(np.int64), weights, 1 << BINS_LOG2)
            of_bin = np.ceil(of_bin / sums[-1] * (FULL - 1) + 1e-3).clip(0, FULL).astype(np.int16)
            n = len(part)
            parts.append(part)
            sizes.append(n)
            totals.append(np.full(n, sums[-1]))
            rests.append(sums[-1] - sums[:n] + weights[order[:n]])
            bins.append(np.tile(of_bin, n))
            front = np.arange(n)[:, None] + np.arange(-BEFORE, 0)
            before.append(part[front[front >= 0]])
            lengths.append(np.minimum(np.arange(n), BEFORE))
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        every = np.arange(0, (sum(sizes) + 1) << BINS_LOG2, 1 << BINS_LOG2, dtype=np.int32)
        columns = [pa.array(np.concatenate(parts)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(roots, sizes)),
                   pa.array(np.concatenate(totals)), pa.array(np.concatenate(rests)),
                   pa.ListArray.from_arrays(pa.array(every), pa.array(np.concatenate(bins))),
                   pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(before)))]
        return pa.RecordBatch.from_arrays(columns, ["shingle", "node", "root", "weight", "rest", "bins", "before"])

    def rarest(batches):
        for batch in batches:
            nodes, roots, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for i in range(0, len(held), 64):
                yield rows_of(nodes[i:i + 64], roots[i:i + 64], word_hashes(held[i:i + 64]))

    return texts.select("node", "root", "text").mapInArrow(
        rarest, "shingle bigint, node bigint, root bigint, weight double, rest double, bins array<smallint>, before array<bigint>")


def text_links(nodes: DataFrame, rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """node, root for every text (row_no, bands) that is similar to another."""
    spread = nodes.select(F.col("row_no").alias("node"), F.explode("bands").alias("key"))
    buckets = (spread.groupBy("key")
               .agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("pivot"))
               .where("n > 1"))
    members = keep(spread.join(buckets, "key").select("key", "node", "pivot"), "members")
    tried = keep(members.where("node != pivot").select(*ordered("node", "pivot")).distinct(), "pairs")
    links = verified(tried, rows, idf, threshold)

    classes = connected_components(links)
    placed = keep(members.join(classes, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    several = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    undecided = keep(placed.join(several.select("key"), "key", "left_semi").select("node", "root").distinct(), "open")
    texts = keep(rows.select(F.col("row_no").alias("node"), "text").join(bounded(undecided), "node"), "open-texts")
    first = keep(prefixes(texts, idf, threshold), "prefixes")
    other = first.toDF(*[f"x_{c}" for c in first.columns])
    # The first shared shingle and what follows must weigh what the similarity needs, in both texts.
    needed = (F.col("weight") + F.col("x_weight")) * (threshold / (1 + threshold) - 1e-4)
    # So must what both have in bins of shingles, where unlike shingles of a bin count as shared.
    both = F.zip_with("bins", "x_bins", lambda a, b: F.least(a * F.col("weight"), b * F.col("x_weight")))
    # Texts that share one of the shingles in front have met on it.
    met = F.arrays_overlap("before", "x_before")
    meet = ((F.col("shingle") == F.col("x_shingle")) & (F.col("x_node") < F.col("node")) & (F.col("x_root") != F.col("root"))
            & (F.least("rest", "x_rest") >= needed) & ~met & (F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / FULL >= needed))
    untried = (first.join(other, meet).withColumnRenamed("x_node", "x").select(*ordered("x", "node")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = verified(keep(untried, "pairs"), rows, idf, threshold)
    return connected_components(links.union(more))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: row_no, doc_id, class_id, class_size, kept.

    ``docs`` holds row_no (unique, the same on every read), doc_id and text. Classes are the connected
    components of links of at least ``threshold``; texts with the same words are linked. The row with
    the smallest doc_id stays and names its class; null ids come last, then row_no decides. A text
    without words (null, empty, only signs) resembles nothing and stays.
    """
    idf = inverse_frequencies(docs)
    signed = signatures(docs, idf)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("row_no").alias("row_no"))
    nodes = (signed.where("words is not null").groupBy("words")
             .agg(F.min_by(F.struct("row_no", "bands"), place).alias("first")).select("words", "first.*"))
    nodes = keep(nodes.withColumnRenamed("row_no", "node"), "nodes")
    roots = text_links(nodes.select(F.col("node").alias("row_no"), "bands"), docs, idf, threshold)

    named = nodes.select("words", "node").join(roots, "node", "left").select("words", F.coalesce("root", "node").alias("class"))
    placed = keep(signed.select("row_no", "doc_id", "words").join(named, "words", "left")
                  .select("row_no", "doc_id", F.coalesce("class", "row_no").alias("class")), "classes")
    best = placed.groupBy("class").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(best, "class").select(
        "row_no", "doc_id", F.col("best.id").alias("class_id"), "class_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"))


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    return near_groups(rows).select("doc_id", "class_id", "class_size", "kept")
