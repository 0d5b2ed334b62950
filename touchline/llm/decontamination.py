"""Benchmark decontamination by latent semantic retrieval.

1. Passages. Benchmark items are cut into passages of up to ``PASSAGE`` words; documents are read in
   windows of three blocks of ``STEP`` words, one block apart, so every passage lies inside a window.
2. Latent space. The TF-IDF rows of all benchmark passages, and of all passages of all documents as
   background, span a matrix whose leading right singular vectors are found by a distributed randomised
   SVD: tasks multiply their rows, partial products are summed by feature, and only features x rank
   numbers, a fixed size, reach the driver. Features are word hash buckets and document frequencies come
   from all documents.
3. Candidates. Every window of every document is projected and compared by cosine with a block of at
   most ``QUERY_BLOCK`` benchmark passages; a larger benchmark takes more passes over the documents.
   A window whose part along the passage is far shorter than the passage itself can't hold it.
   Passages of up to ``STEP`` words are compared with windows of two blocks, by a cosine scaled to their
   length. Beside this, every passage is looked up word for word by hashes of word runs of its length.
4. Checks. A candidate counts if the longest common subsequence of words covers ``COPY_SHARE`` of the
   passage, or, as a paraphrase, ``PARAPHRASE_SHARE`` of it while the item's answer follows word for
   word. Passages under ``SHORT`` words must occur word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.near_dedup import BUCKETS_LOG2, inverse_frequencies, word_buckets
from touchline.llm.registry import query
from touchline.llm.storage import keep, table
from touchline.llm.words import word_hashes
from touchline.session import spread

STEP = 20
PASSAGE = 2 * STEP
SPAN = 3                     # blocks of a window
FEATURES_LOG2 = 15
RANK, OVERSAMPLE = 128, 8
BACKGROUND = 0.25            # weight of document passages in the matrix, as if these were
BACKGROUND_ROWS = 2_000      # so many or
BACKGROUND_SHARE = 0.02      # this part of the documents, if that is more
QUERY_BLOCK = 4_096
COSINE = 0.35                # least cosine of a candidate
CONTAINED = 0.4              # least length along the passage, as part of the passage's own
COMMON, FLOOR = 0.05, 0.2    # words in more than this share of documents weigh only the floor
COPY_SHARE, PARAPHRASE_SHARE = 0.8, 0.6
SHORT = 8
SHORT_SPAN = 2               # blocks of a window for passages of up to STEP words
RUN_BITS = 20                # size of the filter before the lookup of word runs
RUN_BASE = np.uint64(0x9E3779B97F4A7C15)
ROWS_AT_ONCE = 512           # passages multiplied, and 8 times as many blocks projected, at once
FOLDED = 1 << 19             # words of passages that are multiplied at once
FEATURE_PIECE = 32           # rows of a feature in one product
PIECES = 128                 # pieces whose rows are looked up at once
PARTS_A_TASK = 4             # partitions of the passages that one task sums up: its sums are all features x rank


# ---- latent space ---------------------------------------------------------------------------------

def features_of(buckets: np.ndarray) -> np.ndarray:
    return buckets >> (BUCKETS_LOG2 - FEATURES_LOG2)


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by word bucket, counted over all documents; common words hardly weigh."""
    return np.maximum(inverse_frequencies(docs) - np.float32(1 - np.log(COMMON)), 0) + np.float32(FLOOR)


def row_block(buckets: np.ndarray, row: np.ndarray, weights: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, feature, value) of the TF-IDF rows of unit length times their weight, in order; ``row``: of each word."""
    at, inverse = np.unique(row << FEATURES_LOG2 | features_of(buckets), return_inverse=True)
    values = np.bincount(inverse, idf[buckets], len(at))
    row, feature = at >> FEATURES_LOG2, at & (1 << FEATURES_LOG2) - 1
    norm = np.sqrt(np.bincount(row, values * values, len(weights)))
    return row, feature, (values / np.where(norm, norm, 1)[row] * weights[row]).astype(np.float32)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def random_start(rank: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((1 << FEATURES_LOG2, rank))


def run_sums(rows: np.ndarray, chosen: np.ndarray, values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The sum of ``values`` x chosen ``rows`` for each run of them, multiplied in pieces of ``width``."""
    sizes = np.diff(np.append(starts, len(chosen)))
    pieces = -(-sizes // width)
    first, n = np.cumsum(pieces) - pieces, int(pieces.sum())
    at = np.arange(len(chosen)) + np.repeat(first * width - starts, sizes)
    padded, factors = np.zeros(n * width, np.int64), np.zeros((n, 1, width), np.float32)
    padded[at], factors.reshape(-1)[at] = chosen, values
    out, taken = np.empty((n, rows.shape[1]), np.float32), np.empty((PIECES * width, rows.shape[1]), np.float32)
    for i in range(0, n, PIECES):
        j = min(n, i + PIECES)
        part = np.take(rows, padded[i * width:j * width], axis=0, out=taken[:(j - i) * width], mode="clip")
        np.matmul(factors[i:j], part.reshape(j - i, width, -1), out=out[i:j, None])
    sums, more = out[first], np.flatnonzero(pieces > 1)
    if len(more):       # pieces of the runs that have several, one after the other
        several = np.repeat(pieces > 1, pieces)
        sums[more] = np.add.reduceat(out[several], np.cumsum(pieces[more]) - pieces[more], axis=0)
    return sums


def row_blocks(batches, idf: np.ndarray):
    """The number of rows and ``row_block`` of about ``FOLDED`` words at a time."""
    def block(packed, weights):
        sizes = [len(p) // 2 for p in packed]
        buckets = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
        return len(packed), *row_block(buckets, np.repeat(np.arange(len(packed)), sizes), np.array(weights), idf)

    packed, weights, size = [], [], 0
    for batch in batches:
        packed += batch.column(0).to_pylist()
        weights += batch.column(1).to_pylist()
        size += sum(map(len, packed[-batch.num_rows:])) // 2 if batch.num_rows else 0
        if size >= FOLDED:
            yield block(packed, weights)
            packed, weights, size = [], [], 0
    if size:
        yield block(packed, weights)


def along_basis(n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A block's ``n`` rows x basis."""
    starts = run_starts(row)
    along = np.zeros((n, basis.shape[1]), np.float32)
    along[row[starts]] = run_sums(basis, feature, value, starts, PASSAGE)
    return along


def summed(matrix: DataFrame, multiply, height: int, width: int) -> np.ndarray:
    """The sum of the tables (height x width) that ``multiply`` gives for the batches of each task, added up by row."""
    schema = "feature bigint, sums binary"

    def partial(batches):
        total = multiply(batches)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([total[f].tobytes() for f in used], pa.binary())], ["feature", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, np.float32)
                total[f] = total[f] + values if f in total else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["feature", "sums"])

    found = matrix.mapInArrow(partial, schema).repartition("feature").mapInArrow(add, schema).toArrow()
    out = np.zeros((height, width))
    for f, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[f] = np.frombuffer(raw, np.float32)
    return out


def gram_product(matrix: DataFrame, idf: np.ndarray, rank: int, found_basis: np.ndarray | None) -> np.ndarray:
    """(transposed matrix x matrix) x basis, summed over the tasks by feature. Without a basis yet, every task
    draws the same random one."""
    def multiply(batches):
        basis = (random_start(rank) if found_basis is None else found_basis).astype(np.float32)
        total = np.zeros(basis.shape, np.float32)
        for n, row, feature, value in row_blocks(batches, idf):
            along = along_basis(n, row, feature, value, basis)
            order = np.argsort(feature.astype(np.uint16), kind="stable")
            starts = run_starts(feature[order])
            total[feature[order][starts]] += run_sums(along, row[order], value[order], starts, FEATURE_PIECE)
        return total

    return summed(matrix, multiply, 1 << FEATURES_LOG2, rank)


def projected_gram(matrix: DataFrame, idf: np.ndarray, found_basis: np.ndarray) -> np.ndarray:
    """Transposed basis x (transposed matrix x matrix) x basis: the products of the projected rows, rank x rank a task."""
    rank = found_basis.shape[1]

    def multiply(batches):
        basis = found_basis.astype(np.float32)
        total = np.zeros((rank, rank))
        for block in row_blocks(batches, idf):
            along = along_basis(*block, basis)
            total += along.T @ along
        return total.astype(np.float32)

    return summed(matrix, multiply, rank, rank)


def latent_basis(matrix: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (features x rank) by a randomised range finder with one power step."""
    wide, q = rank + OVERSAMPLE, None
    for _ in range(2):
        q = np.linalg.qr(gram_product(matrix, idf, wide, q))[0].astype(np.float16)   # halves what tasks are sent
    small = projected_gram(matrix, idf, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q.astype(np.float32) @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def lifted_basis(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row per word bucket: the basis row of its feature times its weight."""
    return basis[features_of(np.arange(1 << BUCKETS_LOG2))].astype(np.float32) * idf[:, None]


# ---- passages -------------------------------------------------------------------------------------

def passage_starts(n: int) -> list[int]:
    """Starts of the passages of an item of ``n`` words; the last one ends with the item."""
    if n <= PASSAGE:
        return [0]
    return [*range(0, n - PASSAGE, STEP), n - PASSAGE]


def benchmark_passages(benchmark: DataFrame) -> DataFrame:
    """item_id, words, answer (both word hashes) per passage; items without words have none.

    Without an ``answer`` column the last five words of an item stand for its answer.
    """
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")

    def cut(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            answers = [t or "" for t in batch.column(2).to_pylist()]
            rows = []
            for item, words, reply in zip(batch.column(0).to_pylist(), word_hashes(texts), word_hashes(answers), strict=True):
                words = words.view(np.int64)
                reply = reply.view(np.int64) if len(reply) else words[-5:]
                if len(words):
                    rows += [(item, words[s:s + PASSAGE].tolist(), reply.tolist()) for s in passage_starts(len(words))]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])],
                ["item_id", "words", "answer"])

    return keep(benchmark.select("item_id", "text", answer.alias("answer"))
                .mapInArrow(cut, "item_id bigint, words array<bigint>, answer array<bigint>"), "passages")


def packed_buckets(passages: list[np.ndarray]) -> pa.Array:
    """The word buckets of each passage, two bytes each."""
    return pa.array([word_buckets(p).astype("<u2").tobytes() for p in passages], pa.binary())


def fitted_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """buckets and weight of all benchmark passages and of all passages, one after the other, of all documents.

    However many passages the documents have, together they weigh as much as a few of weight ``BACKGROUND``.
    """
    def known(batches):
        for batch in batches:
            words = [np.array(w, np.int64).view(np.uint64) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([packed_buckets(words)], ["buckets"])

    def cut(batches):
        for batch in batches:
            found = word_hashes([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [packed_buckets([w[s:s + PASSAGE] for w in found for s in range(0, len(w), PASSAGE)])], ["buckets"])

    background = keep(docs.select("text").mapInArrow(cut, "buckets binary"), "background")
    expected = max(BACKGROUND_ROWS, BACKGROUND_SHARE * docs.count())
    weight = BACKGROUND * min(1.0, expected / max(1, background.count())) ** 0.5
    mine = passages.select("words").mapInArrow(known, "buckets binary").select("buckets", F.lit(1.0).alias("weight"))
    return gathered(mine.union(spread(background).select("buckets", F.lit(weight))))


def gathered(matrix: DataFrame) -> DataFrame:
    """The same rows in fewer partitions, a core each at least: every one adds features x rank sums to a shuffle."""
    cores = matrix.sparkSession.sparkContext.defaultParallelism
    return matrix.coalesce(max(cores, matrix.rdd.getNumPartitions() // PARTS_A_TASK))


# ---- search ---------------------------------------------------------------------------------------

@dataclass
class Queries:
    items: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    unit: np.ndarray             # latent vectors of unit length
    norm: np.ndarray
    masks: list[dict[int, int]]  # per passage, a bit mask of the places of each word
    spans: list[tuple[int, np.ndarray, np.ndarray]]  # blocks of a window, passages compared with it, their least cosines
    runs: dict[int, dict[int, list[int]]]            # words of a passage, its hash -> passages
    run_filter: np.ndarray                           # by the hash's highest bits


def latent(words: np.ndarray, lifted: np.ndarray) -> np.ndarray:
    """Latent vectors of consecutive blocks of ``STEP`` words. ``lifted``: basis rows times their weights."""
    rows = lifted[word_buckets(words)]
    whole = len(rows) // STEP * STEP
    sums = rows[:whole].reshape(-1, STEP, rows.shape[1]).sum(axis=1)
    return np.concatenate([sums, rows[whole:].sum(axis=0, keepdims=True)]) if whole < len(rows) else sums


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; vanishing ones as infinite, so that nothing resembles them."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.where(norm > 1e-6, norm, np.inf).astype(np.float32)


def prepared(rows, lifted: np.ndarray) -> Queries:
    words = [r["words"] for r in rows]
    masks = []
    for passage in words:
        mask: dict[int, int] = {}
        for i, w in enumerate(passage):
            mask[w] = mask.get(w, 0) | 1 << i
        masks.append(mask)
    vectors = np.stack([lifted[word_buckets(np.array(w, np.int64).view(np.uint64))].sum(axis=0) for w in words])
    norm = lengths_of(vectors)
    runs: dict[int, dict[int, list[int]]] = {}
    run_filter = np.zeros(1 << RUN_BITS, bool)
    for q, passage in enumerate(words):
        h = run_hash(passage)
        runs.setdefault(len(passage), {}).setdefault(h, []).append(q)
        run_filter[h >> 64 - RUN_BITS] = True
    sizes = np.array([len(w) for w in words])
    long, short = np.flatnonzero(sizes > STEP), np.flatnonzero((sizes <= STEP) & (sizes >= SHORT))
    spans = [(SPAN, long, np.full(len(long), COSINE, np.float32)),
             (SHORT_SPAN, short, (COSINE * np.sqrt(sizes[short] / STEP)).astype(np.float32))]
    return Queries([r["item_id"] for r in rows], words, [r["answer"] for r in rows], vectors / norm[:, None], norm, masks,
                   [x for x in spans if len(x[1])], runs, run_filter)


def run_hash(words: list[int]) -> int:
    h = 0
    for w in words:
        h = (h * int(RUN_BASE) + w) % (1 << 64)
    return h


def exact_matches(docs: list[np.ndarray], queries: Queries) -> list[dict[int, int]]:
    """Per document, passage -> first place where it stands word for word."""
    found: list[dict[int, int]] = [{} for _ in docs]
    ends = np.cumsum([len(d) for d in docs])
    if not len(ends) or not ends[-1]:
        return found
    words = np.concatenate(docs)
    h = np.zeros(len(words), np.uint64)
    for n in range(1, min(max(queries.runs), len(words)) + 1):
        h = h[:len(words) - n + 1] * RUN_BASE + words[n - 1:]
        if n not in queries.runs:
            continue
        at = np.flatnonzero(queries.run_filter[h >> np.uint64(64 - RUN_BITS)])
        at = at[np.isin(h[at], np.fromiter(queries.runs[n], np.uint64))]
        doc = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[doc]
        at, doc = at[inside], doc[inside]
        order = np.lexsort((at, h[at], doc))
        at, doc = at[order], doc[order]
        first = np.ones(len(at), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (h[at[1:]] != h[at[:-1]])
        for place, d in zip(at[first].tolist(), doc[first].tolist(), strict=True):
            run = words[place:place + n].view(np.int64).tolist()
            for q in queries.runs[n][int(h[place])]:
                if queries.words[q] == run:
                    found[d][q] = place - int(ends[d]) + len(docs[d])
    return found


def common_subsequence(mask: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, all places of the passage at once in one integer."""
    full = (1 << length) - 1
    row = full
    for w in words:
        hit = mask.get(w)
        if hit:
            step = row & hit
            row = ((row + step) | (row - step)) & full
    return length - row.bit_count()


def contains(words: list[int], run: list[int]) -> bool:
    return any(words[i:i + len(run)] == run for i in range(len(words) - len(run) + 1))


def groups_of_parts(docs: list[np.ndarray], stride: int):
    """(document, words) of parts of documents, together of about ``stride`` blocks at a time; a long
    document is cut, its parts overlap by a window."""
    group, size = [], 0
    for d, words in enumerate(docs):
        for at in range(0, len(words), stride * STEP):
            part = words[at:at + (stride + SPAN - 1) * STEP]
            if group and size + len(part) > stride * STEP:
                yield group
                group, size = [], 0
            group.append((d, part))
            size += len(part)
    if group:
        yield group


def latent_blocks(parts: list[np.ndarray], lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of the blocks of all parts, each followed by empty blocks for the windows at its end, and where
    the blocks of each part begin."""
    counts = np.array([-(-len(p) // STEP) for p in parts])
    first = np.cumsum(counts + SPAN - 1) - (counts + SPAN - 1)
    blocks = np.zeros((int((counts + SPAN - 1).sum()), lifted.shape[1]), np.float32)
    for at, n, part in zip(first.tolist(), counts.tolist(), parts, strict=True):
        blocks[at:at + n] = latent(part, lifted)
    return blocks, first


def matches(docs: list[np.ndarray], exact: list[dict[int, int]], queries: Queries, lifted: np.ndarray) -> list[dict[int, tuple[float, float]]]:
    """Per document, item -> (cosine, share of the passage) of its best verified passage. ``exact``: passages
    that stand in it word for word, with their places."""
    found: list[dict[int, tuple[float, float]]] = [{} for _ in docs]

    def add(doc: int, item: int, cosine: float, share: float) -> None:
        if item not in found[doc] or (share, cosine) > found[doc][item][::-1]:
            found[doc][item] = cosine, share

    for d, places in enumerate(exact):
        for q, place in places.items():
            window = latent(docs[d][place // STEP * STEP:][:SPAN * STEP], lifted).sum(axis=0, keepdims=True)
            add(d, queries.items[q], float((window @ queries.unit[q])[0] / lengths_of(window)[0]), 1.0)
    for group in groups_of_parts(docs, 8 * ROWS_AT_ONCE):
        blocks, first = latent_blocks([part for _, part in group], lifted)
        for span, chosen, least in queries.spans:
            window = blocks.copy()
            for i in range(1, span):
                window[:-i] += blocks[i:]
            along = window @ queries.unit[chosen].T
            cosine = along / lengths_of(window)[:, None]
            for at, c in zip(*np.nonzero((cosine >= least) & (along >= CONTAINED * queries.norm[chosen])), strict=True):
                g = int(np.searchsorted(first, at, "right")) - 1
                w, (d, part) = int(at - first[g]), group[g]
                q = chosen[c]
                text = part[w * STEP:(w + span) * STEP].view(np.int64).tolist()
                passage = queries.words[q]
                held = [x for x in text if x in queries.masks[q]]
                if len(held) / len(passage) < PARAPHRASE_SHARE:      # a common subsequence is no longer than these
                    continue
                share = common_subsequence(queries.masks[q], len(passage), held) / len(passage)
                real = share >= COPY_SHARE
                if not real and share >= PARAPHRASE_SHARE:
                    near = part[max(0, w - 1) * STEP:(w + 2 * SPAN) * STEP].view(np.int64).tolist()
                    real = contains(near, queries.answers[q])
                if real:
                    add(d, queries.items[q], float(cosine[at, c]), share)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_no, doc_id, item_id, cosine, shared per document and item found in it.

    ``docs`` holds row_no, doc_id and text; ``benchmark`` item_id, text and, if there is one, answer.
    Null or empty texts, and an empty table on either side, match nothing. Repeated rows are each
    reported. ``shared`` is the part of the best passage that the document has in order.
    """
    spark = docs.sparkSession
    out = "row_no bigint, doc_id bigint, item_id bigint, cosine double, shared double"
    passages = benchmark_passages(benchmark)
    total = passages.count()
    if not total:
        return spark.createDataFrame([], out)
    idf = word_weights(docs)
    matrix = fitted_passages(docs, passages)
    basis = latent_basis(matrix, idf).astype(np.float16)

    numbered = keep(passages.withColumn("block", F.floor(F.monotonically_increasing_id() % (1 << 33) / QUERY_BLOCK))
                    .withColumn("task", F.spark_partition_id()), "queries")
    found = None
    for block in numbered.select("task", "block").distinct().orderBy("task", "block").toLocalIterator():
        mine = (F.col("task") == block["task"]) & (F.col("block") == block["block"])
        queries = prepared(numbered.where(mine).collect(), lifted_basis(basis, idf))      # at most QUERY_BLOCK passages

        def search(batches, queries=queries):
            lifted = lifted_basis(basis, idf)
            for batch in batches:
                rows = []
                texts = [t or "" for t in batch.column(2).to_pylist()]
                hashes = word_hashes(texts)
                best = matches(hashes, exact_matches(hashes, queries), queries, lifted)
                for no, doc_id, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), best, strict=True):
                    rows += [(no, doc_id, item, *values) for item, values in items.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 3 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["row_no", "doc_id", "item_id", "cosine", "shared"])

        part = docs.select("row_no", "doc_id", "text").mapInArrow(search, out)
        found = part if found is None else found.union(part)
    best = F.max_by(F.struct("cosine", "shared"), F.struct("shared", "cosine")).alias("best")
    return (found.groupBy("row_no", "doc_id", "item_id").agg(best)     # an item may lie in several blocks
            .select("row_no", "doc_id", "item_id", "best.cosine", "best.shared"))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    return contaminated(rows, table(spark, sf_dir, "benchmark")).drop("row_no")
