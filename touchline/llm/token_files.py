"""Token ids in compact files: canonical length-limited Huffman codes from global counts.

Documents are encoded once and kept as compressed ids. Counts of every id over all documents give
code lengths (package-merge, at most ``MAX_BITS`` bits); only the lengths are stored, since canonical
codes follow from them. Documents are ranged by id; every task writes segments of whole documents.
Inside a segment the bits form blocks of ``BLOCK`` ids that start at recorded bit offsets, so blocks
decode independently, and a reader decodes all blocks of a segment in step with one table look-up
per id.

File format: a Parquet folder ``segments`` (part, segment, first, doc_ids, lengths, checkpoints,
bits) and a Parquet folder ``code`` (id, bits). Segments in the order of (part, segment) hold the
documents in ascending order of id; ``first`` counts the ids before a segment in its part.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.finite_state import compiled
from touchline.llm.registry import query
from touchline.llm.storage import keep, numbered, table
from touchline.session import fresh_dir

END_ID = 2
MAX_BITS = 16
BLOCK = 1024
SEGMENT_IDS = 1 << 18
PART_IDS = 1 << 23


# ---- codes ----------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the symbols that occur (0 for the others)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaf_flags = weights, [np.ones(len(weights), bool)]
    for _ in range(max_bits - 1):
        packages = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        leaf_flags.append(by_weight < len(weights))
    taken, bits = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:taken].sum())
        bits[:leaves] += 1
        taken = 2 * (taken - leaves)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[symbol])
        if n:
            code <<= n - last
            codes[symbol], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every ``max_bits`` bits to come: symbol * 32 + code length."""
    entries = np.zeros(1 << max_bits, np.int64)
    for symbol, code in enumerate(canonical_codes(lengths).tolist()):
        n = int(lengths[symbol])
        if n:
            entries[code << (max_bits - n):(code + 1) << (max_bits - n)] = symbol * 32 + n
    return entries


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every block of ``BLOCK`` ids)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    word, inside = begins >> 5, begins & 31
    value = codes[ids] << (64 - inside - size).astype(np.uint64)   # a code spans two 32-bit words at most
    n_words = (int(ends[-1]) >> 5) + 2 if len(ids) else 0
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n_words)
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    n_bytes = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    return out.astype(">u4").tobytes()[:n_bytes], begins[::BLOCK]


def decode_ids(bits: bytes, checkpoints: np.ndarray, n_ids: int, entries: np.ndarray,
               max_bits: int = MAX_BITS) -> np.ndarray:
    """All blocks advance in step, one id each."""
    raw = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.int64)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    place = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((BLOCK, len(place)), np.uint32)
    last = len(window) - 1
    for i in range(min(BLOCK, n_ids)):
        ahead = window[np.minimum(place >> 3, last)] >> (24 - max_bits - (place & 7)) & ((1 << max_bits) - 1)
        found = entries[ahead]
        out[i] = found >> 5
        place += found & 31
    return out.T.ravel()[:n_ids]


# ---- writing --------------------------------------------------------------------------------------

def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, row_no, n_ids, ids (four bytes each, compressed) of every row, kept in the shared folder."""
    def encode(batches):
        machine, squeeze = compiled(tokenizer), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = machine.encode([t or "" for t in batch.column(1).to_pylist()], last=end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([machine.id_type.itemsize] * len(ids), pa.int32()),
                 pa.array([squeeze.compress(x.tobytes()) for x in ids], pa.binary())],
                ["doc_id", "row_no", "n_ids", "width", "ids"])

    return keep(numbered(docs, "doc_id", "text").mapInArrow(
        encode, "doc_id bigint, row_no bigint, n_ids bigint, width int, ids binary"), "ids", compression="uncompressed")


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), f"<u{width}").astype(np.int64)


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents; at most one number per vocabulary entry."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(unpacked(data, width), minlength=len(total))
                found[:len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = (encoded.select("ids", "width").mapInArrow(count, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    out[ids] = n
    return out


SEGMENTS = ("part bigint, segment bigint, first bigint, doc_ids array<bigint>, lengths array<bigint>, "
            "checkpoints array<bigint>, bits binary")


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the files of ``docs`` (doc_id, text) below ``path``.

    Null texts count as empty and give the single id ``end_id``. Documents are in ascending order of
    id, null ids first, repeated rows one after the other. A table without rows gives files without
    rows.
    """
    spark = docs.sparkSession
    encoded = encoded_documents(docs, tokenizer, end_id)
    counts = id_counts(encoded)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)],
                          "id bigint, bits int").coalesce(1).write.parquet(f"{path}/code")

    def segments(batches):
        part, first, number = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, n_held = [], [], [], 0

        def closed():
            ids = np.concatenate(held)
            bits, checkpoints = encode_ids(ids, lengths, codes)
            return {"part": part, "segment": number, "first": first, "doc_ids": doc_ids, "lengths": sizes,
                    "checkpoints": checkpoints.tolist(), "bits": bits}

        schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                            ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids.append(row["doc_id"])
                sizes.append(row["n_ids"])
                held.append(unpacked(row["ids"], row["width"]))
                n_held += row["n_ids"]
                if n_held >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([closed()], schema=schema)
                    first, number = first + n_held, number + 1
                    doc_ids, sizes, held, n_held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema=schema)

    parts = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // PART_IDS))
    (encoded.repartitionByRange(parts, "doc_id", "row_no").sortWithinPartitions("doc_id", "row_no")
     .mapInArrow(segments, SEGMENTS).write.option("compression", "uncompressed").parquet(f"{path}/segments"))


# ---- reading --------------------------------------------------------------------------------------

def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids array<bigint>... see ``document_digests``."""
    return _read(spark, path, lambda ids: ids.tolist(), "ids array<bigint>", pa.list_(pa.int64()))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 bigint", pa.int64())


def _read(spark: SparkSession, path: str, digest, column: str, kind: pa.DataType) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    code = spark.read.parquet(f"{path}/code").toArrow()          # one row per vocabulary entry
    ids = code.column("id").to_numpy()
    lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint8)
    lengths[ids] = code.column("bits").to_numpy()

    sizes = segments.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")   # one row per written part
    bases = sizes.select("part", before.alias("base"))

    def decode(batches):
        entries = decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                found = decode_ids(row["bits"], row["checkpoints"], int(ends[-1]), entries)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["first"] + ends - n), pa.array(n),
                     pa.array([digest(found[e - k:e]) for e, k in zip(ends, n, strict=True)], kind)],
                    ["doc_id", "start", "n_tokens", column.split()[0]])

    return (segments.join(bases, "part").select("base", "first", "doc_ids", "lengths", "checkpoints", "bits")
            .mapInArrow(decode, f"doc_id bigint, start bigint, n_tokens bigint, {column}"))


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    path = fresh_dir(spark, "llm-token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return document_digests(spark, path)
