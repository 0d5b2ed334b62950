"""Packing by power-of-two decomposition.

A document of n ids is cut into full sequences and the binary lengths of what remains, longest
first. A sequence holds exactly one piece, so it never crosses documents, its length is a power of
two and nothing is padded. Sequences of one length form a bucket; their numbers are consecutive.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.finite_state import compiled
from touchline.llm.registry import query
from touchline.llm.storage import bounded, keep, table

MAX_LENGTH = 2048
END_ID = 1
COLUMNS = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, part bigint, nth bigint"


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: as often ``longest`` as it fits, then descending powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, longest: int = MAX_LENGTH,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``longest`` must be a power of two. ``ids`` are little-endian, two bytes each where the vocabulary
    has up to 65,536 ids, else four. A null text counts as empty and gives the one-id document of
    ``end_id``. Repeated rows are packed each for itself. Texts are not shuffled: pieces are written
    where they arise with their task and their place among equal lengths, and sequence numbers
    follow from the counts per task and length.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        machine = compiled(tokenizer)
        part, nth = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), machine.encode(texts, last=end_id), strict=True):
                start = 0
                for length in piece_lengths(len(ids), longest):
                    rows.append((doc_id, start, length, len(ids), ids[start:start + length].tobytes(), part, nth[length]))
                    nth[length] += 1
                    start += length
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    pieces = keep(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
                  .mapInArrow(cut, COLUMNS), "pieces", compression="zstd")
    buckets = pieces.groupBy("length", "part").count()
    before = F.sum("count").over(Window.orderBy("length", "part")) - F.col("count")  # a few rows per task
    numbers = bounded(keep(buckets.select("length", "part", before.alias("base")), "buckets"))
    return pieces.join(numbers, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def piece_digests(pieces: DataFrame, kind: np.dtype) -> DataFrame:
    """The pieces with ids_crc32, over four-byte ids, in place of the ids, which are of the given type."""
    @F.udf("bigint", useArrow=True)
    def crc(ids):
        return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())

    return pieces.select("doc_id", "start", "length", crc("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packed(table(spark, sf_dir, "documents"), path)
    return piece_digests(pieces, compiled(path).id_type)
