"""Token counts of whole texts: a finite-state transducer splits them, a memo over the library counts (see ``finite_state``)."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.finite_state import compiled
from touchline.llm.registry import query
from touchline.llm.storage import table

LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    ``tokenizer`` is the path of a ``tokenizers`` file, the same on every machine. Counts are those
    of that library without added special tokens; special strings inside a text count as it treats
    them. A null text counts as empty: 0 bytes, 0 tokens. No shuffle: each task counts its rows.
    """
    def count(batches):
        machine = compiled(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
            .mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
