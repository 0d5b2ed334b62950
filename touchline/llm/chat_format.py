"""Chat formatting by schema fingerprints.

A record of any layout is turned into a variant. The nested field paths found in it are hashed to a
fingerprint, which selects one of the declared mappings (``LAYOUTS``) into canonical turns
(conv_id, turn, role, text). Each turn becomes one piece of formatted text; the pieces of a
conversation, in turn order, are its formatted text. A conversation is never held in one place, so
its length has no bound.

The template is ``<| role |>``, newline, text, ``<|end|>``, newline. Backslashes, ``<|`` and ``|>`` inside roles
and texts get a backslash, so control strings appear only where the template puts them, and
removing one backslash before each escaped character restores the text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import keep, table

END = "<|end|>\n"


@dataclass(frozen=True)
class Layout:
    """A mapping for records with exactly these paths (among those known to any layout).

    ``turns`` lists (role, path) of single fields; ``items`` names an array whose elements hold the
    role and the text in the two given fields. ``turn`` is the path of an explicit turn number.
    """
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    role: str | None = None
    turn: str | None = None


LAYOUTS = (
    Layout(("role", "text", "turn"), turns=(("", "text"),), role="role", turn="turn"),
    Layout(("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"),
           turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "response", "system"),
           turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
)

# Names that message lists use for the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def variant(value: Column, path: str) -> Column:
    """The value at a path; a null value is found, too, and is then the variant null."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def items_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def present(record: Column, path: str) -> Column:
    """Whether a path of a layout occurs: a field that is neither list nor object, or a field of a list's items.

    Only the value at the path is looked at, so neither the width nor the depth of the rest of a record matters.
    """
    head, inner, leaf = path.partition("[].")
    value = variant(record, head)
    if inner:
        return F.exists(items_of(value), lambda item: variant(item, leaf).isNotNull())
    return value.isNotNull() & ~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)")


def fingerprint(record: Column) -> Column:
    """Hash of the known field paths present in a variant; fields of no layout don't count."""
    return F.sha2(F.concat_ws("\n", *[F.when(present(record, path), F.lit(path)) for path in KNOWN_PATHS]), 256)


def canonical_role(role: Column) -> Column:
    out = role
    for other, name in ROLE_NAMES.items():
        out = F.when(F.lower(F.trim(role)) == other, name).otherwise(out)
    return out


def item_text(item: Column, path: str) -> Column:
    """Text of a list's item. A list of parts gives the parts' texts, one after another; an item without the field
    and a part without a text give their JSON."""
    value = variant(item, path)
    plain = F.try_variant_get(value, "$", "string")
    parts = F.transform(items_of(value), lambda part: F.coalesce(
        F.try_variant_get(part, "$.text", "string"), F.try_variant_get(part, "$", "string")))
    return F.when(value.isNull(), F.try_variant_get(item, "$", "string")).otherwise(
        F.coalesce(F.array_join(parts, ""), plain))


def canonical_turns(records: DataFrame, id_column: str = "conv_id", record_column: str = "record") -> DataFrame:
    """conv_id, turn, role, text, unknown, raw from a variant column of mixed layouts.

    Null texts and roles become empty. Turn numbers are the record's own or the place in the record.
    A record of no known layout (null and empty ones and empty lists too) gives one row with a null turn, an empty
    role and text, its fingerprint in ``unknown`` and its JSON in ``raw``, so nothing it says is lost. Records
    that share an id share a conversation; an empty table gives no rows. Other columns are ignored.
    """
    record = F.col("record")
    base = records.select(F.col(id_column).alias("conv_id"), F.col(record_column).alias("record"))
    base = base.withColumn("fingerprint", fingerprint(record))

    def get(value: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(value, f"$.{path}", kind)

    def item_turn(role: str, text: str):
        return lambda item, i: F.struct(i.cast("bigint").alias("turn"), canonical_role(get(item, role)).alias("role"),
                                        item_text(item, text).alias("text"))

    turn_type = "array<struct<turn: bigint, role: string, text: string>>"
    mapped = F.array(F.struct(F.lit(None).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))).cast(turn_type)
    known = F.lit(False)
    for layout in LAYOUTS:
        if layout.items:
            array, role, text = layout.items
            turns = F.transform(F.try_variant_get(record, f"$.{array}", "array<variant>"), item_turn(role, text))
        else:
            turns = F.array(*[
                F.struct(
                    (get(record, layout.turn, "bigint") if layout.turn else F.lit(i)).cast("bigint").alias("turn"),
                    (get(record, layout.role) if layout.role else F.lit(role)).alias("role"),
                    get(record, path).alias("text"))
                for i, (role, path) in enumerate(layout.turns)])
        match = F.col("fingerprint") == fingerprint_of(layout.paths)
        mapped = F.when(match, turns.cast(turn_type)).otherwise(mapped)
        known = known | match
    rows = base.select("conv_id", F.when(~known, F.col("fingerprint")).alias("unknown"),
                       F.when(~known, F.to_json("record")).alias("raw"), F.inline(mapped))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"), "unknown", "raw")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<|"), F.lit("<\\|"))
    return F.replace(text, F.lit("|>"), F.lit("|\\>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_pieces(turns: DataFrame) -> DataFrame:
    """conv_id, turn, seq, piece, loss_start, loss_end per turn.

    The loss span covers an assistant's text inside the piece in code points, end excluded, and is
    empty elsewhere. ``seq`` orders turns that share a number: by role, then text. An empty role or text gives a
    piece without it, and a record of no known layout is a piece of its JSON. Repeated turns stay, a null turn
    comes first, and an empty table gives no pieces.
    """
    if "raw" in turns.columns:
        turns = turns.withColumn("text", F.coalesce("raw", "text"))
    head = F.concat(F.lit("<| "), escaped(F.col("role")), F.lit(" |>\n"))
    body = escaped(F.col("text"))
    start = F.length(head)
    return turns.select(
        "conv_id", "turn",
        F.struct("role", "text").alias("seq"),
        F.concat(head, body, F.lit(END)).alias("piece"),
        start.alias("loss_start"),
        F.when(F.col("role") == "assistant", start + F.length(body)).otherwise(start).alias("loss_end"))


def parsed_pieces(pieces: DataFrame) -> DataFrame:
    """Roles, texts and texts under the loss mask, read back from formatted pieces."""
    piece = F.col("piece")
    return pieces.select(
        "conv_id", "turn",
        unescaped(F.regexp_extract(piece, r"(?s)^<\| (.*?) \|>\n", 1)).alias("role"),
        unescaped(F.regexp_extract(piece, r"(?s)^<\| .*? \|>\n(.*)<\|end\|>\n$", 1)).alias("text"),
        unescaped(F.substring(piece, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
        F.length(piece).cast("bigint").alias("chars"))


DIGEST_SCHEMA = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                 "loss_sha256 string, formatted_chars bigint")


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """Digests over each conversation in turn order.

    Rows are sorted by conversation inside partitions and hashed as a stream: a conversation with a
    third of all rows needs one task's time, but no memory beyond one batch. Equal rows count each; rows without
    a conversation id are one conversation; an empty table gives no digests.
    """
    def digest(batches):
        current, state = None, None

        def closed():
            return {"conv_id": current[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(),
                    "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if current != (row["conv_id"],):
                    if current:
                        done.append(closed())
                    current, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{row['role']}\n{row['text']}\n".encode())
                state[2] += len(row["loss"])
                state[3].update(row["loss"].encode())
                state[4] += row["chars"]
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if current:
            yield pa.RecordBatch.from_pylist([closed()], schema=schema)

    return (parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(digest, DIGEST_SCHEMA))


def with_probe(records: DataFrame) -> DataFrame:
    """Adds conversation -7, given in the messages layout: its texts hold control strings."""
    text = r"\### Assistant: </turn> ok"
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(text).alias("content")) for r in ("user", "assistant")])
    probe = records.sparkSession.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    return records.unionByName(probe)


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') as r,
    replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') as x
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<| ' || r || ' |>' || chr(10) || x || '<|end|>' || chr(10))) as bigint) as formatted_chars
from e group by conv_id"""


@query("op2_chat_format", SQL)
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    records = with_probe(rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record")))
    pieces = keep(formatted_pieces(canonical_turns(records)), "chat")
    return conversation_digests(parsed_pieces(pieces))
