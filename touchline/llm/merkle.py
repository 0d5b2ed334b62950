"""Merkle manifest of a table on a tree of SHA midstates.

Rows are leaves; every 16 consecutive nodes of a group become one parent until one node, the group's subroot,
remains; the subroots become the tree of the whole table. A parent keeps a copy of its hash state from before
each child slot. Folding a changed child resumes the state of its slot with the replacement and the siblings on
its right only; nothing on its left is hashed again.

Work goes in units of 256 consecutive nodes (two levels), so no task holds more than a unit at a time, however
large a group is. A unit's way to the root is handed down from the unit above it, which has 256 children at
most; so the upper nodes, which every row needs, are never a join key of many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.registry import query
from touchline.llm.storage import bounded, keep, table

FANOUT = 16
LEVELS = 2                       # levels that one unit spans
UNIT_BITS = 8                    # FANOUT ** LEVELS nodes
DIGEST = 32                      # bytes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<slot: int, run: binary>>"     # from the lowest parent up; run: digests of all its children
PATH_ARROW = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))


# --- one parent ----------------------------------------------------------------------------------

class Parent:
    """A node over the raw digests of its children, with the hash state before each of them."""

    def __init__(self, children: list[bytes]):
        self.texts = [c.hex().encode() for c in children]
        self.states = []
        state = hashlib.sha256()
        for text in self.texts:
            self.states.append(state.copy())
            state.update(text)
        self.digest = state.digest()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """Digest of this node with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement.hex().encode())
        state.update(b"".join(self.texts[slot + 1:]))
        return state.digest()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.texts[:slot] + self.texts[slot + 1:])

    def run(self) -> bytes:
        return bytes.fromhex(b"".join(self.texts).decode())


def split_run(run: bytes) -> list[bytes]:
    return [run[i:i + DIGEST] for i in range(0, len(run), DIGEST)]


def unit_levels(digests: list[bytes], nodes: int) -> list[list[Parent]]:
    """The parents above a unit's nodes, by level, lowest first. ``nodes``: how many its whole tree has there."""
    levels = []
    for _ in range(LEVELS):
        if nodes == 1:
            break
        levels.append([Parent(digests[i:i + FANOUT]) for i in range(0, len(digests), FANOUT)])
        digests, nodes = [p.digest for p in levels[-1]], -(-nodes // FANOUT)
    return levels


def chain(levels: list[list[Parent]], place: int) -> list[tuple[Parent, int]]:
    """(parent, slot) from a unit's node up to the unit's top."""
    found = []
    for level in levels:
        found.append((level[place // FANOUT], place % FANOUT))
        place //= FANOUT
    return found


# --- trees ---------------------------------------------------------------------------------------

def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place among the rows of their ``key`` in ascending ``order``, and ``n``, how many
    rows the key has. ``order`` must tell all rows of a key apart.

    Rows are sorted by ranges; a place follows from the counts per (key, range), so a key may span any
    number of tasks.
    """
    ordered = keep(
        rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
        .withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "ordered")
    runs = ordered.groupBy("key", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    of_key = Window.partitionBy("key")
    runs = keep(runs.select(
        "key", "part", "first",
        (F.sum("size").over(of_key.orderBy("part")) - F.col("size")).alias("before"),
        F.sum("size").over(of_key).alias("n")), "runs")   # a row per range and a row per key at most
    return ordered.join(bounded(runs), ["key", "part"]).withColumn(
        "pos", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def units(nodes: DataFrame) -> DataFrame:
    """key, unit, n and the unit's nodes in order; ``nodes``: key, pos, n, digest and any other columns."""
    rest = [c for c in nodes.columns if c not in ("key", "n", "pos")]
    return nodes.groupBy("key", F.shiftright("pos", UNIT_BITS).alias("unit")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("nodes"))


def each_unit(batch: pa.RecordBatch) -> Iterable[tuple[int, int, int]]:
    """(row, first node, end of its nodes) of the units of a batch, into ``nodes.flatten()``."""
    lengths = batch.column("nodes").value_lengths().to_pylist()
    start = 0
    for i, length in enumerate(lengths):
        yield i, start, start + length
        start += length


def climbed(level: DataFrame) -> DataFrame:
    """The node above each unit: key, pos, n, digest."""
    def climb(batches):
        for batch in batches:
            digests = batch.column("nodes").flatten().field("digest").to_pylist()
            counts = batch.column("n").to_pylist()
            tops = []
            for i, a, b in each_unit(batch):
                levels = unit_levels(digests[a:b], counts[i])
                tops.append(levels[-1][0].digest if levels else digests[a])
            above = [-(-n // FANOUT ** LEVELS) for n in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("unit"), pa.array(above, pa.int64()), pa.array(tops, pa.binary())],
                ["key", "pos", "n", "digest"])

    return level.select("key", "unit", "n", "nodes").mapInArrow(climb, "key string, pos bigint, n bigint, digest binary")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The unit tables of all trees of ``nodes`` (by ``key``), lowest first, and (key, digest) of their roots."""
    steps, roots = [], None
    while True:
        steps.append(keep(units(nodes), "units"))
        up = keep(climbed(steps[-1]), "nodes")
        done = up.where("n = 1").select("key", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = up.where("n > 1")
        if nodes.isEmpty():
            return steps, roots


def with_paths(steps: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest units with the columns of ``above`` (one row per ``key``; ``path`` is the way from the tree's root on)
    and ``path``, the way from the unit's top on."""
    others = [c for c in above.columns if c not in ("key", "path")]
    paths = None
    for step in range(len(steps) - 1, -1, -1):
        own_top = F.col("n") <= FANOUT ** LEVELS
        found = steps[step].where(own_top).join(above, "key")
        if paths is not None:
            found = found.unionByName(steps[step].where(~own_top).join(paths, ["key", "unit"]))
        if step == 0:
            return found
        paths = keep(descended(found, others), "paths")


def descended(level: DataFrame, others: list[str]) -> DataFrame:
    """key, unit, ``others`` and path of every unit below the units of ``level``."""
    def descend(batches):
        for batch in batches:
            digests = batch.column("nodes").flatten().field("digest").to_pylist()
            counts, paths = batch.column("n").to_pylist(), batch.column("path").to_pylist()
            rows, places, found = [], [], []
            for i, a, b in each_unit(batch):
                levels = unit_levels(digests[a:b], counts[i])
                for place in range(b - a):
                    rows.append(i)
                    places.append(place)
                    found.append([{"slot": s, "run": p.run()} for p, s in chain(levels, place)] + paths[i])
            below = batch.select(["key", "unit", *others]).take(pa.array(rows, pa.int64()))
            units = [(u << UNIT_BITS) + p for u, p in zip(below.column("unit").to_pylist(), places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [below.column("key"), pa.array(units, pa.int64()), *[below.column(c) for c in others],
                 pa.array(found, PATH_ARROW)], ["key", "unit", *others, "path"])

    kinds = ", ".join(f"{c} {level.schema[c].dataType.simpleString()}" for c in others)
    return level.select("key", "unit", "n", "nodes", *others, "path").mapInArrow(
        descend, f"key string, unit bigint, {kinds + ', ' if others else ''}path {PATH}")


# --- the manifest --------------------------------------------------------------------------------

def record(columns: Iterable[Column]) -> Column:
    """What is hashed for a row: ``-`` for a null, else the value's UTF-8 byte count, a colon and the value."""
    return F.concat(*[
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
        for c in columns])


def digest_of(columns: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(record(columns), 256))


def manifest(docs: DataFrame, columns: Iterable[str] = COLUMNS, changes: dict[str, Column] | None = None,
             id_column: str = "doc_id", group_column: str = "source") -> DataFrame:
    """One row per input row: ``id_column``, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's ``columns``. Leaves of a group ascend by id (null first); rows that repeat an
    id ascend by leaf. Groups ascend by UTF-8 bytes, null first. ``changes`` names columns that a row to be verified
    has otherwise than the manifest: the row's leaf is recomputed from them and folded with the siblings of the
    manifest; ``verified`` tells whether the root comes out. Without changes every row verifies. ``proof_sha256`` is
    the digest of all siblings on the way up. Texts may be empty, null or long; they are hashed where they are read
    and never shuffled. Columns not named are ignored. An empty table gives no rows.
    """
    columns, changes = list(columns), changes or {}
    was = [F.col(c) for c in columns]
    now = [changes.get(c, F.col(c)) for c in columns]
    group = F.col(group_column)
    leaves = keep(docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string"))).alias("key"),  # keeps null first
        F.col(id_column).alias("id"), digest_of(was).alias("digest"),
        (digest_of(now) if changes else F.lit(None).cast("binary")).alias("changed"),
        F.monotonically_increasing_id().alias("row_no")), "leaves")
    steps, subroots = build(placed(leaves, ["id", "digest", "row_no"]).drop("row_no"))

    groups = keep(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "subroots")
    top, roots = build(placed(groups, ["group"]))
    root = (roots.first() or {"digest": b""})["digest"]      # one digest of the table
    above = roots.select("key", F.array().cast(PATH).alias("path"))
    above = keep(group_paths(with_paths(top, above)), "group_paths")
    found = proven(with_paths(steps, above), bytes(root))
    return found.withColumnRenamed("id", id_column)


def group_paths(level: DataFrame) -> DataFrame:
    """key, subroot and path of every group, from the lowest units of the tree of groups."""
    def spread(batches):
        for batch in batches:
            flat = batch.column("nodes").flatten()
            digests, counts, paths = flat.field("digest").to_pylist(), batch.column("n").to_pylist(), batch.column("path").to_pylist()
            found = []
            for i, a, b in each_unit(batch):
                levels = unit_levels(digests[a:b], counts[i])
                found += [[{"slot": s, "run": p.run()} for p, s in chain(levels, place)] + paths[i] for place in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("group"), pa.array(digests, pa.binary()), pa.array(found, PATH_ARROW)], ["key", "subroot", "path"])

    return level.select("n", "nodes", "path").mapInArrow(spread, f"key string, subroot binary, path {PATH}")


def proven(level: DataFrame, root: bytes) -> DataFrame:
    """Folds every leaf of the lowest units up to the root."""
    kind = level.schema["nodes"].dataType.elementType["id"].dataType.simpleString()

    def prove(batches):
        for batch in batches:
            flat = batch.column("nodes").flatten()
            digests, changed = flat.field("digest").to_pylist(), flat.field("changed").to_pylist()
            counts, paths, subroots = (batch.column(c).to_pylist() for c in ("n", "path", "subroot"))
            subroot, proof, folded = [], [], []
            for i, a, b in each_unit(batch):
                levels = unit_levels(digests[a:b], counts[i])
                upper = [(Parent(split_run(p["run"])), p["slot"]) for p in paths[i]]
                rest = b"".join(p.siblings(s) for p, s in upper)
                for place in range(b - a):
                    way = chain(levels, place)
                    proof.append(hashlib.sha256(b"".join(p.siblings(s) for p, s in way) + rest).hexdigest())
                    node = changed[a + place] or digests[a + place]
                    for parent, slot in way + upper:
                        node = parent.fold(slot, node)
                    folded.append(node.hex())
                subroot += [subroots[i].hex()] * (b - a)
            yield pa.RecordBatch.from_arrays(
                [flat.field("id"), pa.array([d.hex() for d in digests], pa.string()), pa.array(subroot, pa.string()),
                 pa.array([root.hex()] * len(digests), pa.string()), pa.array(proof, pa.string()),
                 pa.array(folded, pa.string()), pa.array([f == root.hex() for f in folded], pa.bool_())],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return level.select("n", "nodes", "path", "subroot").mapInArrow(
        prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_text() -> Column:
    """``text`` with A-Z in lower case where 5 divides the crc32 of the id in decimal."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))


def _sql_record(text: str) -> str:
    values = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "||".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


SQL = rf"""
with recursive t as (
  select *, list_reduce(
      list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, 3988292384 * (a & 1)) end) as crc
  from documents),
u as (
  select *, case when xor(crc, 4294967295) % 5 = 0 then translate(text, '{CAPITALS}', '{CAPITALS.lower()}') else text end as text2
  from t),
l as (
  select doc_id, case when source is null then '' else '=' || source end as k,
    sha256({_sql_record('text')}) as leaf, sha256({_sql_record('text2')}) as leaf2
  from u),
p as (
  select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n
  from l),
tree as (
  select 0 as lvl, k, pos, n, leaf as d from p
  union all
  select lvl + 1, k, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' order by pos))
  from tree where n > 1 group by lvl, k, pos // 16, n),
sub as (
  select k, d as subroot, row_number() over (order by encode(k)) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (
  select 0 as lvl, pos, n, subroot as d from sub
  union all
  select lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' order by pos))
  from top where n > 1 group by lvl, pos // 16, n),
runs as (select k, lvl, pos // 16 as run, list(d order by pos) as ds from tree where n > 1 group by all),
top_runs as (select lvl, pos // 16 as run, list(d order by pos) as ds from top where n > 1 group by all),
fold as (
  select k, pos as leaf_no, 0 as lvl, pos, n, leaf2 as d, '' as proof from p
  union all
  select f.k, leaf_no, f.lvl + 1, f.pos // 16, (n + 15) // 16,
    sha256(array_to_string(ds[:f.pos % 16], '') || d || array_to_string(ds[f.pos % 16 + 2:], '')),
    proof || array_to_string(ds[:f.pos % 16], '') || array_to_string(ds[f.pos % 16 + 2:], '')
  from fold f join runs r on r.k = f.k and r.lvl = f.lvl and r.run = f.pos // 16 where n > 1),
up as (
  select f.k, leaf_no, 0 as lvl, s.pos, s.n, d, proof from fold f join sub s on s.k = f.k where f.n = 1
  union all
  select f.k, leaf_no, f.lvl + 1, f.pos // 16, (n + 15) // 16,
    sha256(array_to_string(ds[:f.pos % 16], '') || d || array_to_string(ds[f.pos % 16 + 2:], '')),
    proof || array_to_string(ds[:f.pos % 16], '') || array_to_string(ds[f.pos % 16 + 2:], '')
  from up f join top_runs r on r.lvl = f.lvl and r.run = f.pos // 16 where n > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, up.d as folded_root, up.d = root as verified
from p join up on up.k = p.k and up.leaf_no = p.pos and up.n = 1
  join sub on sub.k = p.k, (select d as root from top where n = 1)"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), changes={"text": tampered_text()})
