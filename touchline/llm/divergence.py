"""Source divergence audit by iceberg prefix refinement.

Which terms of a language stand in enough of its documents is found without counting every term. Terms are
byte strings; the first level counts, per language, the documents that hold a prefix of four bytes. Prefixes
below the threshold cannot begin a term at or above it and are discarded; the others are extended to twice
their length and counted again, until only complete terms remain. What survives a level reaches the next as a
bitmap of bounded size: a prefix let through by a clash of bits falls at the next count, as a complete term does.

Term frequencies of each source are then compared with those of its language and of every other source.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.registry import query
from touchline.llm.storage import keep, prepare, table

LEAST_DOCS = 30
FIRST_PREFIX = 4              # bytes; doubled from level to level
SMOOTH = 5                    # added to every count
UNIT = 1_000_000_000          # frequencies are parts of this
TOP_TERMS = 50
BITMAP_LOG2 = 27              # bits of a level's bitmap at most (16 MB); a fuller one only prunes less
BLOCK_LOG2 = 15               # bits of a block in which bitmaps are merged
CHUNK_BYTES = 32 << 20        # text whose terms are numbered together
HELD = 400_000                # tests of a bitmap that a task remembers
TERM_BLOCK = 2_048            # terms compared at once
SOURCE_BLOCK = 32             # sources compared at once

# Term characters: ASCII letters and everything beyond ASCII. Lower-casing bytes touches A-Z only.
_SPACED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
END = b"\0"                   # closes a complete term; never part of one


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACED).split()


# --- documents as their distinct terms ------------------------------------------------------------

CHUNK = pa.schema([("lang", pa.string()), ("terms", pa.binary()), ("sources", pa.list_(pa.string())),
                   ("sizes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])


def term_lists(docs: DataFrame) -> DataFrame:
    """Documents as the distinct terms they hold, in chunks of one language: about ``CHUNK_BYTES`` of text, or one
    longer document.

    ``terms``: the chunk's distinct terms, each closed by ``END``; per document its source, the number of its distinct
    terms, their places in ``terms`` (ascending) and how often each occurs (32-bit integers). Nulls are ''.
    """
    def chunk(lang: str, sources: list[str], texts: list[bytes]) -> pa.RecordBatch:
        places: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids, counts = [], []
        for text in texts:
            found = terms_of(text)
            one, n = np.unique(np.fromiter(map(places.__getitem__, found), np.int32, len(found)), return_counts=True)
            ids.append(one)
            counts.append(n.astype(np.int32))
        row = [lang, b"".join(t + END for t in places), sources, np.array([len(x) for x in ids], np.int32).tobytes(),
               np.concatenate(ids).tobytes(), np.concatenate(counts).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, CHUNK, strict=True)], schema=CHUNK)

    def split(batches):
        held: dict[str, tuple[list[str], list[bytes]]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sources, texts = held.setdefault(lang, ([], []))
                sources.append(source)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from (chunk(k, *v) for k, v in held.items())
                    held, size = {}, 0
        yield from (chunk(k, *v) for k, v in held.items())

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        split, "lang string, terms binary, sources array<string>, sizes binary, ids binary, counts binary")


def integers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int32).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


# --- bitmaps of bounded size ----------------------------------------------------------------------

def place(lang: str, key: bytes, bits: int) -> int:
    return zlib.crc32(key, zlib.crc32(lang.encode())) & ((1 << bits) - 1)


def bitmap(keys: DataFrame, most: int = BITMAP_LOG2) -> tuple[bytes, int]:
    """Bitmap of ``keys`` (lang, key) and the binary logarithm of its size: about 16 bits a key, up to ``most``.

    Tasks set bits in blocks, blocks are merged by a shuffle, and only the bitmap itself reaches the driver.
    """
    bits = min(most, max(BLOCK_LOG2, (16 * keys.count()).bit_length()))

    def mark(batches):
        blocks = defaultdict(lambda: np.zeros(1 << BLOCK_LOG2, bool))
        for batch in batches:
            for lang, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = place(lang, key, bits)
                blocks[at >> BLOCK_LOG2][at & ((1 << BLOCK_LOG2) - 1)] = True
        for block, marks in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "bits": [np.packbits(marks).tobytes()]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(1 << (BLOCK_LOG2 - 3), np.uint8)
        for batch in batches:
            for bits_of in batch.column("bits").to_pylist():
                whole |= np.frombuffer(bits_of, np.uint8)
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "bits": [whole.tobytes()]})

    marked = keys.select("lang", "key").mapInArrow(mark, "block bigint, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (BLOCK_LOG2 - 3)
    for row in marked.groupBy("block").applyInArrow(merge, "block bigint, bits binary").toLocalIterator():
        out[row.block * size:(row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes(), bits


def alive_in(marks: bytes, bits: int):
    """Test of (lang, key), memoised for the frequent ones."""
    known: dict[tuple[str, bytes], bool] = {}

    def test(lang: str, key: bytes) -> bool:
        found = known.get((lang, key))
        if found is None:
            if len(known) >= HELD:
                known.clear()
            at = place(lang, key, bits)
            found = known[lang, key] = bool(marks[at >> 3] & (128 >> (at & 7)))
        return found

    return test


# --- prefix refinement ----------------------------------------------------------------------------

def counted_prefixes(lists: DataFrame, length: int, marks: tuple[bytes, int] | None) -> DataFrame:
    """lang, key, n_docs: documents that hold a term beginning with ``key``, for all prefixes of ``length`` bytes whose
    first half is marked. A key that ends with ``END`` is a complete term."""
    half = length // 2

    def count(batches):
        test = alive_in(*marks) if marks else None
        for batch in batches:
            for lang, terms, sizes, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                prefixes: dict[bytes, int] = defaultdict(itertools.count().__next__)
                of_term = np.array([
                    prefixes[(t + END)[:length]] if test is None or len(t) >= half and test(lang, t[:half]) else -1
                    for t in terms.split(END)[:-1]], np.int64)      # shorter terms were complete at an earlier level
                if not prefixes:
                    continue
                sizes = integers(sizes)
                found = of_term[integers(ids)]
                keys = np.repeat(np.arange(len(sizes)) * len(prefixes), sizes) + found
                n_docs = np.bincount(distinct(keys[found >= 0]) % len(prefixes), minlength=len(prefixes))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(prefixes)), pa.array(list(prefixes), pa.binary()), pa.array(n_docs)],
                    ["lang", "key", "n_docs"])

    return (lists.select("lang", "terms", "sizes", "ids").mapInArrow(count, "lang string, key binary, n_docs bigint")
            .groupBy("lang", "key").agg(F.sum("n_docs").alias("n_docs")))


def kept_terms(lists: DataFrame, least_docs: int = LEAST_DOCS, first: int = FIRST_PREFIX) -> DataFrame:
    """lang, term of every term that stands in at least ``least_docs`` documents of its language."""
    complete = F.substring("key", -1, 1) == F.lit(END)
    kept, marks, length = None, None, first
    while True:
        level = keep(counted_prefixes(lists, length, marks).where(F.col("n_docs") >= least_docs), f"prefixes-{length}")
        done = level.where(complete).select("lang", F.expr("cast(substring(key, 1, length(key) - 1) as string)").alias("term"))
        kept = done if kept is None else kept.unionByName(done)
        going = level.where(~complete)
        if going.isEmpty():
            return keep(kept, "kept_terms")
        marks, length = bitmap(going), 2 * length


def term_counts(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences of the kept terms of a language in each of its sources."""
    marks = bitmap(kept.select("lang", F.col("term").cast("binary").alias("key")))

    def count(batches):
        test = alive_in(*marks)
        for batch in batches:
            for lang, terms, sources, sizes, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = sorted(set(sources))
                number = {name: i for i, name in enumerate(names)}
                of_term = terms.split(END)[:-1]
                alive = np.array([test(lang, t) for t in of_term], bool)
                ids = integers(ids)
                keep_it = alive[ids]
                source = np.repeat(np.array([number[x] for x in sources], np.int64), integers(sizes))
                keys = source[keep_it] * len(of_term) + ids[keep_it]
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], integers(counts)[keep_it][order]
                if not len(keys):
                    continue
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys, n = keys[first], np.add.reduceat(n, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(keys)), pa.array(names).take(pa.array(keys // len(of_term))),
                     pa.array(of_term, pa.binary()).take(pa.array(keys % len(of_term))).cast(pa.string()), pa.array(n)],
                    ["lang", "source", "term", "n"])

    return (lists.mapInArrow(count, "lang string, source string, term string, n bigint")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi"))


# --- frequencies and their differences ------------------------------------------------------------

def frequency(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), in decimals, so that no sum is too large."""
    return F.expr(
        f"1L + (cast({UNIT} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div "
        f"cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def block_distances(parts: DataFrame, places: int) -> DataFrame:
    """lang, a, b, f: sums of absolute differences over blocks of terms.

    ``parts``: a row per (lang, term block, pair of source blocks, source): at, first, size (terms of the block),
    p0 (frequency of a term that the source lacks), slots and ps (the others).
    """
    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["source_no"])
        size = rows[0]["size"]
        matrix = np.empty((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            matrix[i] = r["p0"]
            matrix[i, np.array(r["slots"], np.int64)] = r["ps"]
        numbers = np.array([r["source_no"] for r in rows])
        low, high = key[2].as_py(), key[3].as_py()
        left = np.flatnonzero(numbers // places == low)
        a, b, f = [], [], []
        for i in left:
            right = np.flatnonzero((numbers // places == high) & (numbers > numbers[i]))
            a += [int(numbers[i])] * len(right)
            b += numbers[right].tolist()
            f += np.abs(matrix[right] - matrix[i]).sum(axis=1).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(f, pa.int64())], ["lang", "a", "b", "f"])

    return (parts.groupBy("lang", "term_block", "low", "high")
            .applyInArrow(compare, "lang string, a bigint, b bigint, f bigint")
            .groupBy("lang", "a", "b").agg(F.sum("f").alias("f")))


def source_numbers(groups: DataFrame) -> DataFrame:
    """``groups`` with ``source_no`` from 0 within the language."""
    return groups.withColumn("source_no", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"))


def distances(counts: DataFrame, kept: DataFrame, groups: DataFrame,
              terms_at_once: int = TERM_BLOCK, sources_at_once: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, item (another source of the language), value: sum of absolute frequency differences.

    Terms are dealt out in blocks, sources in blocks too; a task compares two blocks of sources over one block of
    terms, in which a term that a source lacks has that source's least frequency. The rows returned are as many
    as pairs of sources. ``groups``: lang, source, total, n_terms, source_no.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms_at_once)).cast("bigint")
    vocabulary = kept.join(groups.select("lang", "n_terms").distinct(), "lang")
    slot = Window.partitionBy("lang", "term_block").orderBy("term")
    dealt = keep(vocabulary.withColumn("term_block", F.pmod(F.xxhash64("term"), blocks))
                 .select("lang", "term", "term_block", (F.row_number().over(slot) - 1).alias("slot"),
                         F.count(F.lit(1)).over(Window.partitionBy("lang", "term_block")).alias("size")), "dealt_terms")
    sizes = dealt.groupBy("lang", "term_block").agg(F.max("size").alias("size"))
    with_p = counts.join(groups, ["lang", "source"]).withColumn("p", frequency("n", "total", "n_terms"))
    vectors = (with_p.join(dealt, ["lang", "term"]).groupBy("lang", "term_block", "source_no")
               .agg(F.collect_list("slot").alias("slots"), F.collect_list("p").alias("ps")))   # a block of terms at most
    every = groups.where("n_terms > 0").withColumn("p0", frequency("0", "total", "n_terms")).join(sizes, "lang")
    full = every.join(vectors, ["lang", "term_block", "source_no"], "left")
    own = F.floor(F.col("source_no") / sources_at_once)
    last = F.floor((F.max("source_no").over(Window.partitionBy("lang", "term_block"))) / sources_at_once)
    paired = full.withColumn("own", own).withColumn("last", last).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    parts = paired.select(
        "lang", "term_block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "source_no", "size", "p0",
        F.coalesce("slots", F.array().cast("array<int>")).cast("array<bigint>").alias("slots"),
        F.coalesce("ps", F.array().cast("array<bigint>")).alias("ps"))
    found = block_distances(parts, sources_at_once)
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f"))
    named = groups.select("lang", "source", "source_no", "n_terms")
    # every pair is a row of the result, also where the language keeps no term
    pairs = named.where("n_terms = 0").alias("x").join(named.where("n_terms = 0").alias("y"), "lang").where(
        "x.source_no != y.source_no").select("lang", "x.source", F.col("y.source").alias("item"), F.lit(0).cast("bigint").alias("value"))
    return (both.join(named.select("lang", F.col("source_no").alias("a"), "source"), ["lang", "a"])
            .join(named.select("lang", F.col("source_no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
            .select("lang", "source", "item", F.col("f").alias("value")).unionByName(pairs))


def leading_terms(counts: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: terms more frequent in a source than in its language, the first ``most``."""
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    both = (counts.join(of_lang, ["lang", "term"]).join(groups, ["lang", "source"]).join(lang_total, "lang")
            .select("lang", "source", F.col("term").alias("item"),
                    (frequency("n", "total", "n_terms") - frequency("lang_n", "lang_total", "n_terms")).alias("value")))
    rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return both.where("value > 0").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how sources of a language differ in their use of terms.

    Reads lang, source and text; nulls in them count as ''. A document without terms, or an empty text, still makes its
    (lang, source) group occur; such a group has the least frequency for every term. Texts may be long; every
    row counts as a document, repeated rows too. Ties rank by the item's bytes. Other columns are ignored. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    lists = keep(term_lists(docs), "term_lists")
    kept = kept_terms(lists, least_docs)
    counts = keep(term_counts(lists, kept), "term_counts")
    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = lists.select("lang", F.explode(F.array_distinct("sources")).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left").na.fill(0)
    groups = keep(source_numbers(groups), "groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = distances(counts, kept, groups).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    term = leading_terms(counts, groups, most).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


SQL = rf"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (
  select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (
  select lang, term, count(*) over (partition by lang) as v from w group by lang, term having count(distinct i) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
c as (select lang, source, term, v, count(w.i) as n
  from g join kept using (lang) left join w using (lang, source, term) group by all),
p as (
  select *, 1 + ({UNIT}::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p,
    1 + ({UNIT}::hugeint * (sum(n) over (partition by lang, term) + 5)) // (sum(n) over (partition by lang) + 5 * v) as q
  from c),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source != b.source
    left join p x on x.lang = a.lang and x.source = a.source
    left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
terms as (
  select lang, source, term as item, (p - q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
  row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from pairs
union all
select lang, source, 'term', item, value,
  row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from terms
qualify rank <= {TOP_TERMS}"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
