"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if its text stood earlier, or if an earlier line lies within ``THRESHOLD`` edits (insertion,
deletion or substitution of a code point). Earlier means by document, then by place. Edits are allowed
where the longer of two lines has ``MIN_CHARS`` code points; shorter lines go if they are equal.

1. Equal lines meet by digest; from here on a text is one node, placed where it first stood.
2. A line of length l is cut into THRESHOLD + 1 segments. Of two lines within the threshold, the longer
   one holds a segment of the other, at a place that the difference of the lengths bounds. So every
   line yields keys (length, segment number, text of the segment): its own segments as index, and the
   substrings at all such places, for all lengths it may meet, as probes.
3. Keys met by one text only are dropped from counts that are combined before the shuffle. What is joined
   after that are narrow rows (key, node); texts are fetched for nodes with a shared key only.
4. On each key a text is first compared with the earliest text there. If that is near, it is the earliest near one,
   and a family of any number of near copies costs one comparison each. Texts that are not near it look through
   the others, packed ``PACK`` to a row, where the key has up to ``FEW`` texts. Where it has more, the rest of each
   line, without the segment, must still be within the threshold; it is cut and keyed again, up to ``LEVELS`` times.
   Links are counted, not listed, in the packs of keys with up to ``FEW`` texts, each at the least such key that both
   texts have; links of texts that share larger keys only are listed.
5. Spark's bounded Levenshtein distance passes over pairs that cannot be near. The others are verified by a banded
   bit-parallel edit distance: one integer holds the band of 2 * THRESHOLD + 1 cells around the diagonal, and a
   fold over the characters advances it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import bounded, keep, table, unused

THRESHOLD = 2
MIN_CHARS = 30       # code points from which the longer of two lines allows edits; shorter lines meet by digest only
PACK = 256           # texts of a key that are looked through at once
FEW = 4_096          # texts on a key up to which packs are looked through; with more the key is cut again
LEVELS = 5


# ---- keys -----------------------------------------------------------------------------------------

def bound_to(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def key_kinds(threshold: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other text is, segment, shift of the segment) of all keys of a text."""
    return [(shorter, i, shift) for shorter in range(threshold + 1) for i in range(threshold + 1)
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1)]


def with_keys(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``rows`` (``rest``, ``base`` and others), once per key of ``rest`` under ``base``: key, is_index, start, size.

    The keys of a text's own segments are its index; they probe its own length too. A key whose segment
    would not lie inside the text is left out.
    """
    kinds = F.array(*[F.struct(F.lit(s).alias("shorter"), F.lit(i).alias("i"), F.lit(d).alias("shift"))
                      for s, i, d in key_kinds(threshold)])
    parts = threshold + 1
    spread = rows.withColumns({"n": F.length("rest"), "bytes": F.col("rest").cast("binary")}).select("*", F.inline(kinds))
    length = F.col("n") - F.col("shorter")
    small = F.floor(length / parts).cast("int")
    # the last segments are longer by one where the length does not divide evenly
    over = length - small * parts - (parts - F.col("i"))
    spread = spread.where("n >= shorter").withColumns({
        "start": small * F.col("i") + 1 + F.greatest(F.lit(0), over) + F.col("shift"),
        "size": small + F.when(over >= 0, 1).otherwise(0)})
    # bytes are as quick to cut at any place; they are code points where there are as many
    segment = F.when(F.length("bytes") == F.col("n"), F.substring("bytes", F.col("start"), F.col("size"))).otherwise(
        F.substring("rest", F.col("start"), F.col("size")).cast("binary"))
    return spread.where("start >= 1 and start + size - 1 <= n").select(
        *rows.columns, F.xxhash64("base", F.col("n") - F.col("shorter"), "i", segment).alias("key"),
        ((F.col("shorter") == 0) & (F.col("shift") == 0)).alias("is_index"), "start", "size")


def live_keys(keyed: DataFrame) -> DataFrame:
    """The keys that different texts share, one of them as index and one of them ``asked`` (all are where there is
    no such column).

    Least and greatest number say whether there are two; both are combined before the shuffle.
    """
    two = [F.min("number").alias("least"), F.max("number").alias("most"), F.max("is_index").alias("has_index")]
    if "asked" in keyed.columns:
        return keyed.groupBy("key").agg(*two, F.max("asked").alias("asked")).where("least != most and has_index and asked").select("key")
    return keyed.groupBy("key").agg(*two).where("least != most and has_index").select("key")


# ---- the join -------------------------------------------------------------------------------------

def near_pairs(lines: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, min_chars: int = 0,
               few: int = FEW, levels: int = LEVELS, links: list | None = None) -> DataFrame:
    """x, y: an earlier node y within the threshold for every node x that has one; the earliest is among them.

    ``links`` takes a table of node, n_links (the nodes within the threshold, earlier or later) and link (their
    earliest place), some rows per node, to be added up.

    ``lines``: node and text, repeats included; ``firsts``: node and first, its place, for all nodes. Of a pair the
    longer text must have ``min_chars`` code points. The last level looks through all texts that are left on a key.
    """
    rows = lines.select("node", F.xxhash64("text").alias("number"), F.col("text").alias("rest"),
                        F.lit(0).cast("bigint").alias("base"))
    found, texts, listed = None, None, None
    for level in range(levels):
        keyed = with_keys(rows, threshold).drop("base")
        live = bounded(keep(live_keys(keyed), "live"))
        narrow = keyed.drop("number", "is_index", *(["rest"] if level == 0 else []))
        met = keep(narrow.join(live, "key").distinct(), "met")
        if level == 0:
            met = met.withColumn("asked", F.lit(True))
        if level == 0:
            nodes = keep(met.select("node").distinct(), "nodes")
            texts = keep(lines.select("node", "text").join(bounded(nodes), "node", "left_semi").groupBy("node").agg(
                F.first("text").alias("text")).withColumn("size", F.length("text")).join(firsts.select("node", "first"), "node"), "line-texts")
        members = keep(met.groupBy("key", "node").agg(F.max("asked").alias("asked")).join(texts, "node"), "members")

        groups = members.groupBy("key").agg(F.min(F.struct("first", "node")).alias("pivot"), F.count(F.lit(1)).alias("n"))
        tried = members.where("asked").join(groups, "key").where(F.col("pivot.node") != F.col("node"))
        tried = keep(tried.select("key", "n", F.col("node").alias("x"), "first", F.col("text").alias("x_text"), "size",
                                  F.col("pivot.node").alias("y")), "tried")
        y_text = texts.select(F.col("node").alias("y"), F.col("text").alias("y_text"))
        near = keep(verified(tried.select("x", "y", "x_text").distinct().join(y_text, "y"), threshold, min_chars), "near")
        found = near if found is None else found.union(near)

        far = tried.join(near, ["x", "y"], "left_anti")
        if links is not None:       # of texts that share a large key all pairs are wanted
            far = far.where(F.col("n") <= few).union(tried.where(F.col("n") > few).select(*far.columns)) if level == 0 else tried
        left = keep(far.where("n > 2").select("key", "n", "x", "first", "x_text", "size"), "left")
        last = level == levels - 1
        pairs = packed_pairs(left if last else left.where(F.col("n") <= few), members, threshold, min_chars)
        packs = keep(verified(pairs, threshold, min_chars), "near")
        found = found.union(packs)
        if links is not None:
            if level == 0:
                alike = keep(members.join(groups.where(F.col("n") <= few).select("key", "n"), "key"), "alike")
                shared = keep(alike.groupBy("node").agg(F.collect_set("key").alias("keys")), "shared-keys")
                links.append(keep(counted_links(alike.join(shared, "node"), threshold, min_chars), "links"))
                listed = near.join(tried.where(F.col("n") > few).select("x", "y").distinct(), ["x", "y"], "left_semi")
                listed = listed.union(packs) if last else listed
            else:
                listed = listed.union(near).union(packs)
        if last:
            break
        many = left.where(F.col("n") > few)
        asked = many.select("key", F.col("x").alias("node"), F.lit(True).alias("left")).distinct()
        again = met.join(many.select("key").distinct(), "key", "left_semi").join(asked, ["key", "node"], "left")
        rest = F.col("rest")
        if level == 0:
            again, rest = again.join(texts.select("node", "text"), "node"), F.col("text")
        cut = F.concat(F.substring(rest, F.lit(1), F.col("start") - 1),
                       F.substring(rest, F.col("start") + F.col("size"), F.length(rest)))
        rows = keep(again.select("node", F.xxhash64("node").alias("number"), cut.alias("rest"), F.col("key").alias("base"),
                                 F.coalesce("left", F.lit(False)).alias("asked")).distinct(), "split")
        if rows.isEmpty():
            break
    if links is not None:
        links.append(listed_links(listed.distinct(), shared, firsts))
    return found


def counted_links(alike: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """node, n_links, link: the members of a key that are near, where no lesser key of ``keys`` is in common.

    ``alike``: the members of the keys that are looked through, with the number n of them and all such keys of a node.
    """
    packs = alike.withColumn("pack", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PACK))).groupBy("key", "pack").agg(
        F.collect_list(F.struct("first", "node", "text", "size", "keys")).alias("texts"))     # about PACK of them
    asked = alike.select("key", "node", "text", "size", "keys", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.ceil(F.col("n") / PACK) - 1)).alias("pack"))

    def is_near(m: Column) -> Column:
        return ((F.abs(m["size"] - F.col("size")) <= threshold) & ((m["size"] >= min_chars) | (F.col("size") >= min_chars))
                & (m["node"] != F.col("node")) & (F.levenshtein(F.col("text"), m["text"], threshold) >= 0)
                & (F.array_min(F.array_intersect(m["keys"], F.col("keys"))) == F.col("key")))

    near = F.transform(F.filter("texts", is_near), lambda m: m["first"])
    return (asked.join(packs, ["key", "pack"]).select("node", near.alias("near")).where(F.size("near") > 0)
            .groupBy("node").agg(F.sum(F.size("near")).alias("n_links"), F.min(F.array_min("near")).alias("link")))


def listed_links(pairs: DataFrame, shared: DataFrame, firsts: DataFrame) -> DataFrame:
    """node, n_links, link from the verified pairs x, y that have no key of ``shared`` in common."""
    x, y = (shared.select(F.col("node").alias(c), F.col("keys").alias(f"{c}_keys")) for c in "xy")
    apart = pairs.join(x, "x", "left").join(y, "y", "left").where(
        ~F.coalesce(F.arrays_overlap("x_keys", "y_keys"), F.lit(False))).select("x", "y")
    both = apart.union(apart.select("y", "x")).toDF("node", "other")
    return both.join(firsts.select(F.col("node").alias("other"), F.col("first").alias("link")), "other").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"), F.min("link").alias("link"))


def packed_pairs(left: DataFrame, members: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """x, y, x_text, y_text: for the texts of ``left`` the earlier members of their key that may be near.

    Members are dealt into packs, and a text meets each pack of its key as one row.
    """
    sizes = left.select("key", F.ceil(F.col("n") / PACK).alias("packs")).distinct()
    number = F.pmod(F.xxhash64("node"), F.col("packs"))
    packs = members.join(sizes, "key").groupBy("key", number.alias("pack")).agg(
        F.collect_list(F.struct("first", "node", "text", "size")).alias("texts"))     # about PACK of them
    asked = left.select("key", "x", "first", "x_text", "size", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.ceil(F.col("n") / PACK) - 1)).alias("pack"))

    def may_be_near(m: Column) -> Column:
        return ((F.abs(m["size"] - F.col("size")) <= threshold) & ((m["size"] >= min_chars) | (F.col("size") >= min_chars))
                & (m["first"] < F.col("first")) & (F.levenshtein(F.col("x_text"), m["text"], threshold) >= 0))

    hits = asked.join(packs, ["key", "pack"]).select("x", "x_text", F.explode(F.filter("texts", may_be_near)).alias("m"))
    return hits.select("x", F.col("m.node").alias("y"), "x_text", F.col("m.text").alias("y_text")).distinct()


# ---- verification ---------------------------------------------------------------------------------

def possible(x: Column, y: Column, threshold: int, min_chars: int) -> Column:
    """Whether two texts can be near: a quick test before the verification."""
    return (F.greatest(F.length(x), F.length(y)) >= min_chars) & (F.levenshtein(x, y, threshold) >= 0)


def verified(pairs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """The pairs x, y (with x_text, y_text) within the threshold, the longer text of ``min_chars`` code points or more."""
    x, y = F.col("x_text"), F.col("y_text")
    return pairs.where(possible(x, y, threshold, min_chars)).where(within(x, y, threshold)).select("x", "y")


def within(x: Column, y: Column, threshold: int = THRESHOLD) -> Column:
    """Whether two texts are within ``threshold`` edits.

    At column j, counted from 0, bit k of the band stands for the row j + k - threshold. Per column, matches
    of the character with the rows of the band give the diagonal zeros; the vertical differences of the
    band follow with the usual additions and shifts. The score is followed down the band's lowest
    diagonal, then along the last column to the last row.
    """
    width = 2 * threshold + 1
    n, m = F.length(x), F.length(y)                  # rows, columns
    padding = F.array_repeat(F.lit(""), threshold)   # never equal to a character
    rows = F.concat(padding, F.split(x, ""), F.array_repeat(F.lit(""), width + threshold))

    def number(value: int) -> Column:
        return F.lit(value).cast("bigint")

    mask = number((1 << width) - 1)

    def matches(rows: Column):
        """Bits of the band's rows that hold the character of column j."""
        def bits(char: Column, j: Column) -> Column:
            out = number(0)
            for k in range(width):
                out = out + F.when(F.get(rows, j + k) == char, number(1 << k)).otherwise(number(0))
            return out
        return bits

    def step(state: Column, eq: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def advanced(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)))
            down = F.shiftright(d0, 1)
            return F.struct(
                d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (state["score"] + F.when(d0 >= 1 << (width - 1), 0).otherwise(1)).alias("score"))

        # Diagonal zeros: a match, or a vertical decrease carried down the column.
        carried = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        return bound_to(carried.bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(mask), advanced)

    # Above the first row the band counts the columns: the rows below it start increasing.
    start = F.struct(number((1 << width) - (1 << threshold)).alias("vp"), number(0).alias("vn"), F.lit(threshold).alias("score"))

    def finished(state: Column) -> Column:
        """From the band's lowest row, m + threshold, up to row n; bit k is now of row m + k - threshold + 1."""
        score = state["score"]
        for k in range(width - 2, -1, -1):
            below = m + (k - threshold + 1) > n
            drop = (F.when(state["vp"].bitwiseAND(number(1 << k)) != 0, 1)
                    .when(state["vn"].bitwiseAND(number(1 << k)) != 0, -1).otherwise(0))
            score = score - F.when(below, drop).otherwise(0)
        return score

    bits = bound_to(rows, lambda r: F.transform(F.split(y, ""), matches(r)))
    distance = bound_to(F.aggregate(bits, start, step), finished)
    return F.when(F.abs(n - m) > threshold, False).when((n == 0) | (m == 0), True).otherwise(distance <= threshold)


# ---- lines ----------------------------------------------------------------------------------------

def lines_of(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, line_no (from 0), text, node (digest) of all lines that are not empty."""
    return (docs.select("row_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
            .where("text != ''").withColumn("node", F.unhex(F.md5("text"))))


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"),
                    F.col("row_no").alias("row_no"), F.col("line_no").cast("bigint").alias("line_no"))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, links: bool = False) -> DataFrame:
    """One row per line that is not empty: row_no, doc_id, line_no, the place where its text first stood
    (class_doc_id, class_line_no), the place of the earliest other text within the threshold that stood before
    that (near_doc_id, near_line_no, null without one), kept. With ``links`` also n_links, the other texts within the
    threshold, wherever they stood, and the earliest place of those (link_doc_id, link_line_no, null without links).

    Edits are allowed between two lines of which the longer has ``min_chars`` code points. ``docs`` holds row_no
    (unique, the same on every read), doc_id and text. Null and empty texts have no lines. Rows are in the order of
    doc_id, null ids last, then row_no; of repeated rows the first keeps its lines. A line may be as long as its text.
    """
    lines = lines_of(docs)
    narrow = keep(lines.select("row_no", "doc_id", "line_no", "node"), "lines", "snappy")
    firsts = keep(narrow.groupBy("node").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    compared = lines.where(F.length("text") >= min_chars - threshold)
    counts: list[DataFrame] | None = [] if links else None
    pairs = near_pairs(compared.select("node", "text"), firsts, threshold, min_chars, links=counts)
    there = firsts.select(F.col("node").alias("y"), F.col("first").alias("there"))
    near = pairs.distinct().join(there, "y").groupBy(F.col("x").alias("node")).agg(F.min("there").alias("near"))

    known = firsts.join(near, "node", "left").where("copies > 1 or near is not null").select("node", "first", "near")
    rows = narrow.join(known, "node", "left").withColumn("here", place())
    more = []
    if counts:
        linked = counts[0].unionByName(counts[1]).groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("link").alias("link"))
        rows = rows.join(linked, "node", "left")
        more = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("link.doc_id").alias("link_doc_id"),
                F.col("link.line_no").alias("link_line_no")]
    first = F.coalesce("first", "here")
    return rows.select(
        "row_no", "doc_id", "line_no",
        first["doc_id"].alias("class_doc_id"), first["line_no"].alias("class_line_no"),
        F.col("near.doc_id").alias("near_doc_id"), F.col("near.line_no").alias("near_line_no"),
        ((F.col("here") == first) & F.col("near").isNull()).alias("kept"), *more)


def without_repeated_lines(docs: DataFrame, row_column: str, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS,
                           changed: str = "__lines_gone") -> DataFrame:
    """``docs`` (doc_id, text, a unique row number and any columns) without the lines that ``line_classes`` does
    not keep, and with a column ``changed``, how many those are.

    A document that loses all its lines goes; one that lost none, also an empty or null text, is as before.
    """
    rows = docs.select(F.col(row_column).alias("row_no"), "doc_id", "text")
    row, gone = unused(docs, "__row"), unused(docs, "__gone")
    dropped = (line_classes(rows, threshold, min_chars).where(~F.col("kept"))
               .groupBy(F.col("row_no").alias(row)).agg(F.collect_list("line_no").alias(gone)))
    dropped = bounded(keep(dropped, "dropped-lines"), 100_000)
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    marked = docs.join(dropped, F.col(row_column) == F.col(row), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return (marked.where(F.col(gone).isNull() | (F.size(left) > 0))
            .select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                    F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(changed)))


SQL = """
with lines as (
  select doc_id, generate_subscripts(parts, 1) - 1 as line_no, unnest(parts) as text
  from (select doc_id, string_split(text, chr(10)) as parts from documents)),
l as (select * from lines where text <> ''),
firsts as (select text, min({'d': doc_id, 'n': line_no}) as first from l group by text),
links as (
  select a.text, a.first, b.first as there from firsts a join firsts b
  on a.text <> b.text and length(b.text) between length(a.text) - 2 and length(a.text) + 2
    and greatest(length(a.text), length(b.text)) >= 30 and levenshtein(a.text, b.text) <= 2),
near as (
  select text, count(*) as n_links, min(there) as link, min(there) filter (where there < first) as near
  from links group by text)
select doc_id, cast(line_no as integer) as line_no, first.d as class_doc_id, cast(first.n as bigint) as class_line_no,
  near.d as near_doc_id, cast(near.n as bigint) as near_line_no,
  first.d = doc_id and first.n = line_no and near is null as kept,
  coalesce(n_links, 0) as n_links, link.d as link_doc_id, cast(link.n as bigint) as link_line_no
from l join firsts using (text) left join near using (text)"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    return line_classes(rows, links=True).drop("row_no")
