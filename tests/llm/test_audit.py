"""Source divergence, Merkle manifest and quality classifier against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from touchline.llm import divergence, merkle, quality
from touchline.llm.storage import prepare, table

FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


# --- Merkle manifest -------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, source, lang, n_chars, _ = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_manifest(rows, changed):
    """(id, leaf) -> subroot, root, proof, folded root."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def up(tree, at, node):
        siblings = ""
        for level in tree[:-1]:
            run, slot = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
            siblings += "".join(run[:slot] + run[slot + 1:])
            node = sha("".join(run[:slot] + [node] + run[slot + 1:]))
            at //= 16
        return siblings, node

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row, leaf_of(row, row[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = levels([leaf for _, leaf in groups[name]])
    top = levels([trees[n][-1][0] for n in names])
    found = []
    for k, name in enumerate(names):
        for at, (row, leaf) in enumerate(groups[name]):
            low, node = up(trees[name], at, leaf_of(row, changed(row)))
            high, node = up(top, k, node)
            found.append((row[0], leaf, trees[name][-1][0], top[-1][0], sha(low + high), node, node == top[-1][0]))
    return found


def manifest_rows():
    rows = [(i, "big", "en", 3, f"Text {i} É") for i in range(1, 5000)]                     # over three units deep
    rows += [(i, f"s{i % 21}", None, None, None if i % 3 else "") for i in range(5000, 5300)]
    rows += [(None, None, "x", 1, "A"), (7, None, "x", 1, "AA"), (7, "alone", "x", 1, "AB")]
    rows += [(9, "", None, 2, "Repeated")] * 20 + [(9, "", None, 2, "Again")] * 3
    return rows


def test_manifest_by_plain_hashing(spark):
    rows = manifest_rows()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("x") for c in ("key", "pos", "n", "digest", "id", "path", "row_no")})
    lowered = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    found = merkle.manifest(docs.repartition(7), changes={"text": lowered}).collect()
    want = plain_manifest(rows, lambda r: r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4])
    order = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert not all(r.verified for r in found) and any(r.verified for r in found)


def test_manifest_of_text_ids_without_changes(spark):
    docs = spark.createDataFrame([("b", "x" * 3_000_000), ("a", None)], "name string, body string").withColumn("site", F.lit(1))
    found = merkle.manifest(docs, ["name", "body"], id_column="name", group_column="site").collect()
    assert [r.verified for r in found] == [True, True] and len({r.root for r in found}) == 1
    assert {r.name: r.leaf for r in found} == {"a": sha("1:a-"), "b": sha("1:b3000000:" + "x" * 3_000_000)}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], FIELDS)).collect() == []


def test_parent_resumes_the_state_of_a_slot():
    children = [hashlib.sha256(bytes([i])).digest() for i in range(16)]
    parent = merkle.Parent(children)
    for slot in range(16):
        new = hashlib.sha256(b"new").digest()
        assert parent.fold(slot, new) == merkle.Parent(children[:slot] + [new] + children[slot + 1:]).digest
        assert parent.fold(slot, children[slot]) == parent.digest


# --- source divergence -----------------------------------------------------------------------------

def plain_divergence(rows, least, most):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = word.findall((text or "").translate(low))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def table(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: table(counts[lang, s]) for s in sources}
        q = table(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def divergence_rows(seed=3):
    pick = random.Random(seed)
    words = ["the", "Thé", "thing", "t", "éa", "日本語", "Z" * 300, "z" * 299, "a", "ab", "abc", "abcd", "abcde", "x²"]
    rows = [(pick.choice(["en", "de", None]), f"s{pick.randrange(9)}", "0".join(pick.choices(words, k=pick.randrange(9)))) for _ in range(300)]
    return rows + [("fr", "a", ""), ("fr", None, None), ("fr", "b", "rare"), ("en", "empty", "12 _ @"), (None, "s1", "the @[`{ the")]


def found_divergence(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {c: F.lit("x") for c in ("term", "total", "n", "key", "doc_id")})
    return sorted(map(tuple, divergence.divergence(docs.repartition(5), **how).collect()))


def test_divergence_by_plain_counts(spark):
    rows = divergence_rows()
    assert found_divergence(spark, rows, least_docs=20, most=3) == plain_divergence(rows, 20, 3)


def test_divergence_in_small_blocks_and_with_a_full_bitmap(spark, monkeypatch):
    rows = divergence_rows(5)
    monkeypatch.setattr(divergence, "bitmap", lambda keys: (b"\xff" * 4096, 15))   # lets every prefix through
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 100)
    monkeypatch.setattr(divergence.distances, "__defaults__", (2, 2))
    assert found_divergence(spark, rows, least_docs=10) == plain_divergence(rows, 10, 50)


def test_divergence_of_nothing(spark):
    assert found_divergence(spark, []) == []
    assert found_divergence(spark, [(None, None, None)]) == []


def test_prefixes_below_the_threshold_go_no_further(spark):
    docs = spark.createDataFrame([("en", "s", "abcdefgh" if i % 2 else f"ab{chr(97 + i % 26)}{chr(97 + i // 26)}xyz") for i in range(60)],
                                 "lang string, source string, text string")
    lists = divergence.term_lists(docs)
    second = divergence.counted_prefixes(lists, 2, None).where("n_docs >= 30")
    marks = divergence.bitmap(second.where("key != cast('zz' as binary)"))
    keys = {bytes(r.key): r.n_docs for r in divergence.counted_prefixes(lists, 4, marks).collect()}
    assert keys[b"abcd"] == 30 and max(n for k, n in keys.items() if k != b"abcd") < 30
    assert [r.term for r in divergence.kept_terms(lists).collect()] == ["abcdefgh"]


# --- quality ---------------------------------------------------------------------------------------

def test_quality_of_held_out_rows(spark, query):
    sf = "/root/testdata/sf0.1"
    found = query["op13_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = found.where("held_out")
    assert held.where("quality = predicted").count() >= 0.98 * held.count()
    assert held.where("quality = 1 and predicted = 1").count() >= 0.99 * held.where("quality = 1").count()
    assert found.where("score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0


def test_quality_of_odd_rows(spark):
    prepare(spark)
    pick = random.Random(2)
    good = lambda: " ".join(pick.choices("a few plain words make this line".split(), k=30)) + "."
    rows = [(i, good() if i % 2 else "$$ ## " * 20, "x") for i in range(200)] + [(None, None, "x"), (300, "", "x"), (301, "w " * 600_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").withColumn("share", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(None, 1), (5, None), (300, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    found = docs.select("doc_id", quality.scored(docs, model).alias("f")).select("doc_id", "f.*").collect()
    assert len(found) == 203 and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 200)
    assert model.scores(np.zeros((0, len(quality.FEATURES)))).shape == (0,)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert docs.select(quality.scored(docs, model).alias("f")).first().f.score == 0.5
    none = docs.where("false")
    assert none.select(quality.scored(none, model).alias("f")).collect() == []


def test_scores_are_sums_of_table_entries(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    rows = np.array([quality.features(r.text) for r in docs.limit(40).collect()])
    for row, score in zip(rows, model.scores(rows), strict=True):
        bins = [sum(x >= b for b in borders) for x, borders in zip(row, model.borders, strict=True)]
        z = model.intercept + sum(t[b] for t, b in zip(model.singles, bins, strict=True))
        for i, j, t in model.pairs:
            z += t[bins[i] * quality.PAIR_BINS // len(model.singles[i]), bins[j] * quality.PAIR_BINS // len(model.singles[j])]
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert len(model.pairs) == quality.PAIRS


def test_features_of_slices_equal_those_of_the_whole(monkeypatch):
    text = "A line, A line.\n\nÄöü 12 $ x x x\t y" * 50
    whole = quality.features(text)
    monkeypatch.setattr(quality, "SLICE", 17)
    assert quality.features(text) == pytest.approx(whole)
    words = text.lower().split()
    assert whole[quality.FEATURES.index("repeated_next")] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)
