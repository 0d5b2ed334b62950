"""Exact, near and line dedup against plain Python on small and odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, duck
from touchline.llm import components, exact_dedup, line_dedup, near_dedup
from touchline.llm.registry import ORACLES
from touchline.llm.storage import prepare
from touchline.llm.words import word_hashes


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op1_line_dedup", "op2_chat_format"])
def test_queries_match_sql(spark, sf, query, name):
    assert compare(query[name](spark, sf), duck(sf), ORACLES[name]).startswith("ok")


def test_exact_groups_of_odd_rows(spark, docs_of):
    docs = docs_of([(5, "a b"), (3, "ab"), (4, "a\tb\n"), (9, None), (7, " "), (None, ""), (2, "x"), (2, "x"), (8, "é")],
                   "keep_id", "digest")
    rows = exact_dedup.exact_groups(docs, support=0.2).collect()
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == [(-1, 7, 3, False), (2, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True),
                   (5, 4, 3, False), (7, 7, 3, True), (8, 8, 1, True), (9, 7, 3, False)]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_groups_with_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    for support in (0.001, 0.9):     # settled on the map side, or by the shuffle
        rows = exact_dedup.exact_groups(docs, support=support)
        assert rows.where("kept").count() == 4001
        assert rows.where("keep_id = 0").count() == 2000


def brute_classes(texts, threshold=0.8):
    docs = [set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w := re.findall(r"\w+", t.lower())) >= 5 else {tuple(w)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(docs):
        for j in range(i):
            if a | docs[j] and a != {()} and len(a & docs[j]) / len(a | docs[j]) >= threshold:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def near_texts():
    """Families of copies with edits far from the threshold, in equal shares of one vocabulary."""
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for family in range(12):
        base = random.choices(vocabulary, k=200)
        for _ in range(1 + family):
            copy = list(base)
            copy[random.randrange(200)] = "changed"
            texts.append(" ".join(copy))
    return texts + [" ".join(random.choices(vocabulary, k=50)) for _ in range(30)]


def test_near_groups_match_brute_force(spark, docs_of):
    prepare(spark)
    texts = near_texts()
    rows = near_dedup.near_groups(docs_of(list(enumerate(texts)), "class", "words")).collect()
    brute = brute_classes(texts)
    smallest = {r: min(i for i, x in enumerate(brute) if x == r) for r in brute}
    assert {r.doc_id: r.class_id for r in rows} == {i: smallest[r] for i, r in enumerate(brute)}
    assert sum(r.kept for r in rows) == len(smallest)


def test_near_groups_of_odd_rows(spark, docs_of):
    prepare(spark)
    long = "one two three four five six " * 30_000
    rows = near_dedup.near_groups(docs_of([(4, None), (5, ""), (6, "?!"), (3, "One two."), (2, "one TWO"), (1, long), (0, long + "seven"),
                                           (8, "same words here"), (8, "same words here"), (None, "one two")])).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.class_size, r.kept) for r in rows)
    assert got == [(-1, 2, 3, False), (0, 0, 2, True), (1, 0, 2, False), (2, 2, 3, True), (3, 2, 3, False), (4, 4, 1, True),
                   (5, 5, 1, True), (6, 6, 1, True), (8, 8, 2, False), (8, 8, 2, True)]
    assert near_dedup.near_groups(docs_of([(1, "x")]).limit(0)).count() == 0


def test_links_beyond_the_pivot_are_found(spark, docs_of):
    """A chain of edited copies: neighbours resemble each other, the ends do not."""
    prepare(spark)
    random.seed(9)
    words = [f"c{i}" for i in range(150)]
    texts = []
    for step in range(40):
        words = list(words)
        words[(step * 7) % 150] = f"n{step}"
        texts.append(" ".join(words))
    rows = near_dedup.near_groups(docs_of(list(enumerate(texts)))).collect()
    assert {r.class_id for r in rows} == {0}


def test_samples_estimate_the_similarity():
    a, b = (" ".join(f"t{i}" for i in range(s, s + 400)) for s in (0, 40))
    import numpy as np
    idf = np.random.default_rng(1).uniform(1, 9, 1 << near_dedup.BUCKETS_LOG2).astype(np.float32)
    x, y = (near_dedup.weighted_shingles(w, idf) for w in word_hashes([a, b]))
    exact = near_dedup.similarity(x, y)
    assert 0.75 < exact < 0.9
    same = sum(p == q for p, q in zip(near_dedup.band_keys(*x), near_dedup.band_keys(*y), strict=True))
    assert 0 < same < near_dedup.BANDS


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (2, 1)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}
    assert found == expected
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, n):
    out = list(text)
    for _ in range(n):
        at = random.randrange(len(out) + 1)
        out[at:at + random.randint(0, 1)] = random.choice(["", "b", "é", "🙂"])
    return "".join(out)


def test_edit_distance(spark):
    random.seed(3)
    rows = []
    for _ in range(400):
        a = "".join(random.choices("abcdé", k=random.randint(0, 40)))
        rows.append((a, edited(a, random.randint(0, 4))))
    for threshold in (1, 2, 3):
        found = spark.createDataFrame(rows, "a string, b string").select(
            "a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("w"), line_dedup.possible(F.col("a"), F.col("b"), threshold, 0).alias("p"))
        for r in found.collect():
            real = distance(r.a, r.b) <= threshold
            assert r.w == real and (r.p or not real), (r.a, r.b)


def placed_lines(spark, texts):
    """Lines in the given order, each once, and their places."""
    lines = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string").select(
        "i", F.unhex(F.md5("text")).alias("node"), "text")
    return lines.select("node", "text"), lines.select("node", F.struct(F.col("i").alias("i")).alias("first"))


@pytest.fixture(autouse=True)
def small_packs(monkeypatch):
    monkeypatch.setattr(line_dedup, "PACK", 7)


def earliest_near(spark, texts, **how):
    lines, firsts = placed_lines(spark, texts)
    names = firsts.select("node", F.col("first.i").alias("i"))
    pairs = line_dedup.near_pairs(lines.union(lines), firsts, **how)
    found = (pairs.join(names.toDF("x", "i"), "x").join(names.toDF("y", "j"), "y").groupBy("i").agg(F.min("j").alias("j")).collect())
    return {r.i: r.j for r in found}


@pytest.mark.parametrize("few", [4, 1000])
def test_the_earliest_near_line_is_found(spark, few):
    random.seed(6)
    base = "".join(random.choices("abcdefgh", k=50))
    texts = list({edited(base, random.randint(0, 3)) for _ in range(40)} | {"".join(random.choices("abcdefgh", k=40)) for _ in range(20)})
    random.shuffle(texts)
    want = {i: next((j for j in range(i) if distance(texts[j], a) <= 2), None) for i, a in enumerate(texts)}
    assert earliest_near(spark, texts, few=few, levels=2) == {i: j for i, j in want.items() if j is not None}


@pytest.mark.parametrize("levels", [3])
def test_lines_of_one_template(spark, levels):
    """Many lines share most of their text; few are near each other."""
    random.seed(8)
    texts = list({f"The number of the request that was served is {random.randrange(10**6):06d}, and that is all of it." for _ in range(80)})
    want = {i: next((j for j in range(i) if distance(texts[j], a) <= 2), None) for i, a in enumerate(texts)}
    assert earliest_near(spark, texts, few=4, levels=levels) == {i: j for i, j in want.items() if j is not None}


def test_a_family_of_near_copies_costs_one_comparison_each(spark, monkeypatch):
    base = "This line stands in very many documents, each time with another sign: "
    texts = [base + chr(0x4E00 + i) for i in range(400)]
    compared = []
    verified = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(line_dedup, "packed_pairs", lambda left, *a: compared.append(left.count()) or left.selectExpr("x", "x as y", "x_text", "x_text as y_text").limit(0))
    assert earliest_near(spark, texts) == dict.fromkeys(range(1, 400), 0)
    assert sum(compared) < 1000


@pytest.mark.parametrize("few", [4, 12, 1000])
def test_all_links_are_counted(spark, few):
    random.seed(21)
    base = "".join(random.choices("abcdefgh", k=36))
    texts = list({edited(base, random.randint(0, 3)) for _ in range(40)} | {base[:-1] + chr(0x4E00 + i) for i in range(20)}
                 | {"".join(random.choices("abcdefgh", k=30)) for _ in range(5)})
    random.shuffle(texts)
    near = {i: [j for j, b in enumerate(texts) if j != i and distance(a, b) <= 2] for i, a in enumerate(texts)}
    lines, firsts = placed_lines(spark, texts)
    links = []
    line_dedup.near_pairs(lines.union(lines), firsts, few=few, levels=2, links=links)
    rows = links[0].unionByName(links[1]).groupBy("node").agg(F.sum("n_links").alias("n"), F.min("link.i").alias("link")).join(
        firsts.select("node", F.col("first.i").alias("i")), "node").collect()
    assert {r.i: (r.n, r.link) for r in rows} == {i: (len(js), js[0]) for i, js in near.items() if js}


def test_lines_have_their_number_of_links(spark, docs_of):
    line = "A line of text that is long enough to count."
    docs = docs_of([(2, f"{line}\nshort\n{line}"), (1, f"x\n{line[:-1]}!"), (3, None), (5, line + "?"), (6, "short")])
    rows = line_dedup.line_classes(docs, links=True).collect()
    got = sorted((r.doc_id, r.line_no, r.n_links, r.link_doc_id, r.link_line_no, r.near_doc_id) for r in rows if r.n_links)
    assert got == [(1, 1, 2, 2, 0, None), (2, 0, 2, 1, 1, 1), (2, 2, 2, 1, 1, 1), (5, 0, 2, 1, 1, 1)]
    assert "n_links" not in line_dedup.line_classes(docs).columns


def test_lines_of_odd_rows(spark, docs_of):
    line = "A line of text that is long enough to count."
    docs = docs_of([(2, f"{line}\nshort\n{line}"), (1, f"x\n{line[:-1]}!"), (3, None), (4, ""), (5, line), (None, line), (6, "short")], "node", "gone")
    rows = line_dedup.line_classes(docs).collect()
    got = sorted((r.doc_id or 99, r.line_no, r.class_doc_id, r.class_line_no, r.near_doc_id, r.near_line_no, r.kept) for r in rows)
    assert got == [(1, 0, 1, 0, None, None, True), (1, 1, 1, 1, None, None, True), (2, 0, 2, 0, 1, 1, False), (2, 1, 2, 1, None, None, True),
                   (2, 2, 2, 0, 1, 1, False), (5, 0, 2, 0, 1, 1, False), (6, 0, 2, 1, None, None, False), (99, 0, 2, 0, 1, 1, False)]
    left = line_dedup.without_repeated_lines(docs, "row_no").collect()
    assert sorted((r.doc_id, r.text, r.gone) for r in left) == sorted(
        [(1, f"x\n{line[:-1]}!", "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x")], key=lambda r: r[0])
    assert line_dedup.line_classes(docs.limit(0)).count() == 0


def test_long_lines(spark, docs_of):
    long = "word " * 40_000
    rows = line_dedup.line_classes(docs_of([(1, long), (2, long + "!"), (3, "x" + long)])).collect()
    assert sorted((r.doc_id, r.near_doc_id, r.kept) for r in rows) == [(1, None, True), (2, 1, False), (3, 1, False)]


def test_short_lines_lose_their_copies(spark, docs_of):
    random.seed(12)
    line = "".join(random.choices("abcdefgh", k=29))
    docs = docs_of([(1, f"{line}\n}}\n\n{line[:-1]}"), (2, f"{line}xy\n}}\n\nown"), (3, "}\nowm"), (4, "}")])
    rows = line_dedup.line_classes(docs).collect()
    got = sorted((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.near_doc_id, r.kept) for r in rows)
    assert got == [(1, 0, 1, 0, None, True), (1, 1, 1, 1, None, True), (1, 3, 1, 3, None, True), (2, 0, 2, 0, 1, False), (2, 1, 1, 1, None, False),
                   (2, 3, 2, 3, None, True), (3, 0, 1, 1, None, False), (3, 1, 3, 1, None, True), (4, 0, 1, 1, None, False)]
    left = corpus_pipeline.dedup_lines(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, f"{line}\n}}\n\n{line[:-1]}"), (2, "\nown"), (3, "owm")]
