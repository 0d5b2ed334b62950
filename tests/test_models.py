"""Search, lasso, similarity, names and quotes against plain Python."""

import datetime
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from touchline.operators import models, names, search, selection, similarity, snapshot
from touchline.sources import quotes


# --- forests ----------------------------------------------------------------------------------------

def plain_split(rows, y, bins, bin_count, classes):
    best = (0.0, None)
    for f in range(bins.shape[1]):
        for cut in range(bin_count - 1):
            left = bins[rows, f] <= cut
            if not left.any() or left.all():
                continue
            score = sum((np.bincount(y[rows][side], minlength=classes) ** 2).sum() / side.sum() for side in (left, ~left))
            gain = score - (np.bincount(y[rows], minlength=classes) ** 2).sum() / len(rows)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    return best


def test_tree_takes_the_best_split_of_every_node():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (200, 4)).astype(np.uint8)
    y = ((bins[:, 0] > 2).astype(int) + (bins[:, 2] > 3) + (rng.random(200) < 0.2)) % 3
    tree = search.Tree(bins, y, 4, 4, rng)
    paths = tree.paths(bins)
    for node in np.flatnonzero(tree.child):
        rows = np.flatnonzero((paths == node).any(axis=0))
        gain, (f, cut) = plain_split(rows, y, bins, 32, 3)
        mine = bins[rows, tree.feature[node]] <= tree.cut[node]
        score = sum((np.bincount(y[rows][side], minlength=3) ** 2).sum() / side.sum() for side in (mine, ~mine))
        assert score - (np.bincount(y[rows], minlength=3) ** 2).sum() / len(rows) == pytest.approx(gain)
        assert tree.smaller[node] == min(mine.sum(), (~mine).sum())
        assert (tree.counts[node] == np.bincount(y[rows], minlength=3)).all()


def test_cut_back_tree_equals_one_grown_to_that_depth():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 9, (300, 5)).astype(np.uint8)
    y = rng.integers(0, 3, 300)
    deep = search.Tree(bins, y, 12, 5, np.random.default_rng(0))
    for depth in (0, 1, 3, 12):
        shallow = search.Tree(bins, y, depth, 5, np.random.default_rng(0))
        assert np.allclose(deep.shares(deep.paths(bins), depth, 2, 1), shallow.shares(shallow.paths(bins), 99, 2, 1))
    shares = deep.shares(deep.paths(bins), 12, 40, 1)
    counts = deep.counts[deep.paths(bins)].sum(axis=2)
    for row in range(300):    # the first node on the way with under 40 rows, or the leaf
        at = next((i for i, n in enumerate(counts[:, row]) if n < 40 or not deep.child[deep.paths(bins)[i, row]]))
        node = deep.paths(bins)[at, row]
        assert np.allclose(shares[row], deep.counts[node] / deep.counts[node].sum())


def learnable(spark, n=900):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random()) for i in range(n)]
    data = [(i, a, b, "H" if a > 0.6 else "A" if b > 0.5 else "D") for i, a, b in rows]
    return spark.createDataFrame(data, "match_id bigint, a double, b double, label string")


def test_search_scores_every_trial_on_every_row(spark):
    df = learnable(spark)
    best, trials = search.search_forests(df, ["a", "b"], trials=7, k=3, narrow={"numTrees": 25, "maxDepth": 5})
    found = trials.orderBy("trial").collect()
    assert [r.rows for r in found] == [900] * 7
    drawn = random.Random(42)
    assert [json.loads(r.params) for r in found] == [
        {**models.draw_params("forest", drawn), "numTrees": 25, "maxDepth": 5} for _ in range(7)]
    assert max(r.accuracy for r in found) > 0.95 and best == json.loads(max(found, key=lambda r: (r.accuracy, -r.trial)).params)
    again = search.search_forests(df.repartition(7), ["a", "b"], trials=7, k=3, narrow={"numTrees": 25, "maxDepth": 5})[1]
    assert again.orderBy("trial").collect() == found


def test_search_of_nothing(spark):
    best, trials = search.search_forests(learnable(spark).where("false"), ["a", "b"], trials=2, k=2, narrow={"numTrees": 2})
    assert [r.accuracy for r in trials.collect()] == [0.0, 0.0] and best["numTrees"] == 2


# --- lasso ------------------------------------------------------------------------------------------

def test_lasso_against_a_plain_solver(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6)) * [1, 3, 0.5, 1, 1, 0] + [0, 5, 0, -2, 0, 4]
    y = 2 * x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=240) * 2
    fold = np.arange(240) % 3
    df = spark.createDataFrame([(int(f), list(map(float, r)), float(t)) for f, r, t in zip(fold, x, y, strict=True)],
                               "fold int, v array<double>, _y double").select("fold", array_to_vector("v").alias("_x"), "_y")
    weights, penalty = selection.lasso_cv(df.repartition(5), 6)

    def proximal(xs, ys, alpha):       # plain proximal gradient on the rows
        xc, yc = xs - xs.mean(0), ys - ys.mean()
        step, w = 1 / np.linalg.eigvalsh(xc.T @ xc / len(ys)).max(), np.zeros(6)
        for _ in range(4000):
            w = w - step * (xc.T @ (xc @ w - yc)) / len(ys)
            w = np.sign(w) * np.maximum(np.abs(w) - step * alpha, 0)
        return w, ys.mean() - xs.mean(0) @ w

    assert np.allclose(weights, proximal(x, y, penalty)[0], atol=1e-5)
    top = np.abs((x - x.mean(0)).T @ (y - y.mean()) / 240).max()
    grid = np.geomspace(top, top * 1e-3, 100)
    errors = []
    for alpha in grid[::9]:
        each = []
        for f in range(3):
            w, b = proximal(x[fold != f], y[fold != f], alpha)
            each.append(np.mean((y[fold == f] - x[fold == f] @ w - b) ** 2))
        errors.append(sum(each))
    near = grid[::9][int(np.argmin(errors))]
    assert near / 2.2 < penalty < near * 2.2
    assert weights[5] == 0


# --- similarity -------------------------------------------------------------------------------------

def plain_similar(queries, items, n):
    out = []
    for q, v in queries:
        scored = []
        for name, w in items:
            norm = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
            s = sum(x * y for x, y in zip(v, w, strict=True)) / norm if norm else 0.0
            if name != q and s > 0:
                scored.append((-round(s, 9), name))
        out += [(q, name, -s) for s, name in sorted(scored)[:n]]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 4])
def test_similar_by_balls_equals_comparing_all(spark, n):
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    items = [(f"t{i:04d}", [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(900)]
    items += [(f"same{i}", [1.0, 2.0, 0.0, 0.0]) for i in range(50)] + [("zero", [0.0] * 4)]
    queries = items[::7] + [("other", [1.0, 1.0, 1.0, 1.0]), ("same3", [1.0, 2.0, 0.0, 0.0]), ("zero", [0.0] * 4)]
    queries = list({q: (q, v) for q, v in queries}.values())
    as_df = lambda rows: spark.createDataFrame(rows, "name string, vector array<double>")
    found = sorted((r["query"], r["name"], round(r.similarity, 9)) for r in similarity.similar(as_df(queries), as_df(items), n).collect())
    assert found == plain_similar(queries, items, n)


def test_most_pairs_of_clustered_vectors_are_never_scored(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(40)]
    rows = [(f"t{i:05d}", [c + rng.gauss(0, 0.01) for c in centres[i % 40]]) for i in range(8000)]
    df = spark.createDataFrame(rows, "name string, vector array<double>")
    vectors, _ = similarity.distinct_vectors(df, df, 5)
    packs, pivots, widest = similarity.packed_balls(vectors)
    asked = similarity.asked_balls(packs, pivots, widest, 5)
    scored = asked.join(packs, "ball").agg(F.sum(F.size("asked").cast("bigint") * F.size("vids"))).first()[0]
    assert scored < 8000 * 8000 / 4


# --- names ------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, z in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != z)))
    return row[-1]


def test_edit_pairs_equal_comparing_all(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abc ", k=rng.randrange(1, 26))) for _ in range(60)]

    def typo(s):
        s = list(s)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(s) + 1)
            s[at:at + rng.randrange(2)] = rng.choice(["", "a", "x", "b"])
        return "".join(s)

    asked = sorted({typo(s) for s in base for _ in range(3)} | set(base))
    as_df = lambda rows: spark.createDataFrame([(r,) for r in rows], "name string")
    for threshold in (80, 60):
        found = {(r.a, r.c, r.score) for r in names.edit_pairs(as_df(asked), as_df(sorted(set(base))), threshold).collect()}
        want = set()
        for a, c in itertools.product(asked, set(base)):
            score = math.floor((1 - edits(a, c) / max(len(a), len(c), 1)) * 100 + 0.5)
            if a and c and score >= threshold:
                want.add((a, c, score))
        assert found == want


def test_a_letter_in_every_choice_is_a_short_key(spark):
    choices = spark.range(3000).select(F.format_string("a club %04d", "id").alias("choice"))
    asked = spark.createDataFrame([("A",), ("club",), ("a club 0007 of all",), ("zz",)], "asked string")
    found = sorted((r.asked, r.choice, r.score, r["rank"]) for r in names.fuzzy_join(asked, choices, 2).collect())
    assert found == [("A", "a club 0000", 80, 1), ("A", "a club 0001", 80, 2), ("a club 0007 of all", "a club 0007", 80, 1),
                     ("club", "a club 0000", 80, 1), ("club", "a club 0001", 80, 2)]
    listed = choices.select(F.lower("choice").alias("outer"), "choice")
    joined = names.containing(asked.select(F.lower("asked").alias("name")), listed, [F.length("choice"), F.col("choice")], 2)
    assert joined.count() == 4                                  # two for the letter, two for the word
    assert "WindowGroupLimit" in joined._jdf.queryExecution().executedPlan().toString()


# --- quotes -----------------------------------------------------------------------------------------

def many_quotes(spark, n=200_000):
    return quotes.conform(spark.range(n).selectExpr(
        "'m1' as match_id", "'match_winner' as market", "'BOOK' as bookmaker", "'Full Time' as period",
        "timestamp_seconds(id) as ts", "1.0 + id % 3 as home_win", "case when id % 2 = 0 then 0.0 else 4.0 end as draw", "'2000' as season"))


def test_a_match_with_many_quotes_of_one_bookmaker(spark):
    found = many_quotes(spark, 1_000_000)
    row = quotes.flat_odds(found).first()
    assert row.odds_home_win == pytest.approx(2.0, abs=1e-5) and row.odds_draw == 4.0 and row.odds_away_win is None
    plan = quotes.flat_odds(found)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan
    parts = quotes.exported(many_quotes(spark), most=1000).select("part", F.size("odds.match_winner").alias("n")).collect()
    assert sum(r.n for r in parts) == 200_000 and max(r.n for r in parts) < 1300 and min(r.part for r in parts) == 0


def test_summaries_of_parts_merge(spark):
    every = many_quotes(spark, 3000).withColumn("chunk", F.crc32(F.col("ts").cast("string").cast("binary")) % 4)
    whole = quotes.summary(every, ["match_id"])
    parts = quotes.summary(every, ["match_id", "chunk"]).drop("chunk")
    assert quotes.merged(parts, ["match_id"]).collect() == whole.collect()
    assert whole.select(quotes.mean_price("draw").alias("m")).first().m == 4.0


def test_nested_quotes_come_back(spark):
    rows = quotes.conform(spark.createDataFrame(
        [("m1", "over_under", "B", "Full Time", 2.5, 1.5, 2.5, None), ("m1", "correct_score", None, "1st Half", None, None, None, "2-1"),
         ("m2", "over_under", "B", None, None, 0.0, None, None)],
        "match_id string, market string, bookmaker string, period string, total double, over double, under double, score string")
        .withColumn("ts", F.lit(datetime.datetime(2020, 1, 2, 3, 4, 5))).withColumn("odds", F.lit(9.0)))
    nested = quotes.exported(rows)
    back = quotes.unnested(nested.select("match_id", "odds")).drop("season")
    want = rows.withColumn("odds", F.when(F.col("market") == "correct_score", F.col("odds"))).drop("season")
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


# --- momentum ---------------------------------------------------------------------------------------

def test_momentum_reaches_back_over_defeats_and_hot_dates(spark, matches_of):
    start = datetime.date(2000, 1, 1)
    rows = [((start + datetime.timedelta(days=i)).isoformat(), "A", "B", 3, 0) for i in range(5)]
    rows += [((start + datetime.timedelta(days=5 + i)).isoformat(), "A", "B", 0, 1) for i in range(1100)]
    rows += [("2005-01-01", "A", "C", i % 4, 1) for i in range(1500)] + [("2005-01-02", "A", "B", 0, 0)]
    snap = {str(r["date"]): r["momentum_points"] for r in snapshot.team_snapshot(matches_of(rows), ["momentum"]).where("team = 'A'").collect()}
    for day in ("2001-06-01", "2003-01-05", "2005-01-01", "2005-01-02"):
        past = [3 if h > a else 1 if h == a else 0 for d, _, _, h, a in rows if d < day]
        if day in snap:
            w = [0.95 ** (len(past) - 1 - i) for i in range(len(past))]
            assert snap[day] == pytest.approx(sum(p * x for p, x in zip(past, w, strict=True)) / sum(w), rel=1e-9)
    assert 0 < snap["2003-01-09"] < 1e-20


# --- boosting ---------------------------------------------------------------------------------------

def boosted_rows(spark, n):
    rng = random.Random(11)
    rows = [(i, rng.random(), rng.gauss(0, 1), float(rng.randrange(4)), rng.choice("HDA")) for i in range(n)]
    rows = [(i, a, b, c, "H" if a + 0.2 * b > 0.7 else "A" if c > 2 else x) for i, a, b, c, x in rows]
    return spark.createDataFrame(rows, "match_id bigint, a double, b double, c double, label string").coalesce(2)


def test_boosting_equals_mllib(spark, monkeypatch):
    df, names, params = boosted_rows(spark, 700), ["a", "b", "c"], {"maxIter": 8, "maxDepth": 4}
    folded = df.withColumn("fold", F.col("match_id") % 2)
    asked = [("boosted_a", df, names, params), ("boosted_b", folded.where("fold = 1"), names, {**params, "maxIter": 5})]
    new = models.fit_all(asked)
    monkeypatch.setattr(models, "GROWN", set())
    for (kind, rows, _, more), mine in zip(asked, new, strict=True):
        old = models.fit(kind, rows, names, more)
        one, two = (m.transform(df).orderBy("match_id").select("p_H", "p_D", "p_A").toArrow().to_pandas().to_numpy() for m in (old, mine))
        seen = np.array([r[0] for r in rows.orderBy("match_id").select("match_id").collect()])
        assert np.allclose(one[seen], two[seen], atol=1e-9)
        for c in models.CLASSES:
            a, b = old.parts[c], mine.parts[c]
            assert a.treeWeights == b.treeWeights and a.getNumTrees == b.getNumTrees
            assert a.trees[0].toDebugString.split("\n")[1:] == b.trees[0].toDebugString.split("\n")[1:]


def test_boosting_takes_one_job_per_level(spark):
    """Whatever the number of classes and models, and few beside them."""
    df = boosted_rows(spark, 300)
    asked = [("boosted_a", df.where(f"match_id % 3 <> {i}"), ["a", "b"], {"maxIter": 6, "maxDepth": 3}) for i in range(3)]
    spark.sparkContext.setJobGroup("boosting", "fit")
    try:
        models.boosting.grow(spark, [(models.boosting.rows_of(models.assemble(rows, x).select("_x", models.label_index().alias("_label"))), 2,
                                      {**models.DEFAULTS["boosted_a"], **p}) for _, rows, x, p in asked], 3)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) <= 6 * 3 + 3 * 4 + 4


def test_sums_of_a_level(spark):
    """Counted by pairs of features or one by one, the sums are those of a plain loop."""
    from touchline.operators import boosting
    rng = np.random.default_rng(3)
    bins, classes, scores = rng.integers(0, 32, (3, 500)).astype(np.uint8), rng.integers(0, 2, 500).astype(np.uint8), rng.normal(size=(1, 500))
    tree = boosting.root()
    for level in range(5):
        begin = len(tree["child"]) - (1 if level == 0 else opened)
        rest = boosting.residuals(np.where(classes == 0, 1.0, -1.0), scores[0])
        node = boosting.positions(tree, bins.reshape(-1), 500, level, np.arange(500)) - begin
        nodes = len(tree["child"]) - begin
        want = np.zeros((2, 3, nodes, 32))
        for i in np.flatnonzero(node >= 0):
            for f in range(3):
                want[:, f, node[i], bins[f, i]] += 1, rest[i]
        for small in (set(), {0}):
            found, = boosting.level_sums([(0, bins, classes, scores)], {(0, 0): (tree, begin)}, level, {(0, 0): 9}, False, small)
            assert np.allclose(found[0, 0][0], want[0]) and np.allclose(found[0, 0][1], want[1])
        tree, made = boosting.split(tree, begin, 1, found[0, 0], True)
        opened = len(tree["child"]) - made


def test_boosting_nothing_or_one_class(spark):
    df = boosted_rows(spark, 40)
    with pytest.raises(ValueError, match="no rows"):
        models.fit("boosted_a", df.where("false"), ["a"], {"maxIter": 2})
    only = models.fit("boosted_a", df.withColumn("label", F.lit("D")), ["a"], {"maxIter": 3}).transform(df)
    assert {r.predicted for r in only.select("predicted").distinct().collect()} == {"D"}


def test_thresholds_of_many_rows_come_from_all_of_them(spark, monkeypatch):
    from touchline.operators import boosting
    df = spark.range(64_000).select(F.array(F.col("id") % 5 * 1.0, F.col("id") * 1.0).alias("x"))
    few, many = boosting.all_thresholds(df, 2, 64_000)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(many) == 31
    assert np.allclose(many, np.arange(1, 32) * 2000, atol=20)


def shuffles(df):
    """Exchanges of the plan, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_export_shuffles_quotes_once(spark):
    quotes_ = many_quotes(spark, 3000).unionByName(many_quotes(spark, 5).withColumn("match_id", F.lit("m2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quotes.exported(quotes_, most=1000)
        assert shuffles(out) <= 2                       # ids of the first parts, the lists
        rows = out.select("match_id", "part", F.size("odds.match_winner").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n for r in rows if r.match_id == "m1") == 3000 and [(r.part, r.n) for r in rows if r.match_id == "m2"] == [(0, 5)]
    assert len(rows) == len({(r.match_id, r.part) for r in rows}) and {r.part for r in rows if r.match_id == "m1"} == {0, 1, 2}


def test_every_match_has_a_first_part(spark):
    """Even if all of its quotes are dealt to others."""
    one = many_quotes(spark, 1)
    rows = next(r for r in ([(x.part, x.n) for x in quotes.exported(one.withColumn("ts", F.timestamp_seconds(F.lit(i))).unionByName(
        one.withColumn("ts", F.timestamp_seconds(F.lit(i)))), most=1).select("part", F.size("odds.match_winner").alias("n")).collect()]
        for i in range(20)) if any(p and n for p, n in r))
    assert sorted(p for p, _ in rows) == [0, 1]


def test_line_items_are_joined_before_they_become_records(spark, tmp_path):
    from touchline.sources.match_documents import market_quotes
    spark.sql("select 1L as o_orderkey, 5L as o_custkey, 'F' as o_orderstatus, 10.0D as o_totalprice, timestamp'2000-02-03' as o_orderdate,"
              " 'x' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select l_orderkey, 1L as l_partkey, 3L as l_suppkey, cast(nullif(id, 3) - 1 as int) + 1 as l_linenumber, 2.0D as l_quantity, 3.0D as l_extendedprice,"
              " 0.1D as l_discount, 0.2D as l_tax, timestamp'2000-02-04' as l_shipdate from (select 1L as l_orderkey, id from range(1, 4) union all select 2, 1)").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = market_quotes(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")     # the records are made above the join
    found = out.collect()
    rows = {r.market: r for r in found}
    assert len(found) == 9 and {r.match_id for r in found} == {"1"} and {r.season for r in found} == {"1999"}
    assert set(rows) == {"match_winner", "over_under", "double_chance", "draw_no_bet", "odd_even"}    # a line without a number: the last
    assert rows["double_chance"].home_or_draw == pytest.approx(1.9) and rows["match_winner"].bookmaker == "BOOK_3"
