"""Names, splits, medians, streaming and model files on small inputs."""

import json
import os
import random
import statistics
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import clean, folds, metrics, models, names, selection
from touchline.operators.similarity import similar


def test_registry_equals_the_sequential_rule(spark):
    teams = ["Real Madrid", "Madrid", "FC Barcelona", "Barcelona", "barcelona b", "Real Madrid Castilla", "Vigo", "Celta Vigo"]
    expand = {"FC Barcelona": "Football Club Barcelona"}
    canonical, registry = [], {}
    for t in sorted(teams, key=lambda x: (-len(x), x)):
        hits = [c for c in canonical if t.lower() in c.lower() or c.lower() in t.lower()]
        if hits:
            registry[t] = sorted(hits, key=lambda c: (-len(c), c))[0]
        else:
            c = expand.get(t, t)
            canonical.append(c)
            registry[t] = c
            registry[c] = c
    got = names.build_registry(spark.createDataFrame([(t,) for t in teams], "team string"))
    assert {r["variation"]: r["canonical"] for r in got.collect()} == registry


def test_containment_join_equals_comparing_all_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    words = sorted({w for w in words if w.strip()})
    df = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r["name"], r["outer"]) for r in names.containing(df, df.withColumnRenamed("name", "outer"), [F.col("outer")], 100).collect()}
    assert got == {(a, b) for a in words for b in words if a in b}


def test_exact_medians_narrow_to_the_middle(spark):
    rng = random.Random(5)
    data = [(rng.gauss(0, 1), float(rng.randrange(3)), None) for _ in range(20001)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = clean.exact_medians(df, ["a", "b", "c"], small=100)
    assert got["a"] == pytest.approx(statistics.median(x[0] for x in data))
    assert got["b"] == statistics.median(x[1] for x in data)
    assert "c" not in got


def test_stratified_split_is_exact_under_a_dominant_class(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 10 < 8, "H").when(F.col("id") % 10 == 8, "D").otherwise("A"))
    out = folds.stratified_split(df, "label", "id").groupBy("label").agg(F.count_if("is_train").alias("t")).collect()
    assert {r["label"]: r["t"] for r in out} == {"H": 1920, "D": 240, "A": 240}


def test_auc_of_a_perfect_ranking(spark):
    rows = [("m", "H", 0.8, 0.1, 0.1), ("m", "H", 0.7, 0.2, 0.1), ("m", "D", 0.2, 0.6, 0.2), ("m", "A", 0.1, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "model string, label string, p_H double, p_D double, p_A double")
    assert metrics.pairwise_auc(df).first()["auc_ovo"] == 1.0


def test_parsers(spark):
    df = spark.createDataFrame([("17.12.99 19:00", " 2,10 ", "semi-FINAL leg")], "d string, o string, s string")
    row = df.select(
        text.parse_date(F.col("d"), text.VALIDATION_FORMATS).cast("string").alias("d"),
        text.parse_odds(F.col("o")).alias("o"), text.stage(F.col("s"), F.lit("x")).alias("s")).first()
    assert (row["d"], row["o"], row["s"]) == ("1999-12-17 19:00:00", 2.1, "Final")


def test_selection_rules():
    features = [f"f{i}" for i in range(30)]
    scores = {f: 1 - i / 30 for i, f in enumerate(features)}
    matrix = [[1.0 if i == j else 0.99 if {i, j} == {0, 1} else 0.0 for j in range(30)] for i in range(30)]
    pairs = selection.correlated_pairs(matrix, features)
    assert [(a, b) for a, b, _ in pairs] == [("f0", "f1")]
    gone = selection.redundant(matrix, features, pairs)
    chosen = selection.choose(features, scores, gone, selection.vif(matrix, features), most=25, least=20)
    assert len(gone) == 1 and len(chosen) == 25 and not gone & set(chosen)


def test_model_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, lab, {"H": 2.0, "D": 0.0, "A": -2.0}[lab] + rng.gauss(0, 0.3)) for i, lab in
            enumerate(rng.choice("HDA") for _ in range(300))]
    df = spark.createDataFrame(rows, "match_id bigint, label string, x double")
    for kind, params in (("forest", {"numTrees": 5, "maxDepth": 3}), ("boosted_a", {"maxIter": 3, "maxDepth": 2})):
        fitted = models.fit(kind, df, ["x"], params)
        fitted.save(str(tmp_path / kind), spark)
        again = models.load_model(str(tmp_path / kind), spark)
        a, b = (m.transform(df).orderBy("match_id").select("predicted", "p_H").collect() for m in (fitted, again))
        assert a == b
        score = metrics.macro_scores(fitted.transform(df)).first()["accuracy"]
        assert score > 0.9
        total = fitted.transform(df).select(F.max(F.abs(F.col("p_H") + F.col("p_D") + F.col("p_A") - 1))).first()[0]
        assert total < 1e-9


def test_replayed_batch_adds_nothing(spark, matches_of, tmp_path):
    from touchline.streaming.ingest import ingest_batch
    m = matches_of([("2020-01-01", "A", "B", 1, 0), ("2020-01-02", "B", "A", 2, 2)]).withColumn("season", F.lit("2019"))
    run = ingest_batch(str(tmp_path / "store"), str(tmp_path / "bad"))
    for batch in (m, m, m.unionByName(m.withColumn("match_id", F.col("match_id") + 10))):
        run(batch, 0)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4


def test_registry_loads_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_text_ids_are_ordered_the_same_way(spark, matches_of):
    from touchline.operators import snapshot
    rows = [(f"2020-01-{1 + i // 3:02d}", *(("A", "B") if i % 2 else ("B", "A")), i % 3, (i * 2) % 3) for i in range(30)]
    m = matches_of(rows)
    text_ids = m.withColumn("match_id", F.format_string("game-%06d", "match_id"))
    a, b = (sorted(map(str, snapshot.team_snapshot(x, ["streaks", "season"]).collect())) for x in (m, text_ids))
    assert a == b


def test_registered_models_run_with_the_defaults(spark, monkeypatch):
    """What the queries ask of fit and search; nothing is fitted."""
    from touchline.plans import model_queries

    asked = []
    monkeypatch.setattr(model_queries, "labelled", lambda *a: spark.createDataFrame([(1, "H"), (2, "D"), (3, "A")], "match_id bigint, label string"))
    monkeypatch.setattr(models, "fit", lambda kind, df, features, params=None, **k: asked.append((kind, {**models.DEFAULTS[kind], **(params or {})})))
    monkeypatch.setattr(model_queries, "_MODELS", {})
    for kind in models.DEFAULTS:
        model_queries.trained(spark, "", kind)
        with pytest.raises(AttributeError):
            model_queries._fitted(kind)(spark, "")
    assert asked == [(kind, models.DEFAULTS[kind]) for kind in models.DEFAULTS for _ in range(2)]

    monkeypatch.setattr(model_queries.search, "search_forests", lambda *a, **k: asked.append((a, k)) or ({}, spark.range(1)))
    model_queries.parameter_search(spark, "")
    assert asked[-1][1] == {} and len(asked[-1][0]) == 2


def test_search_tries_what_it_drew(spark, monkeypatch):
    tried = []
    def predictions(kind, folded, features, k, params):
        tried.append(params)
        return folded.withColumn("predicted", F.lit("H" if params["maxDepth"] > 9 else "D"))
    monkeypatch.setattr(models, "out_of_fold", predictions)
    df = spark.createDataFrame([(i, "HHD"[i % 3]) for i in range(30)], "match_id bigint, label string")
    best, trials = models.search("forest", df, [], trials=6, k=2)
    rng = random.Random(models.SEED)
    drawn = [models.draw_params("forest", rng) for _ in range(6)]
    assert [json.loads(r.params) for r in trials.orderBy("trial").collect()] == drawn and len(tried) == 6
    assert best == next(p for p in drawn if p["maxDepth"] > 9)


def test_similar_takes_any_number_of_queries(spark):
    vectors = spark.range(10_001).select(F.format_string("t%05d", "id").alias("name"),
                                         F.array(F.cos("id"), F.sin("id")).alias("vector"))
    found = similar(vectors, vectors.limit(7), 1)
    assert found.count() == found.select("query").distinct().count() > 9_000


def test_page_layouts(spark):
    from touchline.operators import pages
    html = ('<section title="1st Half"><div class="stat__row">3 Fouls 4</div><div class="a-row_1"><div class="a-homeValue_1">'
            '<b>7.5%</b></div><div class="a-category_2"><b>Fouls</b></div><div class="a-awayValue_1">8</div></div>'
            '<div class="a-row_1"><div class="a-category_2">Nothing</div></div>'
            '<div class="section"><div>1 of 2 Offsides 3</div></div><div class="statRow">4 Red Cards 5 6</div></section>'
            '<div class="archive__row"></div>')
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    found = {(r.page_id, r.period, r.stat): (r.home, r.away) for r in pages.stat_rows(df).collect()}
    assert found == {(1, "1st Half", "fouls"): (7.5, 8.0), (1, "1st Half", "offsides"): (1.0, 3.0), (1, "1st Half", "red_cards"): (4.0, 5.0)}
    assert pages.archive_rows(df).count() == 0 and pages.odds_rows(df).count() == 0


def test_stored_files_hold_a_bounded_number_of_rows(spark):
    from touchline.session import stored
    even = stored(spark.range(1000).repartition(1), "even", 100)
    sizes = even.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {100}
    assert stored(spark.range(1000).repartition(1), "whole").select(F.input_file_name()).distinct().count() == 1


def test_training_rows_are_stored_in_small_files(spark, monkeypatch):
    """A table that one task wrote is fitted on by many."""
    from touchline.plans import model_queries
    limits = []
    monkeypatch.setattr(model_queries, "stored", lambda df, name, rows=0: limits.append((name, rows)) or df)
    monkeypatch.setattr(model_queries, "_TABLES", {})
    monkeypatch.setattr(model_queries.snapshot, "match_features", lambda m, *a: m.withColumns({c: F.lit(0.0) for c in model_queries.MODEL_FEATURES}))
    monkeypatch.setattr(model_queries, "matches", lambda *a: spark.createDataFrame(
        [(1, "2020-01-01", "A", "B", 1, 0)], "match_id bigint, date string, home_team string, away_team string, home_score int, away_score int"))
    model_queries.feature_rows(spark, "")
    assert limits == [("features", models.FIT_PARTITION)]
