"""Plain match stores, replayed ingest, pair keys, and selection rules on hand-made tables."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import contextual, selection
from touchline.sources.documents import read_match_files, split_corrupt
from touchline.streaming.ingest import ingest_batch, one_per_match


def test_plain_store_is_read_in_full(spark, tmp_path):
    (tmp_path / "2019-2020" / "deep").mkdir(parents=True)
    (tmp_path / "2019-2020" / "m1.json").write_text(json.dumps({"match_id": "m1", "home_team": "A", "season": "s"}, indent=2))
    (tmp_path / "2019-2020" / "deep" / "m2.json").write_text(json.dumps({"match_id": "m2", "home_team": "B"}))
    (tmp_path / "2019-2020" / "m3.json").write_text('{"match_id": "m3", ')
    (tmp_path / "2019-2020" / "notes.txt").write_text("no document")
    good, bad = split_corrupt(read_match_files(spark, str(tmp_path)).cache())
    assert sorted((r.match_id, r.home_team, r.season) for r in good.collect()) == [("m1", "A", "s"), ("m2", "B", "deep")]
    assert [r._corrupt_record.strip()[:6] for r in bad.collect()] == ['{"matc']


def rows(spark, ids):
    return spark.createDataFrame(
        [(i, datetime.date(2020, 1, 1), "s", "c", h, a, g, 0, "FINISHED") for i, h, a, g in ids],
        "match_id bigint, date date, season string, competition string, home_team string, away_team string, "
        "home_score int, away_score int, status string")


def test_replay_completes_a_failed_batch(spark, tmp_path):
    store, quarantine, seen = str(tmp_path / "store"), str(tmp_path / "bad"), []

    def refresh(landed):
        seen.append(sorted(r.match_id for r in landed.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    run = ingest_batch(store, quarantine, refresh)
    batch = rows(spark, [(1, "A", "B", 2), (1, "A", "B", 1), (2, "C", "D", 0), (3, "E", "F", -4)])
    with pytest.raises(RuntimeError):
        run(batch, 7)
    run(batch, 7)
    assert seen == [[1, 2], [1, 2]]
    stored = spark.read.parquet(store).collect()
    assert sorted((r.match_id, r.home_score) for r in stored) == [(1, 2), (2, 0)]
    assert spark.read.parquet(quarantine).count() == 1


def test_repeats_follow_the_given_order(spark):
    batch = rows(spark, [(1, "A", "B", 9), (1, "A", "B", 1)]).withColumn("seen", 10 - F.col("home_score"))
    assert one_per_match(batch, ("seen",)).first().home_score == 1


def test_names_with_a_bar_make_different_pairs(spark):
    pairs = contextual.with_pair(spark.createDataFrame([("A|B", "C"), ("A", "B|C")], "home_team string, away_team string"))
    assert pairs.select("pair").distinct().count() == 2


def test_selection_rules():
    names, nan = ["a", "b", "c", "d"], float("nan")
    matrix = [[1, .97, .2, nan], [.97, 1, .1, nan], [.2, .1, 1, nan], [nan, nan, nan, nan]]
    pairs = selection.correlated_pairs(matrix, names)
    assert pairs == [("a", "b", .97)]
    assert len(selection.redundant(matrix, names, pairs)) == 1
    assert selection.clusters(matrix, names) == [["a", "b"]]
    inflation = selection.vif(matrix, names)
    assert inflation["a"] == pytest.approx(10.0) and inflation["d"] == 1.0
    assert inflation["c"] == pytest.approx(1 / (1 - .04))


def test_pairs_settled_by_stronger_ones_drop_nobody_more():
    names = list("abcd")
    matrix = [[1, .99, .96, .1], [.99, 1, .97, .2], [.96, .97, 1, .3], [.1, .2, .3, 1]]
    pairs = selection.correlated_pairs(matrix, names, .95)
    assert [p[:2] for p in pairs] == [("a", "b"), ("b", "c"), ("a", "c")]
    # a-b decides between a and b, b-c is first for c, a-c settles nothing new
    gone = selection.redundant(matrix, names, pairs)
    assert len(gone & {"a", "b"}) >= 1 and len(gone) <= 2


def test_a_batch_meets_only_its_seasons(spark, tmp_path):
    from touchline.streaming.ingest import new_matches
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    run = ingest_batch(store, str(tmp_path / "bad"), log=log)
    first = rows(spark, [(1, "A", "B", 2), (2, "C", "D", 0), (3, None, "F", 1)])
    run(first, 0)                                                       # the store does not exist yet
    late = rows(spark, [(2, "C", "D", 0), (4, "G", "H", 1)])            # a late row and one that is stored
    other = rows(spark, [(1, "A", "B", 2)]).withColumn("season", F.lit("t"))
    bare = rows(spark, [(9, "A", "B", 2)]).withColumn("season", F.lit(None).cast("string"))
    for batch_id, batch in ((1, late), (2, other), (3, bare), (4, bare), (2, other)):
        run(batch, batch_id)
    stored = spark.read.parquet(store).collect()
    assert sorted((r.season or "", r.match_id) for r in stored) == [("", 9), ("s", 1), ("s", 2), ("s", 4), ("t", 1)]
    found = {(r.batch_id, r.match_id): (r.status, r.reasons) for r in spark.read.parquet(log).collect()}
    assert found == {(0, 1): ("successful", ""), (0, 2): ("successful", ""), (0, 3): ("failed", "home_team"),
                     (1, 2): ("skipped", ""), (1, 4): ("successful", ""), (2, 1): ("successful", ""),
                     (3, 9): ("successful", ""), (4, 9): ("skipped", "")}
    plan = new_matches(other, spark.read.schema(other.schema).parquet(store))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan or "season#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_exact_quartiles(spark):
    import numpy as np

    from touchline.operators.aggregates import describe
    from touchline.operators.clean import exact_quantiles
    values = np.random.default_rng(3).normal(size=3001).tolist() + [7.0] * 500
    df = spark.createDataFrame([(v, None, 1) for v in values], "x double, gone double, k int").repartition(4)
    for small in (50_000, 20):
        found = exact_quantiles(df, ["x", "gone", "k"], [0.0, 0.25, 0.5, 0.9, 1.0], small)
        assert found["x"] == pytest.approx(np.quantile(values, [0, .25, .5, .9, 1]).tolist()) and found["k"] == [1.0] * 5
        assert "gone" not in found
    out = {r["column"]: r for r in describe(df, ["x", "gone"]).collect()}
    assert out["x"]["q25"] == pytest.approx(np.quantile(values, .25)) and out["gone"]["median"] is None


def test_redundant_features_do_not_hang_on_noise():
    names = list("abc")
    matrix = [[1, -1, .3], [-1, 1, -.3], [.3, -.3, 1]]
    for noise in (0.0, 1e-13, -1e-13):
        shaken = [[v + noise * (i + 1) if i != j else v for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        assert selection.redundant(shaken, names, selection.correlated_pairs(shaken, names)) == {"b"}


def _documents(spark, n):
    from touchline.sources.documents import statistics_struct
    return spark.range(n).select(
        F.col("id").cast("string").alias("match_id"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"),
        F.when(F.col("id") % 2 == 0, "2019").otherwise("2020").alias("season"),
        statistics_struct({"corner_kicks": ("cast(id as int)", "3")}).alias("full_time_stats"))


def test_seasons_of_a_store_do_not_deal_out_its_documents(spark):
    from touchline.sources.documents import _of_seasons
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # tables too large to broadcast
    try:
        docs = _documents(spark, 40)
        ids = docs.where("season = '2019'").select("season", "match_id")
        kept = _of_seasons(docs, ids).join(ids.where("match_id % 4 = 0"), ["season", "match_id"], "left_anti")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(season#\d+, \d+\)", plan.split("LeftAnti")[1].split("ReadSchema")[0].split("HashAggregate")[0])
        assert sorted(int(r.match_id) for r in kept.collect()) == list(range(2, 40, 4))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_documents_are_stored_compressed(spark, tmp_path):
    from touchline.sources.documents import delete_matches, read_documents, save_matches
    path = str(tmp_path / "store")
    save_matches(_documents(spark, 30), path, F.lit("t"))
    save_matches(_documents(spark, 4).withColumn("home_team", F.lit("C")), path, F.lit("u"))
    delete_matches(spark, path, spark.createDataFrame([("2020", "29"), ("2019", "28")], "season string, match_id string"))
    found = {r.match_id: (r.home_team, r.season, r.full_time_stats.corner_kicks.home) for r in read_documents(spark, path).collect()}
    assert found == {str(i): ("C" if i < 4 else "A", "2019" if i % 2 == 0 else "2020", i) for i in range(28)}
    files = [f.name for f in (tmp_path / "store").rglob("part-*") if not f.name.endswith(".crc")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_stat_rows_are_not_sorted(spark):
    from touchline.operators import pages
    row = '<div class="stat__row">{}</div>'
    html = "".join(['<html><section title="Full Time">', row.format("7 Fouls 9"), row.format("3 Fouls 4"), row.format("1.9 Corner Kicks 2"),
                    row.format("1.25 Expected goals (xG) 0.5"), row.format("5 Offsides"), '</section><section title="1st Half"></section></html>'])
    found = pages.stat_rows(spark.createDataFrame([(1, html), (1, html), (None, html), (2, "<html></html>")], "page_id bigint, html string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "size(regexp_extract_all" not in plan
    values = [("Full Time", "corner_kicks", 1.0, 2.0), ("Full Time", "expected_goals", 1.25, 0.5), ("Full Time", "fouls", 7.0, 9.0)]
    assert sorted((r.page_id or 0, *r[1:]) for r in found.collect()) == [(p, *v) for p in (0, 1) for v in values]
