"""Point-in-time rules on hand-made and skewed histories, against plain Python."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from touchline.operators import snapshot
from touchline.operators.asof import match_sides, recent_rows, running_totals, with_outcome

HAND = [
    ("2020-01-01", "A", "B", 2, 0), ("2020-01-05", "B", "A", 1, 1), ("2020-01-05", "A", "C", 0, 3),
    ("2020-01-09", "C", "B", 2, 2), ("2020-01-12", "A", "B", 1, 1), ("2020-01-15", "B", "C", 0, 0),
    ("2020-01-18", "A", "C", None, None), ("2020-01-20", "C", "A", 4, 1), ("2020-01-25", "B", "A", 0, 2),
    ("2020-02-01", "D", "A", None, None),
]


def history(rows, team, date):
    """Results of a team strictly before a date, oldest first, as (gf, ga, is_home)."""
    out = []
    for i, (d, h, a, hs, as_) in enumerate(rows):
        if hs is None or d >= date or team not in (h, a):
            continue
        out.append((d, i, hs if h == team else as_, as_ if h == team else hs, h == team))
    return [(gf, ga, home) for _, _, gf, ga, home in sorted(out)]


def points(gf, ga):
    return 3 if gf > ga else 1 if gf == ga else 0


def longest(flags):
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def trailing(flags):
    n = 0
    for f in reversed(flags):
        if not f:
            break
        n += 1
    return n


def expected(rows, team, date):
    past = history(rows, team, date)
    pts = [points(gf, ga) for gf, ga, _ in past]
    if len(past) < 3:
        return {"goals_per_game_5g": 1.0, "momentum_points": 1.0, "current_win_streak": 0.0,
                "longest_unbeaten_streak": 0.0, "matches_before": len(past)}
    weights = [0.95 ** (len(pts) - 1 - i) for i in range(len(pts))]
    return {
        "goals_per_game_5g": statistics.fmean(gf for gf, _, _ in past[-5:]),
        "momentum_points": sum(p * w for p, w in zip(pts, weights, strict=True)) / sum(weights),
        "current_win_streak": trailing([p == 3 for p in pts]),
        "longest_unbeaten_streak": longest([p > 0 for p in pts]),
        "matches_before": len(past),
    }


def check(df, rows, keys=None):
    names = ["matches_before", "goals_per_game_5g", "momentum_points", "current_win_streak",
             "longest_unbeaten_streak"]
    got = df.select("team", "date", *names).collect()
    assert got
    for row in got:
        if keys is not None and (row["team"], row["date"].isoformat()) not in keys:
            continue
        want = expected(rows, row["team"], row["date"].isoformat())
        for n in names:
            assert row[n] == pytest.approx(want[n], abs=1e-9), (row["team"], row["date"], n)


def test_hand_history(spark, matches_of):
    m = matches_of(HAND)
    check(snapshot.team_snapshot(m, ["rolling", "momentum", "streaks"]), HAND)


def test_future_rows_change_nothing(spark, matches_of):
    cut = datetime.date(2020, 1, 12)
    altered = [r if r[0] < cut.isoformat() else (r[0], r[1], r[2], r[3] and 9, r[4] and 0) for r in HAND]
    frames = [snapshot.team_snapshot(matches_of(r), list(snapshot.FAMILIES)).where(F.col("date") <= cut)
              for r in (HAND, altered)]
    a, b = (sorted(map(str, f.drop("travel_rest_days").collect())) for f in frames)
    assert a == b


def skewed(n=5000, seed=7):
    """Team HOT plays a third of all matches and one date holds a third of the rows."""
    rng = random.Random(seed)
    teams = [f"T{i}" for i in range(12)]
    start = datetime.date(2019, 1, 1)
    rows = []
    for _ in range(n):
        day = start + datetime.timedelta(days=200 if rng.random() < 0.33 else rng.randrange(400))
        home, away = rng.sample(teams, 2)
        if rng.random() < 0.66:
            home, away = ("HOT", away) if rng.random() < 0.5 else (home, "HOT")
        rows.append((day.isoformat(), home, away, rng.randrange(4), rng.randrange(3)))
    return rows


def test_skewed_team_and_date(spark, matches_of):
    rows = skewed()
    keys = {(t, d) for t in ("HOT", "T3") for d in ("2019-07-19", "2019-07-20", "2019-12-01", "2020-02-01")}
    check(snapshot.team_snapshot(matches_of(rows), ["rolling", "momentum", "streaks"]), rows, keys)


def test_long_history_crosses_epochs(spark, matches_of):
    """More than two thousand rows of one team, one per day: decayed sums and venue weights."""
    rng = random.Random(3)
    start = datetime.date(2000, 1, 1)
    rows = [((start + datetime.timedelta(days=i)).isoformat(), *(("A", "B") if rng.random() < 0.6 else ("B", "A")),
             rng.randrange(4), rng.randrange(4)) for i in range(3400)]
    snap = snapshot.team_snapshot(matches_of(rows), ["momentum", "home"])
    for row in snap.where("team = 'A'").where(F.dayofmonth("date").isin(1, 15)).collect():
        past = history(rows, "A", row["date"].isoformat())
        if len(past) < 60:
            continue
        pts = [points(gf, ga) for gf, ga, _ in past]
        w = [0.95 ** (len(pts) - 1 - i) for i in range(len(pts))]
        assert row["momentum_points"] == pytest.approx(sum(p * x for p, x in zip(pts, w, strict=True)) / sum(w), abs=1e-9)
        homes = [(gf, ga) for gf, ga, home in past[-50:] if home][::-1]
        hw = [math.exp(-0.1 * k) for k in range(len(homes))]
        want = sum(x * ((gf > ga) + 0.1 * (gf - ga)) for x, (gf, ga) in zip(hw, homes, strict=True)) / sum(hw)
        assert row["home_form_strength"] == pytest.approx(want, abs=1e-9)


def test_running_totals_match_a_plain_sum(spark, matches_of):
    rows = skewed(800)
    sides = with_outcome(match_sides(matches_of(rows))).withColumn("one", F.lit(1))
    got = running_totals(sides, "team", ["one", "points"], bits=3).where("team = 'HOT'").orderBy(
        "date", "match_id").select("points", "run_one", "run_points").collect()
    total = 0
    for i, row in enumerate(got, 1):
        total += row["points"]
        assert (row["run_one"], row["run_points"]) == (i, total)


def test_group_limit_runs_before_the_shuffle(spark, matches_of):
    recent = recent_rows(with_outcome(match_sides(matches_of(HAND))), "team", 5)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_cartesian_product_in_features(spark, matches_of):
    df = snapshot.team_snapshot(matches_of(HAND), list(snapshot.FAMILIES))
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_probes_see_all_history(spark, matches_of):
    m = matches_of(HAND)
    probe = spark.createDataFrame([(99, datetime.date(2021, 1, 1), "A", "B", None, None)], m.schema)
    row = snapshot.match_features(m, ["rolling"], F.lit(datetime.date(2021, 1, 1)), probe).collect()
    assert len(row) == 1
    want = expected(HAND, "A", "2021-01-01")
    assert row[0]["home_goals_per_game_5g"] == pytest.approx(want["goals_per_game_5g"])
    assert row[0]["h2h_total_matches"] == 4


def test_blocks_of_text_ids_are_bounded(spark):
    from touchline.operators import asof
    ids = [f"game-{i:06d}" for i in range(1, 3000)] + ["game-0011", "x"]
    rows = spark.createDataFrame([("A", datetime.date(2020, 1, 1), i, 1) for i in ids],
                                 "team string, date date, match_id string, one int").repartition(3)
    sizes = rows.groupBy(asof.id_block_of(rows, ["team", "date"], 5)).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 32 and sizes[1] < 1000
    assert asof.text_prefix(rows, ["team", "date"], 20) == asof.ID_PREFIX
    assert asof.text_prefix(rows.limit(0), ["team", "date"], 5) == asof.ID_PREFIX
    found = {r.match_id: r.run_one for r in asof.running_totals(rows, "team", ["one"], 5).collect()}
    assert [found[i] for i in sorted(ids)] == list(range(1, len(ids) + 1))


def test_feature_chain_goes_on_without_a_failed_component(spark, matches_of):
    from touchline.plans import catalogue
    teams, rng = "ABCD", random.Random(5)
    m = matches_of([(str(datetime.date(2020, 1, 1) + datetime.timedelta(days=i)), *rng.sample(teams, 2), rng.randint(0, 3), rng.randint(0, 3))
                    for i in range(60)])
    builders = {
        "broken": lambda m: m.select("match_id", F.raise_error(F.lit("no luck")).cast("double").alias("never")),
        "missing": lambda m: m.select("nowhere"),
        "form": lambda m: snapshot.match_features(m, ["rolling"])}
    label = F.when(F.col("home_score") > F.col("away_score"), "H").otherwise("X")
    features, report = catalogue.feature_chain(m, F.lit(datetime.date(2021, 1, 1)), label, builders)
    told = {r.component: r for r in report.collect()}
    assert [told[c].ok for c in ("broken", "missing", "form")] == [False, False, True]
    assert "no luck" in told["broken"].error and told["form"].rows == 60
    whole, _ = catalogue.feature_chain(m, F.lit(datetime.date(2021, 1, 1)), None, builders)
    assert features.count() == whole.count() == 60
    chosen = set(features.columns) - set(m.columns)
    assert chosen < set(whole.columns) - set(m.columns) and len(chosen) >= 20 and "never" not in whole.columns
