"""Queries S01..S16, P01..P20, A01..A14, O*, U*, J04..J09, D60..D62: the data layer."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import aggregates, clean, weights
from touchline.operators.asof import match_sides
from touchline.plans.registry import query, r, rounded
from touchline.schemas import ODDS_SCHEMA, STATISTICS
from touchline.session import fresh_dir
from touchline.sources import documents, quotes
from touchline.sources.match_documents import (
    OTHER_MARKETS,
    PERIOD_SQL,
    TOTAL_SQL,
    document_store,
    market_quotes,
    match_documents,
    quote_store,
    stat_sql,
)
from touchline.sources.views import MATCHES_SQL, ODDS_SQL, matches, odds_quotes, table

M = f"with {MATCHES_SQL}"
AS_OF = datetime.date(2001, 8, 2)
AS_OF_SQL = "date '2001-08-02'"
SEASON = "1998"


def docs(spark, sf_dir, **kw):
    return documents.read_documents(spark, document_store(spark, sf_dir), **kw)


def quotes_of(spark, sf_dir, **kw):
    return quotes.read_quotes(spark, quote_store(spark, sf_dir), **kw)


def flat(spark, sf_dir):
    return documents.flatten(docs(spark, sf_dir), quotes.flat_odds(quotes_of(spark, sf_dir)))


# --- scans and sinks ---------------------------------------------------------------------------

DOC_COLS = ["match_id", "season", "date", "home_team", "away_team", "home_score", "away_score"]
DOC_SQL = ("cast(match_id as varchar) as match_id, season, strftime(date, '%Y-%m-%dT00:00:00') as date, home_team,"
           " away_team, home_score, away_score")


@query("S01_scan_documents", f"{M} select {DOC_SQL} from m")
def scan_documents(spark, sf_dir):
    return docs(spark, sf_dir).select(*DOC_COLS)


@query("S02_scan_season", f"{M} select {DOC_SQL} from m where season='{SEASON}'")
def scan_season(spark, sf_dir):
    return docs(spark, sf_dir, season=SEASON).select(*DOC_COLS)


@query("S03_nested_scan", (
    f"{M} select cast(match_id as varchar) as match_id, {stat_sql('possession')[0]} as possession_home,"
    f" case when match_id%2=0 then {stat_sql('possession')[1]} end as possession_1h_away from m"))
def nested_scan(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "match_id", F.col("full_time_stats.possession.home").alias("possession_home"),
        F.col("first_half_stats.possession.away").alias("possession_1h_away"))


# Mean odds of a match over every quote.
_MEAN = f"""
w as (
  select l_orderkey as match_id, 1.2::double + l_quantity/10 as h, 2.0::double + l_discount*10 as d, 1.5::double + l_tax*50 as a,
    {TOTAL_SQL} = 2.5 and {PERIOD_SQL} = 'Full Time' as asked
  from lineitem),
lo as (
  select match_id, avg(h) as h, avg(d) as d, avg(a) as a, avg(h*0.5+1) filter (asked) as o, avg(a*0.5+1) filter (asked) as u
  from w group by match_id)"""


def flat_sql() -> str:
    cols = ["cast(m.match_id as varchar) as match_id", "strftime(date, '%Y-%m-%dT00:00:00') as date", "home_team",
            "away_team", "home_score", "away_score", "season", "competition",
            "case when m.match_id%5=0 then 'Final' else 'Regular Season' end as stage", "status",
            "case when home_score>away_score then 'H' when home_score<away_score then 'A' when home_score=away_score then 'D' end as result",
            "home_score+away_score as total_goals", "home_score>0 and away_score>0 as both_teams_scored",
            "home_score-away_score as goal_difference"]
    qualified = lambda e: e.replace("match_id", "m.match_id")
    for name, stat, default in documents.FULL_TIME_COLUMNS:
        for side, e in zip(("home", "away"), stat_sql(stat), strict=True):
            cols.append(f"coalesce({qualified(e)}, {default}) as {name}_{side}")
    for half, mod in (("1h", 2), ("2h", 3)):
        for name, stat in documents.HALF_COLUMNS:
            for side, e in zip(("home", "away"), stat_sql(stat), strict=True):
                cols.append(f"case when m.match_id%{mod}=0 then {qualified(e)} end as {name}_{half}_{side}")
    for n, e in (("home_win", "h"), ("draw", "d"), ("away_win", "a"), ("over_2_5", "o"), ("under_2_5", "u")):
        cols.append(f"{r('lo.' + e)} as odds_{n}")
    for n, e in (("home", "h"), ("draw", "d"), ("away", "a")):
        cols.append(f"{r('1/lo.' + e)} as implied_prob_{n}")
    return (f"{M}, {_MEAN} select " + ", ".join(cols)
            + ", season as year from m left join lo on lo.match_id=m.match_id")


@query("S04_flatten_documents", flat_sql())
def flatten_documents(spark, sf_dir):
    return rounded(flat(spark, sf_dir).drop("file_path"))


@query("S05_safe_extract", (
    f"{M} select cast(match_id as varchar) as match_id, coalesce({stat_sql('corner_kicks')[0]}, 0) as corners_home,"
    f" case when match_id%2=0 then {stat_sql('shots_on_goal')[0]} end as shots_1h_home from m"))
def safe_extract(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "match_id", documents.safe_extract("full_time_stats.corner_kicks.home", 0).alias("corners_home"),
        documents.safe_extract("first_half_stats.shots_on_goal.home").alias("shots_1h_home"))


@query("S06_corrupt_documents", (
    "select count(*) filter (where o_orderkey%50<>0) as readable, count(*) filter (where o_orderkey%50=0) as quarantined from orders"))
def corrupt_documents(spark, sf_dir):
    path = fresh_dir(spark, "damaged")
    doc = F.to_json(F.struct(F.col("match_id").cast("string").alias("match_id"), "home_team", "away_team"))
    # every fiftieth document is cut short
    line = F.when(F.col("match_id") % 50 == 0, F.expr("substr(doc, 1, length(doc) - 9)")).otherwise(F.col("doc"))
    matches(spark, sf_dir).withColumn("doc", doc).select("season", line.alias("value")).write \
        .partitionBy("season").text(path)
    kept = documents.read_documents(spark, path, keep_corrupt=True)
    bad = F.col("_corrupt_record").isNotNull()
    return kept.agg(F.count_if(~bad & F.col("match_id").isNotNull()).alias("readable"),
                    F.count_if(bad).alias("quarantined"))


_BOOKS = [f"BOOK_{i}" for i in range(8)]


@query("S07_dynamic_columns", (
    f"with {ODDS_SQL}, w as (select match_id, bookmaker, max(home_win) as v from q group by match_id, bookmaker) select match_id, "
    + ", ".join(f"{r(f'max(v) filter (where bookmaker={chr(39)}{b}{chr(39)})')} as odds_{b}_home" for b in _BOOKS)
    + " from w group by match_id"))
def dynamic_columns(spark, sf_dir):
    best = odds_quotes(spark, sf_dir).groupBy("match_id", "bookmaker").agg(F.max("home_win").alias("v"))
    long = best.select("match_id", F.concat(F.lit("odds_"), "bookmaker", F.lit("_home")).alias("key"),
                       F.col("v").cast("string").alias("value"))
    return rounded(documents.wide_statistics(long, [f"odds_{b}_home" for b in _BOOKS]))


@query("S08_file_inventory", f"{M} select season as year, count(*) as n_documents from m group by season")
def file_inventory(spark, sf_dir):
    return documents.file_inventory(spark, document_store(spark, sf_dir))


@query("S09_save_matches", (
    f"{M} select season, count(*) as n, count(*) filter (where season='{SEASON}' and match_id%2=0) as corrected from m group by season"))
def save_matches(spark, sf_dir):
    path = fresh_dir(spark, "saved")
    whole = match_documents(spark, sf_dir)
    documents.save_matches(whole, path, F.lit("2001-08-02T00:00:00"))
    again = whole.where((F.col("season") == SEASON) & (F.col("match_id").cast("bigint") % 2 == 0)) \
        .withColumn("status", F.lit("CORRECTED"))
    documents.save_matches(again, path, F.lit("2001-08-03T00:00:00"))
    return documents.read_documents(spark, path).groupBy("season").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "CORRECTED").alias("corrected"))


@query("S10_load_match", f"{M} select {DOC_SQL} from m where match_id=(select min(match_id) from m where season='{SEASON}')")
def load_match(spark, sf_dir):
    first = matches(spark, sf_dir).where(F.col("season") == SEASON).agg(F.min("match_id")).first()[0]
    return documents.load_match(spark, document_store(spark, sf_dir), SEASON, str(first)).select(*DOC_COLS)


@query("S11_list_matches", f"{M} select distinct season, cast(match_id as varchar) as match_id from m")
def list_matches(spark, sf_dir):
    return documents.list_matches(spark, document_store(spark, sf_dir))


@query("S12_delete_matches", f"{M} select season, count(*) as n from m where match_id%3<>0 group by season")
def delete_matches(spark, sf_dir):
    path = fresh_dir(spark, "deleting")
    documents.save_matches(match_documents(spark, sf_dir), path, F.lit("2001-08-02T00:00:00"))
    ids = matches(spark, sf_dir).where(F.col("match_id") % 3 == 0).select(
        "season", F.col("match_id").cast("string").alias("match_id"))
    documents.delete_matches(spark, path, ids)
    return documents.read_documents(spark, path).groupBy("season").agg(F.count("*").alias("n"))


_WEIGHT_SQL = f"greatest(exp(-0.0005*date_diff('day', date, {AS_OF_SQL})), 0.1)"
SCORED = "m2 as (select * from m where home_score is not null)"


def weighted(spark, sf_dir):
    return weights.with_weights(clean.with_score_columns(clean.clean(matches(spark, sf_dir))), F.lit(AS_OF))


@query("S13_csv_sink", f"{M}, {SCORED} select match_id, home_score, {r(_WEIGHT_SQL)} as temporal_weight from m2")
def csv_sink(spark, sf_dir):
    path = fresh_dir(spark, "csv")
    weighted(spark, sf_dir).select("match_id", "home_score", "temporal_weight").write.option("header", True).csv(path)
    return rounded(spark.read.option("header", True).schema(
        "match_id bigint, home_score int, temporal_weight double").csv(path))


@query("S14_parquet_sink", f"{M}, {SCORED} select match_id, season, home_score, {r(_WEIGHT_SQL)} as temporal_weight from m2")
def parquet_sink(spark, sf_dir):
    path = fresh_dir(spark, "parquet")
    out = weighted(spark, sf_dir).select("match_id", "season", "home_score", "temporal_weight")
    out.repartition("season").write.partitionBy("season").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    return rounded(back.select("match_id", F.col("season").cast("string").alias("season"), "home_score",
                               "temporal_weight"))


@query("S15_metadata_report", (
    f"{M}, {SCORED} select count(*) as total_matches, min(date) as first_date, max(date) as last_date,"
    " count(distinct competition) as competitions, count(distinct season) as years_covered,"
    f" {r('avg(case when home_score>away_score then 1.0::double else 0.0 end)')} as share_home,"
    f" {r('avg(' + _WEIGHT_SQL + ')')} as avg_weight from m2"))
def metadata_report(spark, sf_dir):
    path = fresh_dir(spark, "metadata")
    report = weighted(spark, sf_dir).agg(
        F.count("*").alias("total_matches"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.countDistinct("competition").alias("competitions"), F.countDistinct("season").alias("years_covered"),
        F.avg(F.when(F.col("result") == "H", 1.0).otherwise(0.0)).alias("share_home"),
        F.avg("temporal_weight").alias("avg_weight"))
    report.write.json(path)
    return rounded(spark.read.schema(report.schema).json(path))


@query("S16_season_manifest", (
    f"{M} select season, count(distinct match_id) as total_matches, count(distinct competition) as tournaments from m group by season"))
def season_manifest(spark, sf_dir):
    """The manifest is a table (season, url, tournament) by season rather than one list per season."""
    path = fresh_dir(spark, "manifest")
    urls = docs(spark, sf_dir).select("season", "url", F.col("competition").alias("tournament"))
    urls.dropDuplicates(["season", "url"]).write.partitionBy("season").json(path)
    back = spark.read.schema("url string, tournament string, season string").json(path)
    return back.groupBy("season").agg(F.countDistinct("url").alias("total_matches"),
                                      F.countDistinct("tournament").alias("tournaments"))


# --- projections and predicates ----------------------------------------------------------------

_HDA = "case when home_score>away_score then 'H' when home_score<away_score then 'A' when home_score=away_score then 'D' end"


@query("P01_result", f"{M} select match_id, {_HDA} as result from m")
def result(spark, sf_dir):
    return matches(spark, sf_dir).select(
        "match_id", clean.result_hda(F.col("home_score"), F.col("away_score")).alias("result"))


@query("P02_result_encodings", (
    f"{M} select match_id, case when home_score>away_score then 'W' when home_score<away_score then 'L' when home_score=away_score then 'D' end as wdl,"
    " case when home_score>away_score then '1' when home_score<away_score then '2' when home_score=away_score then 'X' end as outcome from m"))
def encodings(spark, sf_dir):
    h, a = F.col("home_score"), F.col("away_score")
    return matches(spark, sf_dir).select("match_id", clean.result_wdl(h, a).alias("wdl"),
                                         clean.outcome_1x2(h, a).alias("outcome"))


@query("P03_goals", (
    f"{M} select match_id, home_score+away_score as total_goals, home_score>0 and away_score>0 as both_teams_scored,"
    " home_score-away_score as goal_difference from m"))
def goals(spark, sf_dir):
    return clean.with_score_columns(matches(spark, sf_dir)).select(
        "match_id", "total_goals", "both_teams_scored", "goal_difference")


def _shots(side):
    i = 0 if side == "home" else 1
    return (f"coalesce({stat_sql('shots_on_goal')[i]},0)", f"coalesce({stat_sql('goal_attempts')[i]},0)")


@query("P04_shot_ratios", f"{M} select cast(match_id as varchar) as match_id, " + ", ".join(
    f"{r(f'case when {_shots(s)[1]}>0 then {_shots(s)[0]}/{_shots(s)[1]} else 0 end')} as shot_accuracy_{s},"
    f" {r(f'case when {_shots(s)[0]}>0 then {s}_score/{_shots(s)[0]} else 0 end')} as conversion_rate_{s}"
    for s in ("home", "away")) + " from m where home_score is not null")
def shot_ratios(spark, sf_dir):
    out = clean.with_shot_ratios(clean.clean(flat(spark, sf_dir)))
    return rounded(out.select("match_id", *[f"{n}_{s}" for s in ("home", "away")
                                            for n in ("shot_accuracy", "conversion_rate")]))


@query("P05_margins", (
    f"{M} select match_id, abs(home_score-away_score) as abs_goal_difference, home_score+away_score>=3 as is_high_scoring,"
    " home_score+away_score<=1 as is_low_scoring, abs(home_score-away_score) as margin_of_victory from m where home_score is not null"))
def margins(spark, sf_dir):
    out = clean.with_margins(clean.with_score_columns(clean.clean(matches(spark, sf_dir))))
    return out.select("match_id", "abs_goal_difference", "is_high_scoring", "is_low_scoring", "margin_of_victory")


PRICES = ["home_win", "draw", "away_win"]
A02_SQL = f"with {ODDS_SQL} select match_id, " + ", ".join(
    f"{r(f'avg({p}) filter (where {p}>0)')} as odds_{p}" for p in PRICES) + " from q group by match_id"


@query("P06_implied_probability", f"with {ODDS_SQL} select match_id, " + ", ".join(
    f"{r(f'1/avg({p}) filter (where {p}>0)')} as implied_prob_{p}" for p in PRICES) + " from q group by match_id")
def implied(spark, sf_dir):
    odds = aggregates.mean_odds(odds_quotes(spark, sf_dir), PRICES)
    return rounded(odds.select("match_id", *[
        aggregates.implied_probability(F.col(f"odds_{p}")).alias(f"implied_prob_{p}") for p in PRICES]))


_DIRTY = ("case when match_id%40=0 then 'soon' when match_id%41=0 then null else cast(date as string) end as date,"
          " case when match_id%43=0 then null else home_team end as home_team, away_team,"
          " case when match_id%47=0 then -1 else home_score end as home_score, away_score")
_GOOD = "try_cast(date as date) is not null and home_team is not null and home_score>=0 and away_score>=0"


def dirty(spark, sf_dir):
    return matches(spark, sf_dir).selectExpr("match_id", *_split(_DIRTY))


def _split(text_):
    return ["case when match_id%40=0 then 'soon' when match_id%41=0 then null else cast(date as string) end as date",
            "case when match_id%43=0 then null else home_team end as home_team", "away_team",
            "case when match_id%47=0 then -1 else home_score end as home_score", "away_score"]


@query("P07_clean", f"{M}, d as (select match_id, {_DIRTY} from m) select match_id, try_cast(date as date) as date from d where {_GOOD}")
def cleaned(spark, sf_dir):
    return clean.clean(dirty(spark, sf_dir)).select("match_id", "date")


@query("P08_clean_report", (
    f"{M}, d as (select match_id, {_DIRTY} from m), c as (select count(*) as before, count(*) filter (where {_GOOD}) as after from d)"
    f" select before, after, before-after as removed, {r('(before-after)*100.0/before')} as removed_percent from c"))
def clean_report(spark, sf_dir):
    return rounded(clean.clean_report(dirty(spark, sf_dir)))


@query("P09_feature_columns", f"{M}, {_MEAN} select " + ", ".join(
    [f"coalesce({e.replace('match_id', 'm.match_id')}, {d}) as {n}_{s}" for n, st, d in documents.FULL_TIME_COLUMNS
     for s, e in zip(("home", "away"), stat_sql(st), strict=True)]) + " from m left join lo on lo.match_id=m.match_id")
def feature_columns(spark, sf_dir):
    f = flat(spark, sf_dir)
    extra = [c for c in f.columns if "_1h_" in c or "_2h_" in c or c.startswith(("odds_", "implied_"))]
    return f.select(*clean.feature_columns(f, extra))


_H1 = "case when match_id%2=0 then " + stat_sql("possession")[0] + " end"


@query("P10_impute", (
    f"{M}, f as (select match_id, {_H1} as p, case when match_id%9=0 then null else competition end as comp from m)"
    f" select match_id, {r('coalesce(p, (select median(p) from f))')} as p, coalesce(comp, 'unknown') as comp from f"))
def impute(spark, sf_dir):
    base = matches(spark, sf_dir).selectExpr(
        "match_id", f"{_H1} as p", "case when match_id%9=0 then null else competition end as comp")
    return rounded(clean.impute(base, ["p", "comp"]))


@query("P11_zero_fill", f"{M} select match_id, coalesce(cast({_H1} as double), 0.0::double) as p from m")
def zero_fill(spark, sf_dir):
    return matches(spark, sf_dir).selectExpr("match_id", f"cast({_H1} as double) as p").fillna(0.0, ["p"])


@query("P12_possession_scale", (
    f"{M}, p as (select match_id, 20+match_id%31 as h, 25+match_id%17 as a from m) select match_id, {r('h*100.0/(h+a)')} as home, {r('a*100.0/(h+a)')} as away from p"))
def possession_scale(spark, sf_dir):
    base = matches(spark, sf_dir).selectExpr("match_id", "20+match_id%31 as h", "25+match_id%17 as a")
    home, away = clean.possession_to_100(F.col("h"), F.col("a"))
    return rounded(base.select("match_id", home.alias("home"), away.alias("away")))


@query("P13_weighted_columns", (
    f"{M}, {SCORED} select match_id, home_score, {r(f'home_score*{_WEIGHT_SQL}')} as home_score_weighted,"
    f" {r(f'(home_score+away_score)*{_WEIGHT_SQL}')} as total_goals_weighted from m2"))
def weighted_columns(spark, sf_dir):
    out = clean.weighted_columns(weighted(spark, sf_dir), "temporal_weight", skip=["match_id"])
    return rounded(out.select("match_id", "home_score", "home_score_weighted", "total_goals_weighted"))


@query("P14_required_fields", (
    f"{M}, d as (select match_id, {_DIRTY} from m) select match_id, concat_ws(',', case when home_team is null then 'home_team' end,"
    " case when date is null then 'date' end) as missing, home_team is not null and date is not null as valid from d"))
def required_fields(spark, sf_dir):
    gone = clean.missing_fields()
    return dirty(spark, sf_dir).select("match_id", F.array_join(gone, ",").alias("missing"),
                                       (F.size(gone) == 0).alias("valid"))


_ODD_POSS = "case when match_id%19=0 then 20 else 70-match_id%41 end"


@query("P15_statistics_check", (
    f"{M} select match_id, concat_ws(',', case when match_id%19=0 and 30+match_id%41+20<>100 then 'possession' end,"
    " case when match_id%23=0 then 'shots' end) as violations from m"))
def statistics_check(spark, sf_dir):
    base = matches(spark, sf_dir).selectExpr(
        "match_id", "30+match_id%41 as ph", f"{_ODD_POSS} as pa", "case when match_id%23=0 then -1 else 4 end as shots")
    bad = clean.stat_violations(F.col("ph"), F.col("pa"), [F.col("shots")])
    return base.select("match_id", F.array_join(bad, ",").alias("violations"))


@query("P16_odds_check", (
    f"with {ODDS_SQL}, o as (select match_id, case when match_id%29=0 then '' else bookmaker end as bookmaker, home_win,"
    " case when match_id%31=0 then 0 else draw end as draw, away_win from q) select bookmaker, concat_ws(',',"
    " case when draw<=0 then 'price' end, case when bookmaker='' then 'bookmaker' end) as violations, count(*) as n from o group by all"))
def odds_check(spark, sf_dir):
    q = odds_quotes(spark, sf_dir).withColumn(
        "bookmaker", F.when(F.col("match_id") % 29 == 0, "").otherwise(F.col("bookmaker"))).withColumn(
        "draw", F.when(F.col("match_id") % 31 == 0, 0.0).otherwise(F.col("draw")))
    bad = clean.odds_violations(F.col("bookmaker"), [F.col(p) for p in PRICES])
    return q.withColumn("violations", F.array_join(bad, ",")).groupBy("bookmaker", "violations").agg(
        F.count("*").alias("n"))


@query("P17_input_contract", (
    f"{M}, d as (select match_id, {_DIRTY} from m) select count(*) as rows, count(*) filter (where date='soon') as bad_dates, count(*)<10 as few_rows from d"))
def input_contract(spark, sf_dir):
    return clean.check_input(dirty(spark, sf_dir))


@query("P18_training_contract", (
    f"{M}, {SCORED}, t as (select match_id, {_H1} as a, home_score as b, {_HDA} as result from m2) select count(*) as rows,"
    " count(distinct result) as classes, 0::bigint as unlabelled,"
    f" {r('(count(*) filter (where a is null))/(count(*)*2.0)')} as missing_ratio, (count(*) filter (where a is null))/(count(*)*2.0)>0.5 as mostly_missing, true as ok from t"))
def training_contract(spark, sf_dir):
    t = clean.with_score_columns(clean.clean(matches(spark, sf_dir))).selectExpr(
        "match_id", f"{_H1} as a", "home_score as b", "result")
    return rounded(clean.check_training(t, ["a", "b"], "result"))


@query("P20_essential_columns", f"{M} select home_score, away_score, home_team, away_team, date, season from m")
def essential(spark, sf_dir):
    from touchline.operators.selection import keep_selected
    return keep_selected(matches(spark, sf_dir), ["season"])


# --- joins -------------------------------------------------------------------------------------

_VAR = "lower(replace(team, ' ', ''))"
TEAMS_SQL = "t as (select home_team as team from m union select away_team from m)"


def registry_rows(spark, sf_dir):
    t = aggregates.team_names(matches(spark, sf_dir))
    return t.select(F.explode(F.array(
        F.col("team"), F.lower("team"), text.normalise_name(F.col("team")))).alias("variation"),
        F.col("team").alias("canonical")).distinct()


@query("J04_name_lookup", (
    f"{M}, {TEAMS_SQL}, g as (select distinct unnest([team, lower(team), {_VAR}]) as variation, team as canonical from t),"
    " a as (select match_id, case match_id%3 when 0 then home_team when 1 then lower(home_team) else 'the '||home_team end as asked from m)"
    " select a.match_id, a.asked, g.canonical from a left join g on g.variation=a.asked"))
def name_lookup(spark, sf_dir):
    from touchline.operators.names import lookup
    asked = matches(spark, sf_dir).selectExpr(
        "match_id", "case match_id%3 when 0 then home_team when 1 then lower(home_team) else 'the '||home_team end as asked")
    return lookup(asked, "asked", registry_rows(spark, sf_dir)).select("match_id", "asked", "canonical")


@query("J06_resume_anti_join", f"{M} select 'k'||cast(match_id as varchar) as id from m where season<>'{SEASON}'")
def resume(spark, sf_dir):
    found = matches(spark, sf_dir).select(F.concat(
        F.lit("https://www.example.com/g/k"), F.col("match_id").cast("string"), F.lit("#/s")).alias("url"))
    # the id is the last path part cut at its fragment; here the fragment holds a slash
    ids = found.select(F.regexp_extract("url", "/g/([^#]*)", 1).alias("id"))
    have = documents.list_matches(spark, document_store(spark, sf_dir), SEASON).select(
        F.concat(F.lit("k"), F.col("match_id")).alias("id"))
    return ids.join(have, "id", "left_anti")


@query("J09_append_probes", f"{M} select count(*)*2 as rows, count(*) as scheduled_probes from m")
def append_probes(spark, sf_dir):
    m = matches(spark, sf_dir)
    probes = m.select((F.col("match_id") + 10**12).alias("match_id"), "date", "home_team", "away_team",
                      F.lit("PROBE").alias("status"))
    return m.unionByName(probes, allowMissingColumns=True).agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "PROBE").alias("scheduled_probes"))


# --- aggregations ------------------------------------------------------------------------------

TEAM_TABLE_SQL = (
    f"{M}, a as (select home_team as team, true as ih, home_score as gf, away_score as ga from m union all"
    " select away_team, false, away_score, home_score from m), b as (select team, count(*) as n, count(*) filter (where gf>ga) as w,"
    " count(*) filter (where gf=ga) as d, coalesce(sum(gf),0)::bigint as gs, coalesce(sum(ga),0)::bigint as gc, count(*) filter (where ih) as hm,"
    " count(*) filter (where not ih) as am, count(*) filter (where ih and gf>ga) as hw, count(*) filter (where not ih and gf>ga) as aw from a group by team),"
    " tt as (select team, n as total_matches, w as wins, d as draws, n-w-d as losses, w/n as win_rate, d/n as draw_rate, (n-w-d)/n as loss_rate,"
    " gs as goals_scored, gc as goals_conceded, gs/n as goals_per_game, gc/n as conceded_per_game, gs-gc as goal_difference,"
    " hm as home_matches, am as away_matches, coalesce(hw/nullif(hm,0),0) as home_win_rate, coalesce(aw/nullif(am,0),0) as away_win_rate from b)")
_RATES = ["win_rate", "draw_rate", "loss_rate", "goals_per_game", "conceded_per_game", "home_win_rate", "away_win_rate"]


@query("A01_team_table", TEAM_TABLE_SQL + " select team, total_matches, wins, draws, losses, goals_scored, goals_conceded,"
       " goal_difference, home_matches, away_matches, " + ", ".join(f"{r(c)} as {c}" for c in _RATES) + " from tt")
def team_table(spark, sf_dir):
    return rounded(aggregates.team_table(match_sides(matches(spark, sf_dir))))


@query("A02_mean_odds", A02_SQL)
def mean_odds(spark, sf_dir):
    return rounded(aggregates.mean_odds(odds_quotes(spark, sf_dir), PRICES))


@query("A03_distinct_counts", (
    f"{M}, {TEAMS_SQL} select count(distinct match_id) as matches, count(distinct competition) as competitions, (select count(*) from t) as teams from m"))
def distinct_counts(spark, sf_dir):
    return aggregates.distinct_counts(matches(spark, sf_dir))


@query("A04_result_shares", (
    f"{M}, {SCORED}, g as (select {_HDA} as result, count(*) as n from m2 group by 1) select result, n, {r('n/(select sum(n) from g)')} as share from g"))
def result_shares(spark, sf_dir):
    return rounded(aggregates.shares(clean.with_score_columns(matches(spark, sf_dir)), "result"))


@query("A05_describe", (
    f"{M}, {SCORED}, w as (select {_WEIGHT_SQL} as w from m2) select 'temporal_weight' as column, count(*) as count, {r('avg(w)')} as mean,"
    f" {r('stddev_samp(w)')} as std, {r('min(w)')} as min, {r('quantile_cont(w, 0.25)')} as q25, {r('quantile_cont(w, 0.5)')} as median,"
    f" {r('quantile_cont(w, 0.75)')} as q75, {r('max(w)')} as max from w"))
def describe(spark, sf_dir):
    return rounded(aggregates.describe(weighted(spark, sf_dir), ["temporal_weight"]))


_QUALITY = {"home_score": "home_score", "away_score": "away_score", "p": _H1}


@query("A06_missing_cells", f"{M}, f as (select home_score, away_score, {_H1} as p from m) select sum(c)::bigint as missing, count(*)*max(n) as cells,"
       f" {r('sum(c)/(count(*)*max(n))')} as ratio from (values " + ",".join(
           f"((select count(*) filter (where {c} is null) from f), (select count(*) from f))" for c in _QUALITY) + ") v(c, n)")
def missing_cells(spark, sf_dir):
    f = matches(spark, sf_dir).selectExpr("home_score", "away_score", f"{_H1} as p")
    q = clean.column_quality(f, list(_QUALITY))
    return rounded(q.agg(F.sum("nulls").alias("missing"), F.sum("rows").alias("cells")).withColumn(
        "ratio", F.col("missing") / F.col("cells")))


@query("A07_infinite_cells", (
    f"with {ODDS_SQL} select 'ratio' as column, count(*) filter (where l=0) as infinities from (select l_discount as l from lineitem)"))
def infinite_cells(spark, sf_dir):
    ratio = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1 / F.col("l_discount")).alias("ratio"))
    return clean.column_quality(ratio, ["ratio"]).select("column", "infinities")


@query("A08_low_variance", (
    f"{M}, f as (select home_score, 1 as one from m where home_score is not null) select 'home_score' as column, {r('var_samp(home_score)')} as variance,"
    f" false as low from f union all select 'one', {r('var_samp(one)')}, true from f"))
def low_variance(spark, sf_dir):
    f = matches(spark, sf_dir).where("home_score is not null").selectExpr("home_score", "1 as one")
    return rounded(clean.column_quality(f, ["home_score", "one"]).select(
        "column", "variance", (F.col("variance") < 1e-10).alias("low")))


@query("A09_coverage", f"{M} select min(date) as first_date, max(date) as last_date, date_diff('day', min(date), max(date))::int as days from m")
def coverage(spark, sf_dir):
    return aggregates.coverage(matches(spark, sf_dir))


@query("A10_weighting_info", (
    f"{M}, {SCORED}, w as (select date, {_WEIGHT_SQL} as w from m2) select min(date) as first_date, max(date) as last_date, {r('min(w)')} as min_weight,"
    f" {r('max(w)')} as max_weight, {r('avg(w)')} as avg_weight, {r('avg(case when w>0.8 then 1.0::double else 0.0 end)')} as recent_data_ratio from w"))
def weighting_info(spark, sf_dir):
    return rounded(weights.weighting_info(weighted(spark, sf_dir)))


@query("A11_team_list", f"{M}, {TEAMS_SQL} select team from t")
def team_list(spark, sf_dir):
    return aggregates.team_names(matches(spark, sf_dir)).orderBy("team")


@query("A12_column_medians", (
    "select 'o_totalprice' as column, median(o_totalprice) as median from orders union all select 'o_custkey', median(o_custkey) from orders"))
def column_medians(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = clean.exact_medians(orders, ["o_totalprice", "o_custkey"])
    return orders.agg(F.lit(1)).select(F.explode(F.create_map(*[
        x for c, v in found.items() for x in (F.lit(c), F.lit(float(v)))])).alias("column", "median"))


@query("A13_market_summary", (
    f"with {ODDS_SQL} select 'match_winner' as market, count(*)*3 as entries, count(distinct match_id) as matches from q"))
def market_summary(spark, sf_dir):
    return aggregates.market_summary(aggregates.long_odds(odds_quotes(spark, sf_dir)))


_STATUS = "case when match_id%50=0 then 'failed' when home_score is null then 'skipped' else 'successful' end"


@query("A14_run_summary", (
    f"{M}, l as (select {_STATUS} as s from m) select count(*) as total, count(*) filter (where s='successful') as successful,"
    f" count(*) filter (where s='failed') as failed, count(*) filter (where s='skipped') as skipped,"
    f" {r('100.0*count(*) filter (where s=' + chr(39) + 'successful' + chr(39) + ')/count(*)')} as success_rate from l"))
def run_summary(spark, sf_dir):
    return rounded(aggregates.run_summary(matches(spark, sf_dir).selectExpr(f"{_STATUS} as status")))


# --- sorts, limits, sets -----------------------------------------------------------------------

@query("O01_sort_by_date", f"{M} select match_id, date from m")
def sort_by_date(spark, sf_dir):
    return matches(spark, sf_dir).select("match_id", "date").orderBy("date", "match_id")


@query("O02_last_rows_per_team", (
    f"{M}, a as (select match_id, date, home_team as team from m where home_score is not null union all select match_id, date, away_team from m where home_score is not null)"
    " select team, match_id, date from a qualify row_number() over (partition by team order by date desc, match_id desc) <= 10"))
def last_rows(spark, sf_dir):
    from pyspark.sql.window import Window
    sides = match_sides(matches(spark, sf_dir)).where("finished")
    newest = Window.partitionBy("team").orderBy(F.col("date").desc(), F.col("match_id").desc())
    return sides.withColumn("rn", F.row_number().over(newest)).where("rn <= 10").select("team", "match_id", "date")


@query("O05_name_suggestions", (
    f"{M}, {TEAMS_SQL} select team from t where contains(replace(lower(trim(team)),' ',''), replace(lower(trim(' Real m ')),' ','')) order by team limit 10"))
def suggestions(spark, sf_dir):
    from touchline.operators.names import suggest
    return suggest(aggregates.team_names(matches(spark, sf_dir)), " Real m ")


@query("O08_first_matches", f"{M} select match_id from m order by match_id limit 25")
def first_matches(spark, sf_dir):
    return matches(spark, sf_dir).select("match_id").orderBy("match_id").limit(25)


_BADNAME = "case when match_id%60=0 then 'nan' when match_id%61=0 then '' when match_id%62=0 then 'None' else home_team end"


@query("U01_team_union", (
    f"{M}, t as (select {_BADNAME} as team from m union select away_team from m) select team from t where team is not null and team not in ('nan','None','')"))
def team_union(spark, sf_dir):
    return aggregates.team_names(matches(spark, sf_dir).selectExpr(f"{_BADNAME} as home_team", "away_team"))


# --- weights -----------------------------------------------------------------------------------

@query("D60_temporal_weight", (
    f"{M} select match_id, {r(f'greatest(exp(-0.001*date_diff({chr(39)}day{chr(39)}, date, {AS_OF_SQL})), 0.1)')} as weight,"
    f" {r(_WEIGHT_SQL)} as pipeline_weight from m"))
def temporal_weight(spark, sf_dir):
    return rounded(matches(spark, sf_dir).select(
        "match_id", weights.temporal_weight(F.col("date"), F.lit(AS_OF)).alias("weight"),
        weights.temporal_weight(F.col("date"), F.lit(AS_OF), weights.PIPELINE_DECAY_RATE).alias("pipeline_weight")))


@query("D61_weight_flags", f"{M}, {SCORED} select match_id, {_WEIGHT_SQL}>0.8 as is_recent, {_WEIGHT_SQL}<0.3 as is_historical from m2")
def weight_flags(spark, sf_dir):
    return weighted(spark, sf_dir).select("match_id", "is_recent", "is_historical")


@query("D62_weight_quartiles", (
    f"{M}, {SCORED}, w as (select match_id, {_WEIGHT_SQL} as w from m2), e as (select quantile_cont(w, [0.25,0.5,0.75]) as e from w)"
    " select match_id, case when w<=e[1] then 'Q1' when w<=e[2] then 'Q2' when w<=e[3] then 'Q3' else 'Q4' end as weight_quartile from w, e"))
def weight_quartiles(spark, sf_dir):
    return weights.with_quartiles(weighted(spark, sf_dir)).select("match_id", "weight_quartile")


# --- document serialisation --------------------------------------------------------------------

def _quotes_sql() -> str:
    """All quotes of all markets: match_id, market, bookmaker, ts, period and every value."""
    winner = {"home_win": "1.2+l_quantity/10", "draw": "2.0+l_discount*10", "away_win": "1.5+l_tax*50"}
    totals = {"total": TOTAL_SQL, "over": "(1.2+l_quantity/10)*0.5+1", "under": "(1.5+l_tax*50)*0.5+1"}
    parts = [("match_winner", "'Full Time'", winner, "true"), ("over_under", PERIOD_SQL, totals, "true")]
    parts += [(m, PERIOD_SQL, v, f"(l_orderkey+l_linenumber)%7={i}") for i, (m, v) in enumerate(OTHER_MARKETS.items())]
    selects = []
    for market, period, values, where in parts:
        cols = ", ".join(f"cast({values.get(n, 'null')} as {'varchar' if n in quotes.LABELS else 'double'}) as {n}" for n in quotes.VALUES)
        selects.append(f"select l_orderkey as match_id, '{market}' as market, 'BOOK_' || (l_suppkey%8)::varchar as bookmaker,"
                       f" cast(l_shipdate as timestamp) as ts, {period} as period, {cols} from lineitem where {where}")
    return "aq as (" + " union all ".join(selects) + ")"


@query("F22_serialise_odds", (
    f"with {_quotes_sql()} select match_id, market, bookmaker, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, period, "
    + ", ".join(n if n in quotes.LABELS else f"{r(n)} as {n}" for n in quotes.VALUES) + " from aq"))
def serialise_odds(spark, sf_dir):
    """Every quote, read back from the JSON text of the nested market lists."""
    texts = quotes.exported(quotes_of(spark, sf_dir)).select("match_id", F.to_json("odds").alias("odds"))
    nested = texts.select("match_id", F.from_json("odds", ODDS_SCHEMA).alias("odds"))
    back = quotes.unnested(nested)
    return rounded(back.select(F.col("match_id").cast("bigint").alias("match_id"), "market", "bookmaker",
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "period", *quotes.VALUES))


_ALL_PRICES = "+".join(f"coalesce({p}, 0)" for p in quotes.PRICES)


@query("F23_dispatch_odds", (
    f"with {_quotes_sql()} select match_id, market, count(*) as quotes, count(distinct bookmaker) as bookmakers,"
    f" {r('sum(' + _ALL_PRICES + ')')} as prices, max(ts) as newest, {r('sum(coalesce(total, handicap))')} as lines,"
    " max(coalesce(score, result_combination)) as last_label from aq group by match_id, market"))
def dispatch_odds(spark, sf_dir):
    """Raw quote records to the lists of the nine markets, described by their counts and sums."""
    found = market_quotes(spark, sf_dir)
    totals = quotes.summary(found, ["match_id", "market"])
    labels = found.groupBy("match_id", "market").agg(
        F.countDistinct("bookmaker").alias("bookmakers"), F.sum(F.coalesce("total", "handicap")).alias("lines"),
        F.max(F.coalesce("score", "result_combination")).alias("last_label"))
    prices = sum((F.coalesce(f"{p}_sum", F.lit(0.0)) for p in quotes.PRICES), F.lit(0.0))
    return rounded(totals.join(labels, ["match_id", "market"]).select(
        F.col("match_id").cast("bigint").alias("match_id"), "market", "quotes", "bookmakers", prices.alias("prices"),
        F.col("newest.ts").cast("timestamp_ntz").alias("newest"), "lines", "last_label"))
