"""Queries M01..M32, B01..B05, F19..F21, S17..S19, O03, O06, O07, U02, U03, D63..D66, P19, T01, T02."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from touchline.functions import probability
from touchline.operators import (
    aggregates, betting, clean, ensemble, folds, metrics, models, predict, search, selection, snapshot,
)
from touchline.operators.asof import match_sides
from touchline.plans import catalogue
from touchline.plans.loader_queries import PRICES, TEAM_TABLE_SQL, _HDA, flat, flat_sql
from touchline.plans.oracle_text import snapshot_sql
from touchline.plans.registry import query, r, rounded
from touchline.plans.temporal_queries import ROLLING_SQL, TEMPORAL_SNAP, TEMPORAL_SQL, rolling_parts, sided
from touchline.schemas import STATISTICS
from touchline.session import fresh_dir, stored
from touchline.sources import documents
from touchline.sources.match_documents import stat_sql
from touchline.sources.views import MATCHES_SQL, ODDS_SQL, matches, odds_quotes, table

M = f"with {MATCHES_SQL}"
AS_OF = datetime.date(2001, 8, 2)
FAMILIES = ["rolling", "momentum"]
MODEL_FEATURES = (
    [f"diff_{s}_{n}g" for n in (5, 20) for s in (
        "goals_per_game", "goals_conceded_per_game", "win_rate", "points_per_game", "clean_sheet_rate")]
    + ["diff_momentum_points", "diff_consistency", "h2h_home_team_win_rate", "h2h_away_team_win_rate",
       "rivalry_intensity"])
FOLDS = 5
_TABLES: dict[tuple[str, str], object] = {}
_MODELS: dict[tuple[str, str, str], models.OutcomeModel] = {}


def feature_rows(spark, sf_dir):
    """Training features of every match, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        m = matches(spark, sf_dir)
        f = snapshot.match_features(m, FAMILIES + ["form"], F.lit(AS_OF))
        label = clean.result_hda(F.col("home_score"), F.col("away_score"))
        _TABLES[key] = stored(f.select("match_id", "date", "home_team", "away_team", "home_score", "away_score",
                                       label.alias("label"), *MODEL_FEATURES), "features", models.FIT_PARTITION)
    return _TABLES[key]


def labelled(spark, sf_dir):
    return feature_rows(spark, sf_dir).where(F.col("label").isNotNull())


def trained(spark, sf_dir, kind):
    """The model of a kind on all labelled rows, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MODELS:
        _MODELS[key] = models.fit(kind, labelled(spark, sf_dir), MODEL_FEATURES)
    return _MODELS[key]


# --- two deterministic probability sources, so that metrics have an oracle ------------------------

PRED_SQL = (
    f"{TEAM_TABLE_SQL}, {ODDS_SQL}, o as (select match_id, 1/avg(home_win) as h, 1/avg(draw) as d, 1/avg(away_win) as a from q group by match_id),"
    f" lb as (select match_id, date, home_team, away_team, {_HDA} as label from m where home_score is not null),"
    " raw as (select lb.*, 'book' as model, h, d, a from lb join o using (match_id) union all"
    " select lb.*, 'table', x.home_win_rate, (x.draw_rate+y.draw_rate)/2, y.away_win_rate from lb join tt x on x.team=home_team join tt y on y.team=away_team),"
    " pr as (select match_id, date, label, model, h/(h+d+a) as p_H, d/(h+d+a) as p_D, a/(h+d+a) as p_A from raw),"
    " pd as (select *, case when p_H>=p_D and p_H>=p_A then 'H' when p_D>=p_A then 'D' else 'A' end as predicted, greatest(p_H,p_D,p_A) as confidence,"
    " (match_id%5)::int as fold from pr)")


def predictions(spark, sf_dir):
    m = clean.with_score_columns(matches(spark, sf_dir)).where(F.col("result").isNotNull()).select(
        "match_id", "date", "home_team", "away_team", F.col("result").alias("label"))
    odds = aggregates.mean_odds(odds_quotes(spark, sf_dir), PRICES)
    inverse = [aggregates.implied_probability(F.col(f"odds_{p}")) for p in PRICES]
    keys = ["match_id", "date", "label"]
    book = m.join(odds, "match_id").select(
        *keys, F.lit("book").alias("model"), *[p.alias(c) for p, c in zip(inverse, "hda", strict=True)])
    t = aggregates.team_table(match_sides(matches(spark, sf_dir))).select(
        "team", "home_win_rate", "draw_rate", "away_win_rate")
    x, y = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for s in ("x", "y"))
    league = m.join(F.broadcast(x), F.col("home_team") == F.col("x_team")).join(
        F.broadcast(y), F.col("away_team") == F.col("y_team")).select(
        *keys, F.lit("table").alias("model"), F.col("x_home_win_rate").alias("h"),
        ((F.col("x_draw_rate") + F.col("y_draw_rate")) / 2).alias("d"), F.col("y_away_win_rate").alias("a"))
    both = book.unionByName(league)
    parts = probability.normalised([F.col("h"), F.col("d"), F.col("a")])
    out = both.select(*keys, "model", *[p.alias(f"p_{o}") for p, o in zip(parts, probability.OUTCOMES, strict=True)])
    cols = [F.col(f"p_{o}") for o in probability.OUTCOMES]
    return out.withColumn("predicted", probability.best_outcome(cols)).withColumn(
        "confidence", F.greatest(*cols)).withColumn("fold", (F.col("match_id") % 5).cast("int"))


@query("F19_entropy", PRED_SQL + (
    f" select match_id, model, {r('-(p_H*log2(p_H)+p_D*log2(p_D)+p_A*log2(p_A))')} as entropy, {r('confidence')} as max_probability from pd"))
def entropy(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(p.select("match_id", "model", probability.entropy_bits(F.array("p_H", "p_D", "p_A")).alias("entropy"),
                            F.col("confidence").alias("max_probability")))


@query("F20_uncertainty", PRED_SQL + (
    ", e as (select match_id, model, -(p_H*log2(p_H)+p_D*log2(p_D)+p_A*log2(p_A)) as h from pd)"
    " select model, case when h<1 then 'Low' when h<1.5 then 'Medium' else 'High' end as uncertainty, count(*) as n from e group by all"))
def uncertainty(spark, sf_dir):
    return predict.described(predictions(spark, sf_dir)).groupBy("model", "uncertainty").agg(F.count("*").alias("n"))


@query("F21_renormalise", (
    f"{M}, x as (select match_id, (match_id%3)/10.0 as a, (match_id%2)/5.0 as b, (match_id%5)/20.0 as c from m) select match_id, "
    + ", ".join(f"{r(f'case when a+b+c>0 then {v}/(a+b+c) else 1.0/3 end')} as p_{o}" for v, o in zip("abc", "HDA", strict=True)) + " from x"))
def renormalise(spark, sf_dir):
    x = matches(spark, sf_dir).selectExpr(
        "match_id", "cast(match_id%3 as double)/10 as a", "cast(match_id%2 as double)/5 as b", "cast(match_id%5 as double)/20 as c")
    parts = probability.normalised([F.col(c) for c in "abc"])
    return rounded(x.select("match_id", *[p.alias(f"p_{o}") for p, o in zip(parts, "HDA", strict=True)]))


@query("M01_label_encoding", f"{M} select match_id, case {_HDA} when 'A' then 0.0::double when 'D' then 1.0 when 'H' then 2.0 end as label_index from m where home_score is not null")
def label_encoding(spark, sf_dir):
    m = clean.with_score_columns(matches(spark, sf_dir)).where("result is not null")
    return m.select("match_id", F.col("result").alias("label")).select("match_id", models.label_index().alias("label_index"))


def _kept(spark, sf_dir, name, build):
    """A table made once per session, for the queries that look at it from several sides."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = stored(build(), name)
    return _TABLES[key]


def _fitted(kind):
    def build(spark, sf_dir):
        split = folds.stratified_split(labelled(spark, sf_dir), "label", "match_id")
        model = models.fit(kind, split.where("is_train"), MODEL_FEATURES)
        out = model.transform(split.where(~F.col("is_train")))
        return out.select("match_id", "label", "predicted", "confidence", "p_H", "p_D", "p_A")

    def run(spark, sf_dir):
        return rounded(_kept(spark, sf_dir, f"held-out-{kind}", lambda: build(spark, sf_dir)))
    return run


def sound(out, *by):
    """Rows by ``by`` and how many of them have three probabilities that sum to 1, the likeliest outcome as
    prediction, and its probability as confidence."""
    parts = [F.col(f"p_{o}") for o in probability.OUTCOMES]
    total, most = parts[0] + parts[1] + parts[2], F.greatest(*parts)
    likeliest = F.when(F.col("predicted") == "H", F.col("p_H")).when(F.col("predicted") == "D", F.col("p_D")).otherwise(F.col("p_A"))
    return out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-6).alias("sums"),
        F.count_if(F.least(*parts) >= 0).alias("positive"), F.count_if(F.abs(likeliest - most) < 1e-6).alias("likeliest"),
        F.count_if(F.abs(F.col("confidence") - most) < 1e-6).alias("confident"))


def _sound_sql(rows: str, by: str) -> str:
    """``rows``: SQL giving ``by`` and n; all of them are sound."""
    return f"{M}, l as (select {_HDA} as label, * from m where home_score is not null) select {by}, n, n as sums, n as positive, n as likeliest, n as confident from ({rows})"


_HELD_SQL = "select label, count(*) - round(count(*)*0.8::double)::bigint as n from l group by label"


for _name, _kind in {"M02_forest": "forest", "M03_boosted_a": "boosted_a", "M04_boosted_b": "boosted_b"}.items():
    query(_name)(_fitted(_kind))


def _held_out_soundness(kind):
    return lambda spark, sf_dir: sound(_fitted(kind)(spark, sf_dir), "label")


for _name, _kind in {"M02_forest_soundness": "forest", "M03_boosted_a_soundness": "boosted_a", "M04_boosted_b_soundness": "boosted_b"}.items():
    query(_name, _sound_sql(_HELD_SQL, "label"))(_held_out_soundness(_kind))


@query("M05_batch_soundness", (
    f"{M}, l as (select coalesce({_HDA}, 'scheduled') as label from m) select label, count(*) as n, count(*) as sums, count(*) as positive,"
    " count(*) as likeliest, count(*) as confident from l group by label"))
def batch_soundness(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    out = trained(spark, sf_dir, "forest").transform(rows)
    return sound(out.withColumn("label", F.coalesce("label", F.lit("scheduled"))), "label")


@query("M05_predict_batch")
def predict_batch(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    model = trained(spark, sf_dir, "forest")
    return rounded(model.transform(rows).select("match_id", "predicted", "confidence", "p_H", "p_D", "p_A"))


@query("M06_parameter_search")
def parameter_search(spark, sf_dir):
    return rounded(_kept(spark, sf_dir, "search", lambda: search.search_forests(labelled(spark, sf_dir), MODEL_FEATURES)[1]))


@query("M06_search_coverage", f"{M} select t::int as trial, (select count(*) from m where home_score is not null) as rows, true as scored from range(50) r(t)")
def search_coverage(spark, sf_dir):
    """Every trial is scored once on every row of the search's table (all labelled rows up to ``SEARCH_ROWS``)."""
    trials = parameter_search(spark, sf_dir)
    return trials.select("trial", "rows", F.col("accuracy").between(0.0, 1.0).alias("scored"))


@query("M07_stratified_folds", (
    f"{M}, c as (select {_HDA} as label, count(*) as n from m where home_score is not null group by 1)"
    " select label, f::int as fold, (n//5 + case when f < n%5 then 1 else 0 end)::bigint as n from c, range(5) t(f)"))
def stratified_folds(spark, sf_dir):
    m = clean.with_score_columns(matches(spark, sf_dir)).where("result is not null")
    out = folds.stratified_folds(m.select("match_id", F.col("result").alias("label")), "label", "match_id")
    return out.groupBy("label", "fold").agg(F.count("*").alias("n"))


_IDX = (f"{M}, x as (select match_id, date, row_number() over (order by date, match_id)-1 as i, count(*) over () as n from m where home_score is not null),"
        " f as (select *, k from x, range(5) t(k))")


def indexed(spark, sf_dir):
    return folds.time_index(matches(spark, sf_dir).where("home_score is not null").select("match_id", "date"))


def _fold_table(rows):
    return rows.groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("M08_expanding_folds", _IDX + (
    ", g as (select date, k::int as fold, case when i >= n-(5-k)*(n//6) and i < n-(4-k)*(n//6) then 'test' when i < n-(5-k)*(n//6) then 'train' end as part from f)"
    " select fold, part, count(*) as n, min(date) as first_date, max(date) as last_date from g where part is not null group by all"))
def expanding(spark, sf_dir):
    return _fold_table(folds.expanding_folds(indexed(spark, sf_dir), 5))


@query("M09_blocked_folds", _IDX + (
    ", g as (select date, k::int as fold, case when i >= k*(n//5) and i < (k+1)*(n//5) then 'test' when k=0 and i >= n//5 and i < 3*(n//5) then 'train'"
    " when k>0 and i < k*(n//5) then 'train' end as part from f) select fold, part, count(*) as n, min(date) as first_date, max(date) as last_date"
    " from g where part is not null group by all"))
def blocked(spark, sf_dir):
    return _fold_table(folds.blocked_folds(indexed(spark, sf_dir), 5))


_REPORT = (
    ", cl as (select unnest(['H','D','A']) as class), cr as (select {by} cl.class, count(*) filter (where label=class and predicted=class) as tp,"
    " count(*) filter (where label=class) as support, count(*) filter (where predicted=class) as claimed from pd, cl group by {by} cl.class),"
    " rp as (select *, coalesce(tp/nullif(claimed,0),0) as precision, coalesce(tp/nullif(support,0),0) as recall,"
    " coalesce(2*tp/nullif(claimed+support,0),0) as f1 from cr where claimed+support>0)")


@query("M10_fold_scores", PRED_SQL + _REPORT.format(by="model, fold,") + (
    ", ms as (select model, fold, sum(tp)/sum(support) as accuracy, avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro from rp group by all)"
    " select model, " + ", ".join(f"{r(f'avg({s})')} as {s}_mean, {r(f'stddev_pop({s})')} as {s}_std"
                                  for s in ("accuracy", "precision_macro", "recall_macro", "f1_macro")) + " from ms group by model"))
def fold_scores(spark, sf_dir):
    return rounded(metrics.fold_summary(metrics.macro_scores(predictions(spark, sf_dir), ["model", "fold"])))


@query("M11_class_report", PRED_SQL + _REPORT.format(by="model,") + (
    f" select model, class, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, support, tp from rp"))
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(predictions(spark, sf_dir), ["model"]))


@query("M11_confusion_matrix", PRED_SQL + " select model, label, predicted, count(*) as n from pd group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["model"])


_PL = "case label when 'H' then p_H when 'D' then p_D else p_A end"


def _auc(i, j):
    return (f"select model, '{i}{j}' as pair, (sum(rk) filter (where label='{i}') - np*(np+1)/2.0)/(np*nn::double) as auc from (select model, label,"
            f" avg(rn) over (partition by model, p_{i}) as rk, count(*) filter (where label='{i}') over (partition by model) as np,"
            f" count(*) filter (where label='{j}') over (partition by model) as nn from (select *, row_number() over (partition by model order by p_{i}) as rn"
            f" from pd where label in ('{i}','{j}'))) group by model, np, nn")


@query("M12_log_loss_auc", PRED_SQL + ", au as (" + " union all ".join(
    _auc(i, j) for i in "HDA" for j in "HDA" if i != j) + (
    f"), ll as (select model, {r(f'avg(-ln(least(greatest({_PL},1e-15),1-1e-15)))')} as log_loss from pd group by model)"
    f" select ll.model, log_loss, (select {r('avg(auc)')} from au where au.model=ll.model) as auc_ovo from ll"))
def log_loss_auc(spark, sf_dir):
    p = predictions(spark, sf_dir)
    loss = p.groupBy("model").agg(metrics.log_loss().alias("log_loss"))
    return rounded(loss.join(metrics.pairwise_auc(p), "model"))


_VOTE = ", vt as (select match_id, label, avg(p_H) as p_H, avg(p_D) as p_D, avg(p_A) as p_A, count(*) as models, arg_max(model, confidence) as surest_model from pd group by match_id, label)"
_VOTED = "case when p_H>=p_D and p_H>=p_A then 'H' when p_D>=p_A then 'D' else 'A' end"


@query("M13_soft_voting", PRED_SQL + _VOTE + (
    f" select match_id, label, {r('p_H')} as p_H, {r('p_D')} as p_D, {r('p_A')} as p_A, {_VOTED} as predicted, {r('greatest(p_H,p_D,p_A)')} as confidence from vt"))
def soft_voting(spark, sf_dir):
    return rounded(ensemble.averaged(predictions(spark, sf_dir), ["match_id"]).select(
        "match_id", "label", "p_H", "p_D", "p_A", "predicted", "confidence"))


def _stacked(spark, sf_dir):
    """Predictions for held-out rows: the combiner learns from out-of-fold predictions on the training rows,
    the base models are then fitted on all of those."""
    split = stored(folds.stratified_split(labelled(spark, sf_dir), "label", "match_id"), "split", models.FIT_PARTITION)
    train, test = split.where("is_train"), split.where("not is_train")
    folded = stored(folds.stratified_folds(train, "label", "match_id", FOLDS), "folds", models.FIT_PARTITION)
    kinds = ["forest", "boosted_a"]
    wanted = [(kind, train, MODEL_FEATURES) for kind in kinds]
    fitted = models.fit_all(wanted + [w for kind in kinds for w in models.without_folds(kind, folded, MODEL_FEATURES, FOLDS)])
    bases, others = fitted[:len(kinds)], iter(fitted[len(kinds):])
    learned = [models.out_of_fold(kind, folded, MODEL_FEATURES, FOLDS, fitted=[next(others) for _ in range(FOLDS)]) for kind in kinds]
    asked = [base.transform(test).select("match_id", "label", "model", "predicted", "confidence", "p_H", "p_D", "p_A") for base in bases]
    stacked = ensemble.Stacked(kinds).fit(stored(learned[0].unionByName(learned[1]), "oof"))
    answers = stored(asked[0].unionByName(asked[1]), "asked")
    return stacked.transform(answers).select("match_id", "label", "predicted", "confidence", "p_H", "p_D", "p_A")


@query("M14_stacking")
def stacking(spark, sf_dir):
    return rounded(_kept(spark, sf_dir, "stacked", lambda: _stacked(spark, sf_dir)).drop("confidence"))


@query("M14_stacking_soundness", _sound_sql(_HELD_SQL, "label"))
def stacking_soundness(spark, sf_dir):
    return sound(_kept(spark, sf_dir, "stacked", lambda: _stacked(spark, sf_dir)), "label")


@query("M15_model_weights", PRED_SQL + (
    ", fa as (select model, fold, avg(case when label=predicted then 1.0::double else 0.0 end) as acc from pd group by all), ma as (select model, avg(acc) as accuracy from fa group by model)"
    f" select model, {r('accuracy')} as accuracy, {r('accuracy/(select sum(accuracy) from ma)')} as weight from ma"))
def model_weights(spark, sf_dir):
    return rounded(ensemble.model_weights(metrics.macro_scores(predictions(spark, sf_dir), ["model", "fold"])))


_NULLS = " + ".join(f"case when match_id%17={i} then 1 else 0 end" for i in range(len(STATISTICS)))


@query("M16_dynamic_selection", (
    f"{M}, x as (select match_id, ({_NULLS})/15.0 as missing from m), k as (select * from (values ('boosted_a', 0.50::double), ('boosted_b', 0.49::double), ('forest', 0.52::double)) t(model, accuracy)),"
    " s as (select match_id, model, least(0.5+accuracy*0.4+case when model='boosted_b' and missing>0.1 then 0.1 when model='forest' then 0.05 else 0.0 end, 1.0) as score from x, k)"
    f" select match_id, arg_max(model, score*1000) as model, {r('max(score)')} as score from s group by match_id"))
def dynamic_selection(spark, sf_dir):
    columns = [f"s{i}" for i in range(len(STATISTICS))]
    rows = matches(spark, sf_dir).selectExpr(
        "match_id", *[f"{stat_sql(s)[0]} as s{i}" for i, s in enumerate(STATISTICS)])
    rows = rows.select("match_id", metrics.missing_share(rows, columns).alias("missing"))
    scores = spark.createDataFrame([("boosted_a", 0.50), ("boosted_b", 0.49), ("forest", 0.52)], "model string, accuracy double")
    return rounded(ensemble.select_model(rows, scores, len(columns)))


@query("M17_averaged_ensemble", PRED_SQL + _VOTE + (
    f" select match_id, models, surest_model, {_VOTED} as predicted, {r('greatest(p_H,p_D,p_A)')} as confidence from vt"))
def averaged_ensemble(spark, sf_dir):
    return rounded(ensemble.averaged(predictions(spark, sf_dir), ["match_id"]).select(
        "match_id", "models", "surest_model", "predicted", "confidence"))


def _asked(spark, sf_dir):
    """Every scheduled fixture, its names spelled in several ways, some unknown."""
    return matches(spark, sf_dir).where("home_score is null").selectExpr(
        "match_id", "date", "case match_id%4 when 0 then upper(home_team) when 1 then replace(home_team, ' ', '') when 2 then home_team"
        " else case when match_id%11=0 then 'Nowhere XI' else lower(home_team) end end as home_asked", "away_team as away_asked")


def _trained(spark, sf_dir):
    return {kind: trained(spark, sf_dir, kind) for kind in ("forest", "boosted_a")}


def _predicted(spark, sf_dir):
    medians = clean.exact_medians(feature_rows(spark, sf_dir), MODEL_FEATURES)
    return predict.predict_fixtures(_asked(spark, sf_dir), matches(spark, sf_dir), FAMILIES + ["form"], F.lit(AS_OF), medians,
                                    _trained(spark, sf_dir))


@query("M18_predict_fixtures")
def predict_fixtures(spark, sf_dir):
    return rounded(_kept(spark, sf_dir, "fixtures-predicted", lambda: _predicted(spark, sf_dir)).select(
        "match_id", "home_team", "away_team", "error", "predicted", "confidence", "p_H", "p_D", "p_A", "uncertainty"))


@query("M18_fixture_outcomes", (
    f"{M}, f as (select case when match_id%4=3 and match_id%11=0 then 'unknown home team: Nowhere XI' end as error from m where home_score is null)"
    " select coalesce(error, '') as error, count(*) as n, count(*) filter (where error is null) as predicted,"
    " count(*) filter (where error is null) as sums from f group by 1"))
def fixture_outcomes(spark, sf_dir):
    """Scheduled fixtures by their error: the unresolved have no prediction, the others a sound one."""
    out = _kept(spark, sf_dir, "fixtures-predicted", lambda: _predicted(spark, sf_dir))
    return out.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count(F.lit(1)).alias("n"), F.count("predicted").alias("predicted"),
        F.count_if(F.abs(F.col("p_H") + F.col("p_D") + F.col("p_A") - 1) < 1e-6).alias("sums"))


@query("M19_model_soundness", (
    f"{M}, k as (select * from (values ('forest'), ('boosted_a')) t(model)) select model, count(*) as n, count(*) as sums, count(*) as positive,"
    " count(*) as likeliest, count(*) as confident from m, k group by model"))
def model_soundness(spark, sf_dir):
    return sound(predict.predict_all(feature_rows(spark, sf_dir), _trained(spark, sf_dir)), "model")


@query("M19_compare_models")
def compare_models(spark, sf_dir):
    return rounded(predict.predict_all(feature_rows(spark, sf_dir), _trained(spark, sf_dir)))


@query("M20_stratified_split", (
    f"{M}, c as (select {_HDA} as label, count(*) as n from m where home_score is not null group by 1)"
    " select label, round(n*0.8::double)::bigint as train, n - round(n*0.8::double)::bigint as test from c"))
def stratified_split(spark, sf_dir):
    m = clean.with_score_columns(matches(spark, sf_dir)).where("result is not null")
    out = folds.stratified_split(m.select("match_id", F.col("result").alias("label")), "label", "match_id")
    return out.groupBy("label").agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query("M21_importance_total", f"select {len(MODEL_FEATURES)}::bigint as features, 1.0::double as total, true as positive")
def importance_total(spark, sf_dir):
    found = _trained(spark, sf_dir)["forest"].importances(spark)
    return found.agg(F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 9).alias("total"),
                     (F.min("importance") >= 0).alias("positive"))


@query("M21_tree_importance")
def tree_importance(spark, sf_dir):
    return rounded(_trained(spark, sf_dir)["forest"].importances(spark))


def results(spark, sf_dir):
    p = predictions(spark, sf_dir)
    fold = ensemble.averaged(p, ["match_id"]).withColumn("fold", (F.col("match_id") % 5).cast("int")).withColumn("model", F.lit("ensemble"))
    names = ["model", "fold", "label", "predicted"]
    scored = metrics.macro_scores(p.select(*names).unionByName(fold.select(*names)), ["model", "fold"])
    return metrics.fold_summary(scored).select(
        "model", F.col("accuracy_mean").alias("accuracy"), F.col("accuracy_std"), F.col("f1_macro_mean").alias("f1_score"))


RESULTS_SQL = PRED_SQL + _VOTE + (
    f", al as (select model, fold, label, predicted from pd union all select 'ensemble', (match_id%5)::int, label, {_VOTED} from vt),"
    " fa as (select model, fold, avg(case when label=predicted then 1.0::double else 0.0 end) as acc from al group by all),"
    " rs as (select model, avg(acc) as accuracy, stddev_pop(acc) as accuracy_std from fa group by model)")


@query("O07_model_comparison", RESULTS_SQL + f" select model, {r('accuracy')} as accuracy, {r('accuracy_std')} as accuracy_std from rs")
def model_comparison(spark, sf_dir):
    return rounded(ensemble.comparison(results(spark, sf_dir)).select("model", "accuracy", "accuracy_std"))


@query("O06_best_model", RESULTS_SQL + f" select model, {r('accuracy')} as accuracy from rs order by rs.accuracy desc, model limit 1")
def best_model(spark, sf_dir):
    return rounded(ensemble.best_model(results(spark, sf_dir)).select("model", "accuracy"))


@query("M22_recommendations", RESULTS_SQL + (
    ", ag as (select max(accuracy) as best, max(accuracy) filter (where model<>'ensemble') as solo, max(accuracy) filter (where model='ensemble') as ens, max(accuracy_std) as sd from rs)"
    " select recommendation from (select case when best<0.5 then 'low accuracy: improve the features' when best>0.7 then 'high accuracy: ready for use' end as recommendation from ag"
    " union all select case when ens>solo then 'ensemble beats the single models: use it' else 'ensemble does not help: use a single model' end from ag"
    " union all select case when sd>0.05 then 'high variance: regularise or add data' end from ag) where recommendation is not null"))
def recommendations(spark, sf_dir):
    return ensemble.recommendations(results(spark, sf_dir)).select("recommendation")


# --- selection ----------------------------------------------------------------------------------

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("M23_feature_importance")
def feature_importance(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    scores = selection.importance(rows, MODEL_FEATURES, "label")
    return rounded(spark.createDataFrame(list(scores.items()), "feature string, importance double"))


@query("M23_anova_f", (
    "with g as (select l_returnflag as y, count(*) as n, " + ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in LINE_COLS)
    + " from lineitem group by 1) " + " union all ".join(
        f"select '{c}' as feature, {r(f'(sum(n*(m_{c}-gm)*(m_{c}-gm))/(count(*)-1)) / (sum(n*v_{c})/(sum(n)-count(*)))')} as f_score"
        f" from g, (select sum(n*m_{c})/sum(n) as gm from g)" for c in LINE_COLS)))
def anova(spark, sf_dir):
    scores = selection.anova_f(table(spark, sf_dir, "lineitem"), LINE_COLS, "l_returnflag")
    return rounded(spark.createDataFrame(list(scores.items()), "feature string, f_score double"))


@query("M24_selection_target", (
    f"{M} select match_id, case when home_score>away_score then 'Win' when home_score=away_score then 'Draw' when home_score<away_score then 'Loss' end as target from m"))
def selection_target(spark, sf_dir):
    return matches(spark, sf_dir).select(
        "match_id", selection.selection_target(F.col("home_score") - F.col("away_score")).alias("target"))


@query("M25_correlation", " union all ".join(
    f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as correlation from lineitem"
    for i, a in enumerate(LINE_COLS) for b in LINE_COLS[i + 1:]))
def correlation(spark, sf_dir):
    matrix = selection.correlation_matrix(table(spark, sf_dir, "lineitem"), LINE_COLS)
    pairs = selection.correlated_pairs(matrix, LINE_COLS, 0.0)
    return rounded(spark.createDataFrame(pairs, "a string, b string, correlation double"))


# Columns of the flat match row that features are selected from; missing values count as 0.
FLAT_FEATURES = (
    [f"{name}_{side}" for name, _, _ in documents.FULL_TIME_COLUMNS for side in ("home", "away")]
    + [f"{name}_{half}_{side}" for half in ("1h", "2h") for name, _ in documents.HALF_COLUMNS for side in ("home", "away")]
    + [f"odds_{n}" for n in ("home_win", "draw", "away_win", "over_2_5", "under_2_5")]
    + [f"implied_prob_{n}" for n in ("home", "draw", "away")])


def flat_rows(spark, sf_dir):
    return _kept(spark, sf_dir, "flat", lambda: rounded(flat(spark, sf_dir)).select(
        "match_id", "goal_difference", F.col("result").alias("label"), *FLAT_FEATURES))


def _analysis(spark, sf_dir):
    matrix = selection.correlation_matrix(flat_rows(spark, sf_dir), FLAT_FEATURES)
    return matrix, selection.correlated_pairs(matrix, FLAT_FEATURES)


def _pairs_of(names, expr):
    return ", ".join(f"{{'i': {i}, 'j': {j}, 'c': {expr(names[i], names[j])}}}"
                     for i in range(len(names)) for j in range(len(names)) if i <= j)


# cm: correlations of all ordered pairs of features; gone: redundant ones; vf: inflation of each.
_SELECTION_SQL = (
    f"with fl as ({flat_sql()}), f as (select goal_difference as gd, " + ", ".join(f"coalesce({c}, 0)::double as {c}" for c in FLAT_FEATURES) + " from fl),"
    f" up as (select unnest([{_pairs_of(FLAT_FEATURES, lambda a, b: '1.0::double' if a == b else f'corr({a}, {b})')}], recursive := true) from f),"
    " ok as (select i, j, case when isfinite(c) then c end as c from up),"
    " cm as (select i, j, c from ok union all select j, i, c from ok where i <> j),"
    " vr as (select i, coalesce(round(var_samp(c), 9), 0) as v from cm group by i),"
    " rk as (select i, j, row_number() over (order by round(abs(c), 9) desc, i, j) as k from ok where i < j and abs(c) >= 0.95),"
    " fs as (select x, min(k) as k from (select i as x, k from rk union all select j, k from rk) group by x),"
    " dc as (select i, j from rk where k = (select k from fs where x = i) or k = (select k from fs where x = j)),"
    " gone as (select distinct case when a.v >= b.v then j else i end as x from dc join vr a using (i) join vr b on b.i = j),"
    " vf as (select i as x, least(1 / greatest(1 - pow(coalesce(max(abs(c)) filter (where i <> j), 0), 2), 0.01), 10.0) as vif from cm group by i),"
    f" nm as (select unnest(range({len(FLAT_FEATURES)})) as x, unnest([{', '.join(repr(c) for c in FLAT_FEATURES)}]) as feature)")


@query("M26_redundant_features", _SELECTION_SQL + " select feature, x in (select x from gone) as redundant from nm")
def redundant_features(spark, sf_dir):
    matrix, pairs = _analysis(spark, sf_dir)
    gone = selection.redundant(matrix, FLAT_FEATURES, pairs)
    return spark.createDataFrame([(f, f in gone) for f in FLAT_FEATURES], "feature string, redundant boolean")


@query("M27_feature_clusters")
def feature_clusters(spark, sf_dir):
    matrix, _ = _analysis(spark, sf_dir)
    groups = selection.clusters(matrix, FLAT_FEATURES)
    return spark.createDataFrame([(i, f) for i, g in enumerate(groups) for f in g], "cluster int, feature string")


@query("M27_cluster_heads", _SELECTION_SQL + (
    ", lk as (select i, j from cm where i <> j and abs(c) >= 0.95 * 0.8)"
    " select (select count(*) from nm where x in (select i from lk)) as linked, true as disjoint, true as tied"))
def cluster_heads(spark, sf_dir):
    """Features with a partner, whether no feature is in two clusters, and whether every member is tied to its head."""
    matrix, _ = _analysis(spark, sf_dir)
    place = {f: i for i, f in enumerate(FLAT_FEATURES)}
    groups = selection.clusters(matrix, FLAT_FEATURES)
    members = [f for g in groups for f in g]
    least = selection.CORRELATED * selection.CLUSTER_SHARE
    linked = sum(any(abs(c) >= least for j, c in enumerate(row) if j != i) for i, row in enumerate(matrix))
    tied = all(abs(matrix[place[g[0]]][place[f]]) >= least for g in groups for f in g[1:])
    return spark.createDataFrame([(linked, len(members) == len(set(members)), tied)], "linked long, disjoint boolean, tied boolean")


@query("M28_vif", " union all ".join(
    f"select '{a}' as feature, {r('least(1/greatest(1-pow(greatest(' + ','.join(f'abs(corr({a},{b}))' for b in LINE_COLS if b != a) + '),2),0.01),10.0)')} as vif from lineitem"
    for a in LINE_COLS))
def vif(spark, sf_dir):
    matrix = selection.correlation_matrix(table(spark, sf_dir, "lineitem"), LINE_COLS)
    return rounded(spark.createDataFrame(list(selection.vif(matrix, LINE_COLS).items()), "feature string, vif double"))


_SELECTIONS: dict[tuple[str, str], tuple] = {}


def _selected(spark, sf_dir):
    """The selection over the flat match columns, made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SELECTIONS:
        _SELECTIONS[key] = selection.select(flat_rows(spark, sf_dir).where("label is not null"), FLAT_FEATURES, "label")
    return _SELECTIONS[key]


@query("M29_select_features")
def select_features(spark, sf_dir):
    chosen, analysis = _selected(spark, sf_dir)
    return rounded(spark.createDataFrame([(f, analysis["importance"][f]) for f in chosen], "feature string, importance double"))


@query("M30_domain_priorities")
def domain_priorities(spark, sf_dir):
    """Which columns stay of the contextual and advanced features of all matches when the cap is ten below their number."""
    scores = _kept(spark, sf_dir, "associations", lambda: _associations(spark, sf_dir))
    measured = {x[0]: x[1] for x in scores.collect()}     # one entry per feature
    kept = selection.trim_low_priority(set(measured), measured, most=len(measured) - 10)
    return spark.createDataFrame([(f, f in kept) for f in sorted(measured)], "feature string, kept boolean")


@query("M31_selection_report")
def selection_report(spark, sf_dir):
    chosen, analysis = _selected(spark, sf_dir)
    return rounded(spark.createDataFrame([{k: float(v) for k, v in selection.report(FLAT_FEATURES, chosen, analysis).items()}]))


_LABELLED_SELECTION_SQL = _SELECTION_SQL.replace(" from fl),", " from fl where home_score is not null),", 1)


@query("M31_selection_counts", _LABELLED_SELECTION_SQL + (
    " select (select count(*) from nm) as total_features, (select count(*) from rk) as correlated_pairs, (select count(*) from gone) as redundant"))
def selection_counts(spark, sf_dir):
    chosen, analysis = _selected(spark, sf_dir)
    found = selection.report(FLAT_FEATURES, chosen, analysis)
    names = ("total_features", "correlated_pairs", "redundant")
    return spark.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))


_RA, _RF = rolling_parts(ROLLING_SQL)
_V = ["goals_per_game_5g", "points_per_game_5g"]


@query("M32_feature_vector", sided(
    snapshot_sql({k[:-1]: _RA[k[:-1]] for k in _V}, {k: _RF[k] for k in _V}, 5),
    ", ".join(f"{s}.{k} as v{i}" for i, (s, k) in enumerate([(s, k) for k in _V for s in ("h", "a")]))))
def feature_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    names = [f"{s}_{k}" for k in _V for s in ("home", "away")]
    rows = snapshot.match_features(matches(spark, sf_dir), ["rolling"])
    v = vector_to_array(F.col("_x"))
    return rounded(models.assemble(rows, names).select("match_id", *[v[i].alias(f"v{i}") for i in range(len(names))]))


_PROBE_COLS = [k for k in _RF if k.endswith("_5g")]


@query("J09_probe_features", sided(
    snapshot_sql({k: v for k, v in _RA.items() if k.endswith("_5")}, {k: _RF[k] for k in _PROBE_COLS}, 5),
    ", ".join(f"{s[0]}.{k} as {s}_{k}" for s in ("home", "away") for k in _PROBE_COLS)
).replace("select m.match_id,", "select m.match_id + 1000000000000 as match_id,"))
def probe_features(spark, sf_dir):
    """Features of a fixture added for every match: those of the match itself, since neither is its own history."""
    m = matches(spark, sf_dir)
    probes = m.withColumns({"match_id": F.col("match_id") + 10**12, "status": F.lit("PROBE"), **{
        f"{s}_score": F.lit(None).cast("int") for s in ("home", "away")}})
    rows = snapshot.match_features(m, ["rolling"], probes=probes)
    return rounded(rows.select("match_id", *[f"{s}_{k}" for s in ("home", "away") for k in _PROBE_COLS]))


# --- measured catalogue --------------------------------------------------------------------------

_FEATS = [(f"{s}_{side}", e) for s in STATISTICS for side, e in zip(("home", "away"), stat_sql(s), strict=True)]
MEASURED_SQL = (
    f"{M}, f as (select home_score-away_score as gd, " + ", ".join(f"coalesce(cast({e} as double),0) as {n}" for n, e in _FEATS)
    + " from m where home_score is not null), ms as ("
    + " union all ".join(f"select '{n}' as feature_name, abs(corr({n}, gd)) as importance_score from f" for n, _ in _FEATS) + ")")
_CAT = ("case " + " ".join("when " + " or ".join(f"contains(lower(feature_name),'{p}')" for p in ps) + f" then '{c}'"
                           for c, ps in catalogue.CATEGORIES) + " else 'Unknown' end")


@query("D64_feature_catalogue", MEASURED_SQL + (
    f" select feature_name, {_CAT} as category, {r('importance_score')} as importance_score,"
    " row_number() over (order by importance_score desc, feature_name)::int as importance_rank from ms"))
def feature_catalogue(spark, sf_dir):
    return rounded(catalogue.feature_catalogue(catalogue.measured_importance(spark, matches(spark, sf_dir))))


@query("W17_importance_rank", MEASURED_SQL + (
    " select feature_name, row_number() over (order by importance_score desc, feature_name)::int as importance_rank from ms"))
def importance_rank(spark, sf_dir):
    return catalogue.feature_catalogue(catalogue.measured_importance(spark, matches(spark, sf_dir))).select(
        "feature_name", "importance_rank")


@query("O03_top_features", MEASURED_SQL + f" select feature_name, {r('importance_score')} as importance_score from ms order by ms.importance_score desc, feature_name limit 10")
def top_features(spark, sf_dir):
    return rounded(catalogue.measured_importance(spark, matches(spark, sf_dir)).orderBy(
        F.col("importance_score").desc(), "feature_name").limit(10))


_LOW_SQL = ", ".join(f"{{'feature': '{c}', 's': abs(corr({c}, gd))}}" for c in FLAT_FEATURES)


@query("U02_feature_difference", _SELECTION_SQL + (
    f", lw as (select feature from (select unnest([{_LOW_SQL}], recursive := true) from f where gd is not null) where not coalesce(isfinite(s) and s >= 0.01, false))"
    " select feature as feature_name from nm except select feature from lw except select feature from nm join gone using (x)"
    " except select feature from nm join vf using (x) where vif > 5"))
def feature_difference(spark, sf_dir):
    """All features less those of low importance, the redundant and the collinear ones."""
    rows = flat_rows(spark, sf_dir).na.fill(0.0, FLAT_FEATURES)
    scores = catalogue.association(rows.where("goal_difference is not null"), F.col("goal_difference"), FLAT_FEATURES)
    matrix, pairs = _analysis(spark, sf_dir)
    inflated = [f for f, v in selection.vif(matrix, FLAT_FEATURES).items() if v > selection.MAX_VIF]

    def names(values):
        return spark.createDataFrame([(v,) for v in values], "feature_name string")

    low = scores.where(F.col("importance_score") < selection.LOW_IMPORTANCE).select("feature_name")
    return (names(FLAT_FEATURES).exceptAll(low).subtract(names(selection.redundant(matrix, FLAT_FEATURES, pairs)))
            .subtract(names(inflated)))


@query("U03_feature_intersection", MEASURED_SQL + " select feature_name from ms where importance_score >= 0.01 and feature_name like '%_home'")
def feature_intersection(spark, sf_dir):
    ms = catalogue.measured_importance(spark, matches(spark, sf_dir))
    return ms.where("importance_score >= 0.01").select("feature_name").intersect(
        ms.where(F.col("feature_name").endswith("_home")).select("feature_name"))


@query("D65_static_importance", MEASURED_SQL + f" select 'home_style_'||feature_name as feature, 0.5::double as static_importance, {r('importance_score')} as measured from ms")
def static_importance(spark, sf_dir):
    ms = catalogue.measured_importance(spark, matches(spark, sf_dir))
    name = F.concat(F.lit("home_style_"), "feature_name")
    return rounded(ms.select(name.alias("feature"), catalogue.static_importance(name, F.lit("advanced")).alias("static_importance"),
                             F.col("importance_score").alias("measured")))


@query("D66_processing_report", MEASURED_SQL + f" select {_CAT} as category, count(*) as features, {r('avg(importance_score)')} as mean_importance from ms group by 1")
def processing_report(spark, sf_dir):
    cat = catalogue.feature_catalogue(catalogue.measured_importance(spark, matches(spark, sf_dir)))
    return rounded(cat.groupBy("category").agg(F.count("*").alias("features"), F.avg("importance_score").alias("mean_importance")))


def _associations(spark, sf_dir):
    """Association with the goal difference of every contextual and advanced feature of every scored match."""
    m = matches(spark, sf_dir).where("home_score is not null")
    built = catalogue.build_features(m, F.lit(AS_OF), ("contextual", "advanced"))
    kinds = dict(built.dtypes)
    names = [c for c in clean.feature_columns(built, m.columns) if kinds[c] in ("double", "float", "int", "bigint", "boolean")]
    built = built.withColumn("goal_difference", F.col("home_score") - F.col("away_score"))
    return catalogue.association(built, F.col("goal_difference"), names)


@query("D63_all_features")
def all_features(spark, sf_dir):
    return rounded(catalogue.build_features(matches(spark, sf_dir), F.lit(AS_OF)))


@query("D63_temporal_part", sided(TEMPORAL_SNAP, ", ".join(
    f"{s[0]}.{k} as {s}_{k}" for s in ("home", "away") for k in TEMPORAL_SQL)))
def temporal_part(spark, sf_dir):
    """The temporal columns of the whole chain, both sides."""
    built = catalogue.build_features(matches(spark, sf_dir), F.lit(AS_OF))
    return rounded(built.select("match_id", *[f"{s}_{k}" for s in ("home", "away") for k in TEMPORAL_SQL]))


def _broken(m):
    return m.select("match_id", F.raise_error(F.lit("broken")).cast("double").alias("never"))


@query("P19_isolated_components", (
    f"{M} select 'broken' as component, false as ok, 0::bigint as rows, true as told"
    " union all select 'contextual', true, count(*), false from m union all select 'temporal', true, count(*), false from m"))
def isolated_components(spark, sf_dir):
    """A component that fails while it runs is told of, and those after it go on."""
    built = {name: lambda m, name=name: catalogue.build_features(m, F.lit(AS_OF), (name,)) for name in ("temporal", "contextual")}
    report = catalogue.component_report(matches(spark, sf_dir), F.lit(AS_OF), {"broken": _broken, **built})
    return report.select("component", "ok", "rows", F.coalesce(F.col("error").contains("broken"), F.lit(False)).alias("told"))


@query("P19_component_report")
def component_report(spark, sf_dir):
    return catalogue.component_report(matches(spark, sf_dir), F.lit(AS_OF)).select("component", "ok", "features_added", "rows")


# --- model files and batch prediction --------------------------------------------------------------

@query("S18_model_round_trip", f"{M} select count(*) as n, count(*) as equal from m")
def model_round_trip(spark, sf_dir):
    """Predictions of a saved and loaded model that equal those of the model itself."""
    path = fresh_dir(spark, "model")
    fitted = trained(spark, sf_dir, "forest")
    fitted.save(path, spark)
    columns = ["match_id", "predicted", "p_H", "p_D", "p_A"]
    rows = feature_rows(spark, sf_dir)
    again = models.load_model(path, spark).transform(rows).select("match_id", F.struct(*columns[1:]).alias("again"))
    own = fitted.transform(rows).select("match_id", F.struct(*columns[1:]).alias("own"))
    return own.join(again, "match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == F.col("again")).alias("equal"))


@query("S17_batch_prediction_files")
def batch_prediction_files(spark, sf_dir):
    inbox, outbox = fresh_dir(spark, "inbox"), fresh_dir(spark, "outbox")
    _asked(spark, sf_dir).write.json(inbox)
    asked = spark.read.schema("match_id bigint, date date, home_asked string, away_asked string").json(inbox)
    medians = clean.exact_medians(feature_rows(spark, sf_dir), MODEL_FEATURES)
    out = predict.predict_fixtures(asked, matches(spark, sf_dir), FAMILIES + ["form"], F.lit(AS_OF), medians, _trained(spark, sf_dir))
    out.write.json(outbox)
    return rounded(spark.read.schema(out.schema).json(outbox).select("match_id", "home_team", "error", "predicted", "confidence"))


@query("S18_model_files")
def model_files(spark, sf_dir):
    path = fresh_dir(spark, "model")
    fitted = trained(spark, sf_dir, "forest")
    fitted.save(path, spark)
    again = models.load_model(path, spark).transform(feature_rows(spark, sf_dir))
    return rounded(again.select("match_id", "predicted", "p_H", "p_D", "p_A"))


_REG = ("case match_id%3 when 0 then 'forest' when 1 then 'boosted_a' else 'boosted_b' end as kind,"
        " 'models/'||cast(match_id as string) as path, date as trained_at")


@query("S19_latest_models", (
    f"{M}, g as (select {_REG}, match_id from m) select kind, arg_max(path, struct_pack(a := trained_at, b := path)) as path, max(trained_at) as trained_at from g group by kind"))
def latest_models(spark, sf_dir):
    return predict.latest_models(matches(spark, sf_dir).selectExpr(*[
        "case match_id%3 when 0 then 'forest' when 1 then 'boosted_a' else 'boosted_b' end as kind",
        "'models/'||cast(match_id as string) as path", "date as trained_at"]))


# --- betting -------------------------------------------------------------------------------------

_BETS = (", bo as (select match_id, max(home_win) as ph, max(draw) as pd_, max(away_win) as pa from q group by match_id),"
         " vb as (select pd.match_id, date, label, sel, price, prob, prob*price-1 as ev from pd join bo using (match_id),"
         " lateral (select unnest(['home_win','draw','away_win']) as sel, unnest([ph,pd_,pa]) as price, unnest([p_H,p_D,p_A]) as prob) where model='table'),"
         " st as (select *, case sel when 'home_win' then 'H' when 'draw' then 'D' else 'A' end = label as won from vb where ev>0),"
         " sp as (select *, case when won then price-1 else -1.0 end as profit from st),"
         " dy as (select date, count(*) as bets, count(*)::double as staked, sum(profit) as profit, count(*) filter (where won) as wins from sp group by date),"
         " dd as (select *, 1000+sum(profit) over (order by date) as bankroll, 1000*exp(sum(ln(1+0.01*profit/staked)) over (order by date)) as fraction_bankroll from dy),"
         " de as (select *, max(bankroll) over (order by date) as peak from dd)")


def bets(spark, sf_dir):
    p = predictions(spark, sf_dir).where("model = 'table'").select("match_id", "date", "label", "p_H", "p_D", "p_A")
    return betting.value_bets(p, aggregates.long_odds(odds_quotes(spark, sf_dir)))


@query("B01_value_bets", PRED_SQL + _BETS + f" select match_id, sel as selection, {r('price')} as price, {r('prob')} as probability, {r('ev')} as expected_value, ev>0 as should_bet from vb")
def value_bets(spark, sf_dir):
    return rounded(bets(spark, sf_dir).select("match_id", "selection", "price", "probability", "expected_value", "should_bet"))


@query("B02_stakes", PRED_SQL + _BETS + f" select date, {r('bankroll')} as bankroll, {r('ln(fraction_bankroll/1000)')} as fraction_log_growth from dd")
def stakes(spark, sf_dir):
    days = betting.daily(betting.settle(bets(spark, sf_dir)))
    return rounded(days.select("date", "bankroll", F.log(F.col("fraction_bankroll") / 1000).alias("fraction_log_growth")))


@query("B03_backtest", PRED_SQL + _BETS + (
    f" select sum(bets)::bigint as num_bets, {r('sum(profit)')} as profit, {r('sum(profit)/sum(staked)')} as roi, {r('sum(wins)/sum(bets)')} as win_rate,"
    f" 1.0::double as average_stake, {r('sum(profit)/1000')} as total_return, {r('max((peak-bankroll)/peak)')} as max_drawdown from de"))
def backtest(spark, sf_dir):
    return rounded(betting.backtest(betting.daily(betting.settle(bets(spark, sf_dir)))))


@query("B04_risk", PRED_SQL + _BETS + (
    ", vr as (select quantile_cont(profit, 0.05) as v from dy)"
    f" select {r('avg(profit)/stddev_samp(profit)')} as sharpe, {r('max(v)')} as var95, {r('avg(profit) filter (where profit<=v)')} as expected_shortfall from dy, vr"))
def risk(spark, sf_dir):
    return rounded(betting.risk(betting.daily(betting.settle(bets(spark, sf_dir)))))


@query("B05_brier", PRED_SQL + (
    f" select model, {r('avg(pow(p_H-case when label=' + chr(39) + 'H' + chr(39) + ' then 1 else 0 end,2)+pow(p_D-case when label=' + chr(39) + 'D' + chr(39) + ' then 1 else 0 end,2)+pow(p_A-case when label=' + chr(39) + 'A' + chr(39) + ' then 1 else 0 end,2))')} as brier_score, count(*) as rows from pd group by model"))
def brier(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).groupBy("model").agg(metrics.brier().alias("brier_score"), F.count("*").alias("rows")))


# --- streaming -----------------------------------------------------------------------------------

def _landed(spark, sf_dir):
    """All matches land as JSON, some twice and some without a team."""
    path = fresh_dir(spark, "landing")
    m = matches(spark, sf_dir).selectExpr(
        "match_id", "date", "season", "competition",
        "case when match_id%43=0 then null else home_team end as home_team", "away_team", "home_score", "away_score", "status")
    m.unionByName(m.where(F.col("match_id") % 4 == 0)).write.json(path)
    return path, m.schema


@query("T01_incremental_ingest", (
    f"{M} select count(*) filter (where match_id%43<>0) as stored, count(*) filter (where match_id%43=0) + count(*) filter (where match_id%43=0 and match_id%4=0) as quarantined from m"))
def incremental_ingest(spark, sf_dir):
    from touchline.streaming.ingest import start_ingest
    path, schema = _landed(spark, sf_dir)
    store, bad, state = (fresh_dir(spark, n) for n in ("store", "quarantine", "stream"))
    for _ in range(2):  # the second run finds nothing new
        start_ingest(spark.readStream.schema(schema).json(path), store, bad, state).awaitTermination()
    kept = spark.read.parquet(store).agg(F.count("*").alias("stored"))
    return kept.join(F.broadcast(spark.read.parquet(bad).agg(F.count("*").alias("quarantined"))))


@query("T02_refresh_features", snapshot_sql(
    {k: v for k, v in _RA.items() if k.endswith("_5")}, {k: v for k, v in _RF.items() if k.endswith("_5g")}, 5
).replace("from orders)", "from orders where o_orderkey%43<>0)"))
def refresh_features(spark, sf_dir):
    from touchline.streaming.ingest import refresh_touched, start_ingest
    path, schema = _landed(spark, sf_dir)
    store, bad, state, out = (fresh_dir(spark, n) for n in ("store", "quarantine", "stream", "snapshots"))
    refresh = refresh_touched(store, out, ["rolling"], schema)
    start_ingest(spark.readStream.schema(schema).json(path), store, bad, state, refresh).awaitTermination()
    return rounded(spark.read.parquet(out).select(
        "team", "date", "matches_before", *[k for k in _RF if k.endswith("_5g")]))


@query("X08_ingest_log", (
    f"{M}, l as (select season, match_id%43=0 as bad, match_id%4=0 as twice from m), o as (select season, 1 as run,"
    " case when bad then 'failed' else 'successful' end as status, case when bad and twice then 2 else 1 end as n from l"
    " union all select season, 2, case when bad then 'failed' else 'skipped' end, case when bad and twice then 2 else 1 end from l)"
    " select run, season, status, case when status='failed' then 'home_team' else '' end as reasons, sum(n)::bigint as n from o group by all"))
def ingest_log(spark, sf_dir):
    """Outcomes that two ingest runs over the same landing folder wrote down; the second finds every match stored."""
    from touchline.streaming.ingest import start_ingest
    path, schema = _landed(spark, sf_dir)
    store, bad = (fresh_dir(spark, n) for n in ("store", "quarantine"))
    logs = []
    for run in (1, 2):
        state, log = (fresh_dir(spark, n) for n in ("stream", "log"))
        start_ingest(spark.readStream.schema(schema).json(path), store, bad, state, log=log).awaitTermination()
        logs.append(spark.read.parquet(log).withColumn("run", F.lit(run)))
    return logs[0].unionByName(logs[1]).groupBy("run", "season", "status", "reasons").agg(F.count("*").alias("n"))
