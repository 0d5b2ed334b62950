"""Feature chain with isolated components, feature catalogue and processing report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from touchline.operators import selection, snapshot
from touchline.session import stored

# Name parts that decide a feature's category, first hit wins.
CATEGORIES = [
    ("Temporal", ["rolling", "momentum", "form", "streak"]),
    ("Contextual", ["home_", "h2h_", "rivalry", "travel", "seasonal"]),
    ("Advanced", ["xg_", "eff_", "clutch_", "style_"]),
]
# Estimated importance by name part, first hit wins; contextual names, then advanced ones.
CONTEXTUAL_IMPORTANCE = [
    (0.8, ["home_home_advantage_win_rate", "away_home_advantage_win_rate", "h2h_home_team_win_rate",
           "h2h_away_team_win_rate", "rivalry_intensity", "is_derby"]),
    (0.6, ["home_home_form_strength", "away_away_form_strength", "home_travel_cumulative_fatigue",
           "away_travel_cumulative_fatigue", "home_seasonal_motivation_index",
           "away_seasonal_motivation_index"]),
    (0.3, ["home_travel_current_travel_distance", "away_travel_current_travel_distance",
           "home_seasonal_month_of_year", "away_seasonal_month_of_year"]),
]
ADVANCED_IMPORTANCE = [
    (0.95, ["xg_advantage_home", "finishing_advantage_home", "attacking_efficiency_advantage_home"]),
    (0.85, ["home_xg_avg_xg_for", "away_xg_avg_xg_for", "home_xg_finishing_quality",
            "away_xg_finishing_quality", "home_clutch_mental_strength_score",
            "away_clutch_mental_strength_score"]),
    (0.7, ["home_eff_possession_efficiency", "away_eff_possession_efficiency",
           "home_style_attacking_intensity", "away_style_defensive_solidity"]),
    (0.8, ["xg_"]), (0.6, ["clutch_"]), (0.65, ["eff_"]), (0.5, ["style_"]),
]


def _first_hit(name: Column, rules, default) -> Column:
    out = None
    for value, parts in rules:
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def category(name: Column) -> Column:
    return _first_hit(F.lower(name), CATEGORIES, "Unknown")


def static_importance(name: Column, component: Column) -> Column:
    return F.when(component == "contextual", _first_hit(name, CONTEXTUAL_IMPORTANCE, 0.4)).when(
        component == "advanced", _first_hit(name, ADVANCED_IMPORTANCE, 0.45)).otherwise(0.0)


def feature_catalogue(scored: DataFrame) -> DataFrame:
    """(feature_name, importance_score) to the ranked catalogue; a few hundred rows."""
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("importance_score").desc(), "feature_name")
    return scored.select("feature_name", category(F.col("feature_name")).alias("category"),
                         "importance_score", F.row_number().over(line).alias("importance_rank"))


def association(rows: DataFrame, target: Column, features: list[str]) -> DataFrame:
    """|correlation| of every feature with the target, from one aggregate; constants score 0."""
    y = target.cast("double")

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.struct(F.lit(c).alias("feature_name"), F.coalesce(F.when(
            spread > 1e-12, F.abs(F.covar_pop(x, y) / spread)), F.lit(0.0)).alias("importance_score"))

    packed = rows.agg(F.array(*[one(c) for c in features]).alias("f"))
    return packed.select(F.inline("f"))


def measured_importance(spark: SparkSession, matches: DataFrame) -> DataFrame:
    """Association of each derived match statistic with the goal difference."""
    from touchline.schemas import STATISTICS
    from touchline.sources.match_documents import stat_sql
    exprs = [f"coalesce(cast({e} as double), 0) as {s}_{side}" for s in STATISTICS
             for side, e in zip(("home", "away"), stat_sql(s), strict=True)]
    rows = matches.where("home_score is not null").selectExpr("home_score - away_score as gd", *exprs)
    return association(rows, F.col("gd"), [c for c in rows.columns if c != "gd"])


COMPONENTS: dict[str, tuple[str, ...]] = {
    "temporal": snapshot.TEMPORAL, "contextual": snapshot.CONTEXTUAL, "advanced": snapshot.ADVANCED,
}


def build_features(matches: DataFrame, as_of: Column, enabled=("temporal", "contextual", "advanced"),
                   probes: DataFrame | None = None) -> DataFrame:
    """Every feature of the enabled components, in one pass over the timeline of each team."""
    families = [f for c in enabled for f in COMPONENTS[c]]
    return snapshot.match_features(
        matches, families, as_of if "contextual" in enabled else None, probes)


Builders = dict[str, Callable[[DataFrame], DataFrame]]
REPORT_SCHEMA = "component string, ok boolean, features_added int, rows long, seconds double, error string"


def built_components(matches: DataFrame, as_of: Column, builders: Builders | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): each component is built on its own and written as match_id and its features. One that fails is
    reported and left out, the others go on.

    The report has (component, ok, features_added, rows, seconds, error).
    """
    builders = builders or {
        name: lambda m, name=name: build_features(m, as_of, (name,)) for name in COMPONENTS}
    tables, rows = {}, []
    for name, build in builders.items():
        started = time.time()
        try:
            built = build(matches)
            added = [c for c in built.columns if c not in set(matches.columns)]
            table = stored(built.select("match_id", *added), f"component-{name}")
            rows.append((name, True, len(added), table.count(), time.time() - started, None))
            tables[name] = table
        except Exception as e:  # noqa: BLE001 - isolation is the point
            rows.append((name, False, 0, 0, time.time() - started, str(e)))
    return tables, matches.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def component_report(matches: DataFrame, as_of: Column, builders: Builders | None = None) -> DataFrame:
    return built_components(matches, as_of, builders)[1]


def feature_chain(matches: DataFrame, as_of: Column, label: Column | None = None,
                  builders: Builders | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, report): the matches with the features of all components that did not fail.

    With ``label`` selection is the last step: numeric features are scored on the rows that have one, and those not
    chosen are dropped. A feature that two components make comes from the first.
    """
    tables, report = built_components(matches, as_of, builders)
    out, features = matches, []
    for table in tables.values():
        mine = [c for c in table.columns if c != "match_id" and c not in features]
        out = out.join(table.select("match_id", *mine), "match_id", "left")
        features += mine
    if label is None or not features:
        return out, report
    numbers = [f.name for f in out.select(*features).schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    scored = out.withColumn("_label", label).where(F.col("_label").isNotNull())
    chosen, _ = selection.select(stored(scored.select("match_id", "_label", *[F.col(c).cast("double").alias(c) for c in numbers]),
                                        "selection"), numbers, "_label")
    return out.select(*matches.columns, *chosen), report
