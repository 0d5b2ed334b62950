"""Queries J05, Q01..Q09, O04: names and team similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import aggregates, names
from touchline.operators.similarity import similar
from touchline.operators.asof import match_sides
from touchline.plans.loader_queries import TEAM_TABLE_SQL, TEAMS_SQL, registry_rows
from touchline.plans.registry import query, r, rounded
from touchline.sources.views import MATCHES_SQL, matches, table

M = f"with {MATCHES_SQL}"
# asked names: parts of team names and of customer names, most of which match nothing
ASKED_SQL = (
    "a as (select distinct case match_id%5 when 0 then home_team when 1 then upper(home_team) when 2 then substr(home_team, 1, 7)"
    " when 3 then 'The '||home_team||' team' else substr(home_team, 4, 9) end as asked from m union select c_name from customer)")


def asked_names(spark, sf_dir):
    m = matches(spark, sf_dir).selectExpr(
        "case match_id%5 when 0 then home_team when 1 then upper(home_team) when 2 then substr(home_team, 1, 7)"
        " when 3 then 'The '||home_team||' team' else substr(home_team, 4, 9) end as asked")
    return m.union(table(spark, sf_dir, "customer").select("c_name")).distinct()


def teams(spark, sf_dir):
    return aggregates.team_names(matches(spark, sf_dir))


_SCORE = "case when lower(asked)=lower(team) then 100 else 80 end"
_HIT = "(contains(lower(a.asked), lower(t.team)) or contains(lower(t.team), lower(a.asked)))"


@query("J05_fuzzy_join", (
    f"{M}, {TEAMS_SQL}, {ASKED_SQL} select asked, team as choice, {_SCORE} as score from a, t where {_HIT}"
    " qualify row_number() over (partition by asked order by score desc, length(team), team) <= 3"))
def fuzzy_join(spark, sf_dir):
    return names.fuzzy_join(asked_names(spark, sf_dir), teams(spark, sf_dir).withColumnRenamed("team", "choice"),
                            3).drop("rank")


# asked names with one to three letters changed, lost or added
_TYPO_SQL = (
    "a as (select distinct case match_id%4 when 0 then replace(home_team, 'a', 'e') when 1 then substr(home_team, 2) when 2 then home_team||'x'"
    " else substr(home_team, 1, 4)||'z'||substr(home_team, 6) end as asked from m union select c_name from customer)")


def mistyped(spark, sf_dir):
    m = matches(spark, sf_dir).selectExpr(
        "case match_id%4 when 0 then replace(home_team, 'a', 'e') when 1 then substr(home_team, 2) when 2 then home_team||'x'"
        " else substr(home_team, 1, 4)||'z'||substr(home_team, 6) end as asked")
    return m.union(table(spark, sf_dir, "customer").select("c_name")).distinct()


_EDIT = "round((1 - levenshtein(lower(asked), lower(team)) / greatest(length(asked), length(team), 1)::double) * 100, 0)::int"


@query("J05_edit_distance_join", (
    f"{M}, {TEAMS_SQL}, {_TYPO_SQL} select asked, team as choice, {_EDIT} as score from a, t where {_EDIT} >= 80"
    " qualify row_number() over (partition by asked order by score desc, length(team), team) <= 3"))
def edit_distance_join(spark, sf_dir):
    return names.fuzzy_join(mistyped(spark, sf_dir), teams(spark, sf_dir).withColumnRenamed("team", "choice"),
                            3, "levenshtein").drop("rank")


_VARIANTS = ("v as (select home_team as team from m union select away_team from m union select 'Real' union"
             " select distinct substr(home_team, 4) from m union select distinct lower(home_team) from m)")


def variants(spark, sf_dir):
    m = matches(spark, sf_dir)
    return m.select(F.explode(F.array("home_team", "away_team", F.lit("Real"))).alias("team")).union(
        m.selectExpr("substr(home_team, 4)")).union(m.selectExpr("lower(home_team)")).distinct()


_EXP = ("case when starts_with(n,'Atl ') then 'Atletico '||n[5:] when starts_with(n,'Dep ') then 'Deportes '||n[5:]"
        " when starts_with(n,'CF ') then 'Club de Futbol '||n[4:] when starts_with(n,'FC ') then 'Football Club '||n[4:]"
        " when starts_with(n,'SC ') then 'Sporting Club '||n[4:] else n end")
REGISTRY_SQL = (
    f"{M}, {_VARIANTS}, sp as (select lower(team) as low, min(team) as n from v group by 1), x as (select low, trim({_EXP.replace('n,', 'trim(n),').replace('n[', 'trim(n)[').replace('else n', 'else trim(n)')}) as canonical from sp),"
    " mx as (select * from x where not exists (select 1 from x y where y.low<>x.low and contains(y.low, x.low))),"
    " hd as (select * from mx where not exists (select 1 from mx y where y.low<>mx.low and length(y.low)>=length(mx.low) and contains(lower(y.canonical), mx.low))),"
    " b as (select v.team as variation, hd.canonical from v join hd on contains(hd.low, lower(v.team)) or contains(lower(hd.canonical), lower(v.team))"
    " qualify row_number() over (partition by v.team order by length(hd.canonical) desc, hd.canonical)=1),"
    " g as (select * from b union select canonical, canonical from b)")


@query("Q01_build_registry", REGISTRY_SQL + " select variation, canonical from g")
def build_registry(spark, sf_dir):
    return names.build_registry(variants(spark, sf_dir))


@query("Q04_aliases", REGISTRY_SQL + " select canonical, string_agg(distinct variation, '|' order by variation) as aliases from g where variation<>canonical group by canonical")
def aliases(spark, sf_dir):
    found = names.aliases(names.build_registry(variants(spark, sf_dir)))
    return found.select("canonical", F.array_join("aliases", "|").alias("aliases"))


_REG = "g as (select distinct unnest([team, lower(team), replace(lower(trim(team)),' ','')]) as variation, team as canonical from t)"


@query("Q02_find_team", (
    f"{M}, {TEAMS_SQL}, {ASKED_SQL}, {_REG}, e as (select asked, canonical from a join g on g.variation=trim(a.asked)),"
    " f as (select asked, canonical from a, g where asked not in (select asked from e) and"
    " (contains(lower(trim(asked)), lower(variation)) or contains(lower(variation), lower(trim(asked))))"
    " qualify row_number() over (partition by asked order by case when lower(trim(asked))=lower(variation) then 100 else 80 end desc, length(variation), variation)=1)"
    " select a.asked, coalesce(e.canonical, f.canonical) as canonical from a left join e using (asked) left join f using (asked)"))
def find_team(spark, sf_dir):
    return names.find_teams(asked_names(spark, sf_dir), registry_rows(spark, sf_dir)).select("asked", "canonical")


@query("Q03_resolve_fixture_names", (
    f"{M}, {TEAMS_SQL}, {ASKED_SQL}, n as (select asked, replace(lower(trim(asked)),' ','') as k from a), tk as (select team, replace(lower(trim(team)),' ','') as k from t),"
    " f as (select asked, team from n, tk where contains(n.k, tk.k) or contains(tk.k, n.k)"
    " qualify row_number() over (partition by asked order by length(team), team)=1)"
    " select n.asked, coalesce(t.team, tk.team, f.team) as team from n left join t on t.team=n.asked left join tk on tk.k=n.k left join f on f.asked=n.asked"))
def resolve_names(spark, sf_dir):
    return names.resolve_fixture_names(asked_names(spark, sf_dir), teams(spark, sf_dir))


def embedded(spark, sf_dir):
    return aggregates.team_table(match_sides(matches(spark, sf_dir))).select(
        F.col("team").alias("name"), names.embedding().alias("vector"))


_VEC = ("vv as (select team, [win_rate, draw_rate, loss_rate, goals_per_game, conceded_per_game, least(goal_difference/10.0, 3.0),"
        " home_win_rate, away_win_rate, least(total_matches/50.0, 1.0)]::double[] as v from tt)")


@query("Q05_team_embedding", (
    f"{TEAM_TABLE_SQL}, {_VEC}, u as (select team, unnest(range(1, 10)) as i, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) as nn from vv)"
    f" select team, (i-1)::int as dim, {r('v[i]/nn')} as value from u"))
def team_embedding(spark, sf_dir):
    out = embedded(spark, sf_dir).select(F.col("name").alias("team"), F.posexplode("vector").alias("dim", "value"))
    return rounded(out)


@query("Q06_pair_similarity", (
    f"{TEAM_TABLE_SQL}, {_VEC} select m.match_id, {r('list_cosine_similarity(h.v, a.v)')} as similarity from m"
    " join vv h on h.team=m.home_team join vv a on a.team=m.away_team"))
def pair_similarity(spark, sf_dir):
    e = names.small(embedded(spark, sf_dir))
    m = matches(spark, sf_dir)
    out = m.join(e.select(F.col("name").alias("home_team"), F.col("vector").alias("hv")), "home_team") \
        .join(e.select(F.col("name").alias("away_team"), F.col("vector").alias("av")), "away_team")
    return rounded(out.select("match_id", names.cosine(F.col("hv"), F.col("av")).alias("similarity")))


def _similar_sql(n):
    return (f"{TEAM_TABLE_SQL}, {_VEC}, sm as (select a.team as query, b.team as name, {r('list_cosine_similarity(a.v, b.v)')} as similarity"
            " from vv a join vv b on a.team<>b.team) select query, name, similarity from sm where similarity>0"
            f" qualify row_number() over (partition by query order by similarity desc, name) <= {n}")


def _similar(n):
    def run(spark, sf_dir):
        e = embedded(spark, sf_dir)
        return rounded(similar(e, e, n).select("query", "name", "similarity"))
    return run


query("Q07_similar_teams", _similar_sql(5))(_similar(5))
query("O04_most_similar_team", _similar_sql(1))(_similar(1))


@query("Q08_search_teams", (
    f"{M}, {TEAMS_SQL} select team, (select count(*) from t) as known_teams from t where contains(lower(team), 'madrid')"))
def search_teams(spark, sf_dir):
    t = teams(spark, sf_dir)
    total = t.agg(F.count("*").alias("known_teams"))
    return t.where(F.lower("team").contains("madrid")).join(F.broadcast(total))


@query("Q09_stats_by_variant", (
    f"{TEAM_TABLE_SQL}, x as (select distinct upper(home_team) as asked from m) select asked, team, total_matches, {r('win_rate')} as win_rate"
    " from x join tt on upper(tt.team)=x.asked"))
def stats_by_variant(spark, sf_dir):
    asked = matches(spark, sf_dir).select(F.upper("home_team").alias("asked")).distinct()
    found = names.find_teams(asked, registry_rows(spark, sf_dir))
    table_ = aggregates.team_table(match_sides(matches(spark, sf_dir)))
    return rounded(found.join(names.small(table_), found["canonical"] == table_["team"]).select(
        "asked", "team", "total_matches", "win_rate"))
