"""SQL building blocks for the oracles: brute-force history joins, written independently of the plans."""

from __future__ import annotations

from touchline.plans.registry import r
from touchline.sources.views import MATCHES_SQL

SIDES_SQL = """
s as (
  select match_id, date, home_team as team, away_team as opponent, true as is_home,
         home_score as gf, away_score as ga, home_team as venue_team from m where home_score is not null
  union all
  select match_id, date, away_team, home_team, false, away_score, home_score, home_team
  from m where home_score is not null)"""

KEYS_SQL = """
k as (select home_team as team, date from m union select away_team, date from m)"""

ROW_SQL = """
h0 as (
  select k.team, k.date, s.match_id, s.date as played, s.opponent, s.is_home, s.gf, s.ga, s.venue_team,
         s.gf - s.ga as gd,
         case when s.gf > s.ga then 3 when s.gf = s.ga then 1 else 0 end as pts,
         row_number() over (partition by k.team, k.date order by s.date desc, s.match_id desc) as age
  from k join s on s.team = k.team and s.date < k.date)"""

COUNT_SQL = """
c as (select team, date, count(*) as n from h0 group by team, date)"""


def history(limit: int | None = None) -> str:
    """CTEs m, s, k, h0 (every earlier row with its age), c (count) and h (rows up to ``limit``)."""
    where = "" if limit is None else f" where age <= {limit}"
    return ("with " + ",".join([MATCHES_SQL, SIDES_SQL, KEYS_SQL, ROW_SQL, COUNT_SQL])
            + f", h as (select * from h0{where})")


def snapshot_sql(
    aggs: dict[str, str], features: dict[str, tuple[str, int, float | None]],
    limit: int | None = None, more: str = "", joins: str = "",
) -> str:
    """Aggregate each key's history, then gate each feature by the number of earlier matches."""
    inner = ", ".join(f"{sql} as {name}" for name, sql in aggs.items())
    cols = []
    for name, (sql, gate, default) in features.items():
        d = "null" if default is None else f"{float(default)}::double"
        cols.append(f"case when coalesce(c.n,0) >= {gate} then {r(sql)} else {d} end as {name}")
    return (
        history(limit)
        + f", a as (select team, date, {inner} from h group by team, date){more}"
        + " select k.team, k.date, coalesce(c.n,0) as matches_before, " + ", ".join(cols)
        + " from k left join c on c.team=k.team and c.date=k.date"
        + f" left join a on a.team=k.team and a.date=k.date{joins}"
    )
