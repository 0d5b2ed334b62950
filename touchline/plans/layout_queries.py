"""Queries X02, X04 and X06 over pages of further layouts, checked against the values that the pages were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import pages
from touchline.plans.registry import query, rounded
from touchline.session import spread
from touchline.sources.views import MATCHES_SQL, matches

M = f"with {MATCHES_SQL}"


def num(expr: str) -> str:
    return f"cast({expr} as string)"


def component(label: str, home: str, away: str) -> str:
    """A row whose label and values are elements of their own."""
    return ("'<div class=\"wcl-row_x1\"><div class=\"wcl-homeValue_x2\"><strong data-testid=\"wcl-scores-simpleText-01\">'||" + home
            + f"||'</strong></div><div class=\"wcl-category_x3\"><strong data-testid=\"wcl-scores-simpleText-01\">{label}</strong></div>"
            "<div class=\"wcl-awayValue_x4\"><strong data-testid=\"wcl-scores-simpleText-01\">'||" + away + "||'</strong></div></div>'")


def unsided(label: str, first: str, second: str) -> str:
    """A row whose values only their order tells apart."""
    return (f"'<div class=\"wcl-row_x1\"><div class=\"wcl-value_y\">'||{first}||'</div><div class=\"wcl-category_x3\">{label}</div>"
            f"<div class=\"wcl-value_y\">'||{second}||'</div></div>'")


_SECTION = "||".join([
    "'<section title=\"Full Time\">'",
    "'<div class=\"stat__row\">1% Ball Possession 99%</div>'",                  # the component row goes before it
    component("Ball Possession", f"{num('30+match_id%41')}||'.5%'", f"{num('69-match_id%41')}||'.5%'"),
    component("Expected goals (xG)", f"{num('match_id%4')}||'.25'", f"{num('match_id%3')}||'.75'"),
    component("Corner Kicks", "'-'", num("match_id%9")),                           # unreadable, the plain row counts
    unsided("Shots on Goal", num("match_id%11"), num("match_id%13")),
    f"'<div class=\"statRow\">'||{num('match_id%9')}||' Corner Kicks '||{num('match_id%7')}||'</div>'",
    f"'<div class=\"stat__row\">'||{num('match_id%17')}||' Fouls '||{num('match_id%19')}||' of '||{num('100+match_id%5')}||'</div>'",
    f"'<div class=\"section\"><div>'||{num('match_id%5')}||' of 9 Offsides '||{num('match_id%6')}||'</div><div>No numbers</div></div>'",
    "'</section>'"])


def _prices(total: str) -> str:
    return f"'<tr><td>'||'Book'||'</td>'||{total}||'<td>1.'||{num('10+match_id%80')}||'</td><td>2.'||{num('10+match_id%70')}||'</td></tr>'"


def _over_under(period: str, heads: str, total: str) -> str:
    return f"'<table data-market=\"Over/Under\" data-period=\"{period}\"><tr>{heads}</tr>'||{_prices(total)}||'</table>'"


_OWN = f"'<td class=\"total\">'||{num('match_id%3')}||'.5</td>'"
_TOTALS = "||".join([
    f"'<table data-market=\"Over/Under\" data-period=\"Full Time\"><tr><th>BOOKMAKER</th><th>OVER '||{num('1+match_id%6')}||'.5</th><th>UNDER</th></tr>'||{_prices(_OWN)}||'</table>'",
    _over_under("1st Half", "<th>BOOKMAKER</th><th>TOTAL</th><th>OVER 9.5</th>", _OWN),
    _over_under("2nd Half", "<th>BOOKMAKER</th><th>OVER</th><th>UNDER</th>", "''")])

_ARCHIVE = ("'<div class=\"archive\"><div class=\"archive__row\"><div><a href=\"/league/'||season||'/\" class=\"archive__text archive__text--clickable\"> '"
            "||competition||' </a></div>'||case when match_id%4=0 then '' else '<div class=\"archive__winner\"><span><a href=\"/team\">'||home_team||'</a></span></div>' end"
            "||'</div><div class=\"archive__row\"><a class=\"archive__text\">no link</a></div></div>'")


def layout_pages(spark, sf_dir):
    """One page per match, of the layouts above."""
    return spread(matches(spark, sf_dir)).selectExpr(
        "match_id as page_id", f"'<html>'||{_SECTION}||{_TOTALS}||{_ARCHIVE}||'</html>' as html")


_VALUES = {
    "possession": ("30.5+match_id%41", "69.5-match_id%41"), "expected_goals": ("0.25+match_id%4", "0.75+match_id%3"),
    "shots_on_goal": ("match_id%11", "match_id%13"), "corner_kicks": ("match_id%9", "match_id%7"),
    "fouls": ("match_id%17", "match_id%19"), "offsides": ("match_id%5", "match_id%6"),
}


@query("X04_row_layouts", M + " " + " union all ".join(
    f"select match_id as page_id, 'Full Time' as period, '{stat}' as stat, ({h})::double as home, ({a})::double as away from m"
    for stat, (h, a) in _VALUES.items()))
def row_layouts(spark, sf_dir):
    return rounded(pages.stat_rows(layout_pages(spark, sf_dir)))


@query("X06_header_totals", M + (
    " select match_id as page_id, unnest(['Full Time', '1st Half', '2nd Half']) as period,"
    " unnest([1.5::double+match_id%6, 0.5::double+match_id%3, 2.5::double]) as line from m"))
def header_totals(spark, sf_dir):
    found = pages.odds_rows(layout_pages(spark, sf_dir)).where("selection = 'over'")
    return found.select("page_id", "period", F.col("line"))


@query("X02_archive_rows", M + (
    " select match_id as page_id, trim(competition) as name, '/league/'||season||'/' as url,"
    " case when match_id%4=0 then '' else home_team end as winner from m"))
def archive_rows(spark, sf_dir):
    return pages.archive_rows(layout_pages(spark, sf_dir))
