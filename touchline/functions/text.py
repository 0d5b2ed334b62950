"""Text parsing: names, dates, scores, odds, page fields.  All native expressions, null when unparsable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name prefixes and what they stand for, tried in this order.
NAME_PREFIXES = {
    "Atl ": "Atletico ",
    "Dep ": "Deportes ",
    "CF ": "Club de Futbol ",
    "FC ": "Football Club ",
    "SC ": "Sporting Club ",
}
# Stage keywords, first hit wins.
STAGE_KEYWORDS = [
    "final", "semi-final", "quarter-final", "round of 16", "group", "qualification", "play-offs",
    "play offs", "regular season",
]
# Statistic labels on a page and the fields they fill.
STAT_LABELS = {
    "Ball Possession": "possession",
    "Goal Attempts": "goal_attempts",
    "Shots on Goal": "shots_on_goal",
    "Shots off Goal": "shots_off_goal",
    "Blocked Shots": "blocked_shots",
    "Corner Kicks": "corner_kicks",
    "Goalkeeper Saves": "goalkeeper_saves",
    "Offsides": "offsides",
    "Fouls": "fouls",
    "Yellow Cards": "yellow_cards",
    "Red Cards": "red_cards",
    "Big Chances": "big_chances",
    "Shots inside box": "shots_inside_box",
    "Shots outside box": "shots_outside_box",
    "Expected goals (xG)": "expected_goals",
}
# Markets collected, in this order, with the link part that names them.
TARGET_MARKETS = {
    "1X2": "1x2",
    "Over/Under": "over-under",
    "Both teams to score": "both-teams-to-score",
    "Correct score": "correct-score",
    "Odd/Even": "odd-even",
}
# Bookmakers recognised by a keyword in the row text.
BOOKMAKER_KEYWORDS = {"bet365": "bet365", "unibet": "Unibet", "william": "William Hill"}

# The helper used for scores and odds and the two date helpers know different layouts.
PARSING_FORMATS = ("d.M.yyyy H:m", "yyyy-M-d H:m", "d/M/yyyy H:m")
VALIDATION_FORMATS = ("d.M.yyyy H:m", "d.M.yy H:m", "yyyy-M-d H:m")
PAGE_FORMATS = ("d.M.yyyy H:m", "d.M.yyyy", "yyyy-M-d H:m", "yyyy-M-d")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_team_name(name: Column) -> Column:
    return F.regexp_replace(strip(name), r"(?U)\s+", " ")


def normalise_name(name: Column) -> Column:
    """Lookup key: lower case, trimmed, without spaces."""
    return F.replace(strip(F.lower(name)), F.lit(" "), F.lit(""))


def expand_prefixes(name: Column) -> Column:
    """Spell out each known prefix once, in table order."""
    out = strip(name)
    for short, long in NAME_PREFIXES.items():
        out = F.regexp_replace(out, "^" + short, long)
    return out


def parse_date(text: Column, formats=PARSING_FORMATS) -> Column:
    """First layout that fits; two-digit years pivot at 69 (1969..2068)."""
    trimmed = strip(text)
    tried = []
    for fmt in formats:
        stamp = F.try_to_timestamp(trimmed, F.lit(fmt))
        if "yyyy" not in fmt:
            stamp = F.when(F.year(stamp) >= 2069, F.add_months(stamp, -1200).cast("timestamp")
                           + (stamp - F.date_trunc("day", stamp))).otherwise(stamp)
        tried.append(stamp)
    return F.coalesce(*tried)


def parse_score(text: Column) -> Column:
    pattern = r"^(\d+)\s*-\s*(\d+)"
    trimmed = strip(text)

    def part(group: int) -> Column:
        return F.regexp_extract(trimmed, pattern, group).try_cast("int")

    return F.struct(part(1).alias("home"), part(2).alias("away"))


def parse_percentage(text: Column) -> Column:
    return F.regexp_replace(text, "^%+|%+$", "").try_cast("double")


def parse_plain_odds(text: Column) -> Column:
    return strip(text).try_cast("double")


def parse_odds(text: Column) -> Column:
    """Number in a price cell; empty, '-', 'N/A' and anything without digits give 0."""
    dotted = F.replace(strip(text), F.lit(","), F.lit("."))
    number = F.regexp_extract(dotted, r"(\d+\.?\d*)", 1)
    missing = F.upper(strip(text)).isin("N/A", "-", "")
    return F.when(missing, 0.0).otherwise(F.coalesce(number.try_cast("double"), F.lit(0.0)))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def match_id_from_url(url: Column) -> Column:
    """The path part after /match/, else the last segment of the whole URL."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    found = F.regexp_extract(path, r"/match/([^/]*)", 1)
    return F.when(path.contains("/match/"), found).otherwise(last_segment(url))


def stored_id_from_url(url: Column) -> Column:
    """Id used by the resume rule: the last segment, cut at its fragment."""
    return F.element_at(F.split(last_segment(url), "#"), 1)


def season_year(url: Column, date_text: Column, explicit: Column | None = None) -> Column:
    from_url = F.regexp_extract(url, r"primera-a-(\d{4})", 1)
    from_date = F.regexp_extract(date_text, r"\d{2}\.\d{2}\.(\d{4})", 1)
    options = [F.when(c != "", c) for c in ([explicit] if explicit is not None else [])]
    return F.coalesce(*options, F.when(from_url != "", from_url), F.when(from_date != "", from_date))


def competition(breadcrumb: Column) -> Column:
    return F.element_at(F.split(strip(breadcrumb), " - "), 1)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    return F.array_join(
        F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1)),
                    lambda w: F.initcap(w)), "")


def stage(header: Column, breadcrumb: Column) -> Column:
    lowered = F.lower(header)
    hit = F.coalesce(*[
        F.when(lowered.contains(k), F.lit(k.title())) for k in STAGE_KEYWORDS])
    parts = F.split(strip(breadcrumb), " - ")
    tail = F.when(F.size(parts) > 1, strip(F.element_at(parts, -1)))
    return F.coalesce(hit, tail, F.lit("Regular Season"))


def status(explicit: Column, page_text: Column) -> Column:
    return (
        F.when(strip(explicit) != "", strip(explicit))
        .when(page_text.contains("FINISHED") | page_text.contains("FT"), "Finished")
        .when(page_text.contains("POSTPONED"), "Postponed")
        .when(page_text.contains("CANCELLED"), "Cancelled")
        .otherwise("Finished")
    )


def info_field(text: Column, *labels: str) -> Column:
    """Value after one of the labels, up to the end of the line; labels are case-insensitive."""
    pattern = "(?:" + "|".join(labels) + r"):?\s*([^\n<]+)"
    found = F.regexp_extract(F.lower(text), pattern, 1)
    return F.when(found != "", found)


def attendance(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), r"attendance:?\s*([\d,.]+)", 1)
    return F.regexp_replace(found, "[,.]", "").try_cast("int")


def stat_field(row_text: Column) -> Column:
    """Which statistic a row of text shows: first label contained in it, ignoring case."""
    lowered = F.lower(row_text)
    return F.coalesce(*[
        F.when(lowered.contains(label.lower()), F.lit(field)) for label, field in STAT_LABELS.items()])


def stat_numbers(row_text: Column, last: bool = True) -> Column:
    """First and last (else second) number of a row, as text; null where a row has fewer than two."""
    def ends(numbers: Column) -> Column:
        return F.when(F.size(numbers) >= 2, F.array(F.element_at(numbers, 1), F.element_at(numbers, -1 if last else 2)))

    found = F.regexp_extract_all(row_text, F.lit(r"([\d.]+)%?"), F.lit(1))
    return F.get(F.transform(F.array(found), ends), F.lit(0))     # one name for ``found``, so that it is matched once


def stat_values(row_text: Column, field: Column) -> Column:
    """First and last number of a row; whole numbers unless expected goals."""
    numbers = stat_numbers(row_text)

    def value(index: int) -> Column:
        x = F.get(numbers, index).try_cast("double")
        return F.when(field == "expected_goals", x).otherwise(F.floor(x).cast("double"))

    return F.when(numbers.isNotNull(), F.struct(value(0).alias("home"), value(1).alias("away")))


def market_type(name: Column) -> Column:
    lowered = F.lower(name)
    exact = F.coalesce(*[
        F.when(lowered == m.lower(), F.lit(t)) for m, t in _MARKET_TYPES.items()])
    partial = (
        F.when(lowered.contains("1x2"), "match_winner")
        .when(lowered.contains("over/under") | lowered.contains("o/u"), "over_under")
        .when(lowered.contains("both teams to score") | lowered.contains("btts"),
              "both_teams_to_score")
        .when(lowered.contains("correct score"), "correct_score")
        .when(lowered.contains("odd/even") | lowered.contains("odd even"), "odd_even")
        .otherwise("match_winner")
    )
    return F.coalesce(exact, partial)


_MARKET_TYPES = {
    "1X2": "match_winner", "Over/Under": "over_under", "Both teams to score": "both_teams_to_score",
    "Correct score": "correct_score", "Odd/Even": "odd_even",
}


def period_name(label: Column) -> Column:
    lowered = F.lower(strip(label))
    return (
        F.when(lowered.contains("full") | lowered.contains("match") | (lowered == "ft"), "Full Time")
        .when(lowered.contains("1st") | lowered.contains("first") | (lowered == "1h"), "1st Half")
        .when(lowered.contains("2nd") | lowered.contains("second") | (lowered == "2h"), "2nd Half")
        .otherwise(strip(label))
    )


def periods(labels: Column) -> Column:
    """Distinct period names in order of appearance; Full Time when there is none."""
    named = F.array_distinct(F.transform(F.filter(labels, lambda x: strip(x) != ""), period_name))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("Full Time")))


def team_from_slug(url: Column) -> Column:
    slug = F.regexp_extract(url, r"/team/([^/]*)", 1)
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


def available_markets(titles: Column, links: Column, fast: bool = False) -> Column:
    """For each target market, in target order: the first tab title containing it, else the
    target's own name when a link names the market or, outside fast mode, in any case.

    Titles that match no target are ignored, and 1X2 is always offered.
    """
    def holding(words: str):
        return lambda x: F.lower(x).contains(words)

    picked = []
    for target, part in TARGET_MARKETS.items():
        hits = F.filter(titles, holding(target.lower()))
        linked = F.exists(links, holding("/odds-comparison/" + part))
        kept = F.lit(True) if target == "1X2" or not fast else linked
        picked.append(F.when(F.size(hits) > 0, F.element_at(hits, 1)).when(kept, F.lit(target)))
    return F.array_compact(F.array(*picked))


def bookmaker(name: Column, logo: Column, row_text: Column) -> Column:
    """Name text, else logo text, else a known keyword in the row, else null (row dropped)."""
    lowered = F.lower(row_text)
    keyword = F.coalesce(*[
        F.when(lowered.contains(k), F.lit(v)) for k, v in BOOKMAKER_KEYWORDS.items()])
    usable = ~strip(name).isin("", "BOOKMAKER", "Unknown Bookmaker") & ~strip(name).rlike(r"^\d+\.?\d*$")
    return F.coalesce(F.when(usable, strip(name)), F.when(strip(logo) != "", strip(logo)), keyword)


def bookmaker_or_unknown(name: Column, first_cell: Column) -> Column:
    numeric = strip(first_cell).rlike(r"^\d+\.?\d*$")
    return F.coalesce(
        F.when(strip(name) != "", strip(name)),
        F.when((strip(first_cell) != "") & ~numeric, strip(first_cell)),
        F.lit("Unknown Bookmaker"))
