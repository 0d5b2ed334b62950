"""Page extraction: links, match records, statistics and odds rows from HTML text.

Pages are independent, so every extraction is a projection plus ``explode``; the only grouping keeps
the first of several equal rows of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text


def class_text(html: Column, cls: str) -> Column:
    return F.regexp_extract(html, rf'class="{cls}"[^>]*>([^<]*)<', 1)


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def blocks(html: Column, start: str) -> Column:
    """Parts of a page, each from one match of ``start`` to the next; what comes before the first is left out."""
    parts = F.split(F.concat(F.lit(" "), html), f"(?={start})")
    return F.slice(parts, F.lit(2), F.size(parts))


def inner_text(html: Column, cls: str) -> Column:
    """Text of the first element with a class that contains ``cls``, below any number of opening tags."""
    return F.regexp_extract(html, rf'class="[^"]*{cls}[^"]*"[^>]*>(?:<[^/>][^>]*>)*([^<]*)', 1)


def links(pages: DataFrame, keep: str | None = None) -> DataFrame:
    """Distinct links of all pages, optionally only those containing ``keep``."""
    found = pages.select(F.explode(all_matches(F.col("html"), r'href="([^"]+)"')).alias("url"))
    if keep is not None:
        found = found.where(F.col("url").contains(keep))
    return found.dropDuplicates(["url"])


def league_rows(pages: DataFrame) -> DataFrame:
    """(page, name, url, winner) of every archive row; winner is empty when the row names none."""
    row = F.explode(all_matches(
        F.col("html"), r'(<li><a href="[^"]*">[^<]*</a>(?:<span class="winner">[^<]*</span>)?</li>)'))
    html = F.col("row")
    return pages.select("page_id", row.alias("row")).select(
        "page_id",
        F.regexp_extract(html, r'<a href="[^"]*">([^<]*)</a>', 1).alias("name"),
        F.regexp_extract(html, r'<a href="([^"]*)">', 1).alias("url"),
        F.regexp_extract(html, r'<span class="winner">([^<]*)</span>', 1).alias("winner"))


def archive_rows(pages: DataFrame) -> DataFrame:
    """(page, name, url, winner) of every row of a season's archive; winner is empty when a row names none, and
    a row without a named link is left out."""
    rows = pages.select("page_id", F.explode(blocks(F.col("html"), '<div class="archive__row"')).alias("row"))
    link = F.regexp_extract("row", r'(<a [^>]*class="archive__text archive__text--clickable"[^>]*>[^<]*)', 1)
    return rows.select(
        "page_id", text.strip(F.regexp_extract(link, r">([^<]*)$", 1)).alias("name"),
        F.regexp_extract(link, r'href="([^"]*)"', 1).alias("url"),
        text.strip(inner_text(F.col("row"), "archive__winner")).alias("winner")).where("name <> ''")


def match_records(pages: DataFrame) -> DataFrame:
    """Typed match fields of each page; unreadable fields stay null with a quarantine reason."""
    html = F.col("html")
    # raw field texts first, so that no pattern is matched twice over the page
    raw = pages.select(
        "page_id", "url",
        class_text(html, "tournamentHeader__country").alias("header"),
        class_text(html, "duelParticipant__startTime").alias("start"),
        class_text(html, "detailScore__wrapper").alias("score"),
        class_text(html, "detailScore__status").alias("shown_status"),
        strip_tags(html).alias("body"),
        F.array_join(all_matches(html, r'class="matchInfoData">([^<]*)<'), "\n").alias("info"),
        *[F.regexp_extract(html, rf'class="duelParticipant__{s}">(.*?)</div>', 1).alias(s)
          for s in ("home", "away")])
    raw = raw.select(
        "*", *[text.strip(class_text(F.col(s), "participant__participantName")).alias(f"{s}_name")
               for s in ("home", "away")])

    def team(side: str) -> Column:
        name = F.col(f"{side}_name")
        return F.when(name != "", name).otherwise(
            F.nullif(text.team_from_slug(F.col(side)), F.lit("")))

    score, info = text.parse_score(F.col("score")), F.col("info")
    out = raw.select(
        "page_id",
        text.match_id_from_url(F.col("url")).alias("match_key"),
        text.parse_date(F.col("start"), text.PAGE_FORMATS).cast("timestamp").alias("kickoff"),
        text.competition(F.col("header")).alias("competition"),
        text.season_year(F.col("url"), F.col("start")).alias("season"),
        text.stage(F.col("header"), F.col("header")).alias("stage"),
        team("home").alias("home_team"), team("away").alias("away_team"),
        score["home"].alias("home_score"), score["away"].alias("away_score"),
        text.status(F.col("shown_status"), F.col("body")).alias("status"),
        text.info_field(info, "venue", "stadium").alias("venue"),
        text.info_field(info, "referee").alias("referee"),
        text.attendance(info).alias("attendance"),
        text.info_field(info, "weather").alias("weather"),
    )
    reason = F.concat_ws(
        ",",
        F.when(F.col("kickoff").isNull(), F.lit("date")),
        F.when(F.col("home_team").isNull() | F.col("away_team").isNull()
               | (F.col("home_team") == F.col("away_team")), F.lit("teams")),
        F.when(F.col("home_score").isNull() | F.col("away_score").isNull(), F.lit("score")))
    return out.withColumn("quarantine", reason)


_LAYOUT = 1 << 32     # places of one layout


def _stat_candidates(section: Column) -> Column:
    """Rows of a section that may show a statistic, best layout first: array<struct<layout, label, numbers>>.

    A component row holds label, home value and away value in elements of their own; a plain row is one text
    with the values as its first two numbers; any other row of a list has them first and last.
    """
    number = r"[\d.]+"

    def component(row: Column) -> Column:
        labels = all_matches(row, r'(?:<strong[^>]*data-testid="wcl-scores-simpleText[^>]*>|class="[^"]*-category_[^"]*"[^>]*>)'
                                  r'(?:<[^/>][^>]*>)*([^<]*)')
        named = F.array(*[F.regexp_extract(inner_text(row, f"-{side}Value_"), number, 0) for side in ("home", "away")])
        shown = F.transform(F.slice(all_matches(row, r'class="[^"]*-value_[^"]*"[^>]*>(?:<[^/>][^>]*>)*([^<]*)'), 1, 2),
                            lambda x: F.regexp_extract(x, number, 0))
        return F.struct(F.lit(0).alias("layout"), F.array_join(labels, " ").alias("label"),
                        F.when(~F.array_contains(named, ""), named).otherwise(shown).alias("numbers"))

    def row_of(layout: int, last: bool):
        return lambda row: F.struct(F.lit(layout).alias("layout"), row.alias("label"), text.stat_numbers(row, last).alias("numbers"))

    lists = all_matches(section, r'<div class="section">((?:<div>[^<]*</div>)*)</div>')
    return F.concat(
        F.transform(blocks(section, r'<div class="[^"]*-row_'), component),
        F.transform(all_matches(section, r'class="(?:stat__row|statRow)">([^<]*)<'), row_of(1, False)),
        F.transform(all_matches(F.array_join(lists, ""), r"<div>([^<]*)</div>"), row_of(2, True)))


def stat_rows(pages: DataFrame) -> DataFrame:
    """(page, period, stat, home, away); of several rows showing a statistic the best layout wins, then the first."""
    # the outer form: before the inner one Spark puts a filter on the array, which matches all its patterns again
    sections = pages.select("page_id", F.explode_outer(
        all_matches(F.col("html"), r"(<section title=.*?</section>)")).alias("sec")).where("sec is not null")
    rows = sections.select(
        "page_id", F.regexp_extract("sec", r'title="([^"]*)"', 1).alias("period"),
        F.posexplode_outer(_stat_candidates(F.col("sec"))).alias("pos", "row")).where("row is not null").select(
        "page_id", "period", "pos", "row.*")
    typed = rows.select(
        "page_id", "period", text.stat_field(F.col("label")).alias("stat"),
        *[F.get("numbers", F.lit(i)).try_cast("double").alias(s) for i, s in enumerate(("home", "away"))],
        (F.col("layout") * F.lit(_LAYOUT) + F.col("pos")).alias("place")).where(
        "stat is not null and home is not null and away is not null")
    # places and values are plain numbers, which Spark aggregates without sorting
    best = typed.groupBy("page_id", "period", "stat").agg(
        F.min("place").alias("place"), F.min_by("home", "place").alias("home"), F.min_by("away", "place").alias("away"))
    exact = (F.col("place") < _LAYOUT) | (F.col("stat") == "expected_goals")
    return best.select("page_id", "period", "stat", *[
        F.when(exact, F.col(s)).otherwise(F.floor(s).cast("double")).alias(s) for s in ("home", "away")])


def shared_total(table: Column) -> Column:
    """The total that a table's header gives for all its rows: the number beside the first OVER or UNDER, unless a
    header named TOTAL comes first, whose rows have their own."""
    def decides(head: Column) -> Column:
        return F.upper(head).contains("TOTAL") | (F.upper(head).rlike("OVER|UNDER") & head.rlike(r"\d"))

    head = F.get(F.filter(all_matches(table, r"<th[^>]*>([^<]*)</th>"), decides), F.lit(0))
    return F.when(~F.upper(head).contains("TOTAL"), F.regexp_extract(head, r"(\d+\.?\d*)", 1).try_cast("double"))


def odds_rows(pages: DataFrame) -> DataFrame:
    """Long odds: (page, market, period, bookmaker, line, selection, price), valid rows only.

    1X2 needs all three prices, two-way markets at least one, a correct score its own price.
    """
    tables = pages.select(
        "page_id", F.explode(all_matches(F.col("html"), r"(<table data-market=.*?</table>)")).alias("t"))
    rows = tables.select(
        "page_id",
        F.regexp_extract("t", r'data-market="([^"]*)"', 1).alias("market_name"),
        F.regexp_extract("t", r'data-period="([^"]*)"', 1).alias("period_label"),
        shared_total(F.col("t")).alias("shared"),
        F.explode(all_matches(F.col("t"), r"<tr>(.*?)</tr>")).alias("row"))
    cells = rows.select(
        "page_id", text.market_type(F.col("market_name")).alias("market"),
        text.period_name(F.col("period_label")).alias("period"), "row", "shared",
        all_matches(F.col("row"), r"<td>(.*?)</td>").alias("cells"),
        F.regexp_extract("row", r'<img alt="([^"]*)"', 1).alias("logo"),
        F.regexp_replace("row", r'<img alt="|<[^>]+>', " ").alias("row_text"))
    cells = cells.withColumn("name", F.regexp_replace(F.element_at("cells", 1), r"<[^>]+>", ""))
    name = F.col("name")
    cells = cells.withColumn("bookmaker", F.when(
        F.col("market") == "match_winner",
        text.bookmaker(name, F.col("logo"), F.col("row_text")),
    ).when(F.col("market") != "correct_score", text.bookmaker_or_unknown(name, name)))
    total = F.regexp_extract("row", r'<td class="total">[^<]*?(\d+\.?\d*)', 1).try_cast("double")
    cells = cells.withColumn("line", F.when(
        F.col("market") == "over_under", F.coalesce("shared", total, F.lit(2.5))))
    price = [text.parse_odds(F.get("cells", i)) for i in (1, 2, 3)]
    cells = cells.select("page_id", "market", "period", "bookmaker", "line", "cells",
                         *[p.alias(f"p{i}") for i, p in enumerate(price, 1)])
    two = F.col("market").isin("over_under", "both_teams_to_score", "odd_even")
    valid = (
        ((F.col("market") == "match_winner") & F.col("bookmaker").isNotNull()
         & (F.col("p1") > 0) & (F.col("p2") > 0) & (F.col("p3") > 0))
        | (two & ((F.col("p1") > 0) | (F.col("p2") > 0)))
        | ((F.col("market") == "correct_score") & (F.col("p1") > 0)
           & F.element_at("cells", 1).rlike(r"^\d+-\d+"))
    )

    def picks(*names: str) -> Column:
        return F.array(*[
            F.struct(F.lit(n).alias("selection"), F.col(f"p{i}").alias("price"))
            for i, n in enumerate(names, 1)])

    quoted = (
        F.when(F.col("market") == "match_winner", picks("home_win", "draw", "away_win"))
        .when(F.col("market") == "over_under", picks("over", "under"))
        .when(F.col("market") == "both_teams_to_score", picks("yes", "no"))
        .when(F.col("market") == "odd_even", picks("odd", "even"))
        .otherwise(F.array(F.struct(F.element_at("cells", 1).alias("selection"),
                                    F.col("p1").alias("price"))))
    )
    return cells.where(valid).select(
        "page_id", "market", "period", "bookmaker", "line", F.explode(quoted).alias("q")
    ).select("page_id", "market", "period", "bookmaker", "line", "q.selection", "q.price")


def offered_markets(pages: DataFrame, fast: bool = False) -> DataFrame:
    titles = F.array_distinct(all_matches(F.col("html"), r'<a title="([^"]+)"'))
    hrefs = all_matches(F.col("html"), r'href="([^"]+)"')
    return pages.select("page_id", text.available_markets(titles, hrefs, fast).alias("markets"))
