"""Team geography: city from the team name and great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known cities in lookup order, (latitude, longitude).
CITY_COORDINATES = {
    "madrid": (40.4168, -3.7038),
    "barcelona": (41.3851, 2.1734),
    "valencia": (39.4699, -0.3763),
    "sevilla": (37.3891, -5.9845),
    "bilbao": (43.2627, -2.9253),
    "vigo": (42.2406, -8.7207),
}
DEFAULT_CITY = "madrid"
EARTH_RADIUS_KM = 6371
# Words whose presence in both names marks a derby.
DERBY_KEYWORDS = ["real", "atletico", "barcelona", "madrid", "sevilla", "valencia"]


def team_city(team: Column) -> Column:
    """First known city contained in the name, else the default city."""
    lowered = F.lower(team)
    known = F.coalesce(*[F.when(lowered.contains(c), F.lit(c)) for c in CITY_COORDINATES])
    return F.coalesce(known, F.lit(DEFAULT_CITY))


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    chord = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return math.asin(math.sqrt(chord)) * 2 * EARTH_RADIUS_KM


def travel_km(team: Column, venue_team: Column) -> Column:
    """Distance from the team's city to the venue team's city; 0 inside one city.

    Cities are few and fixed, so the distances between them are a constant map, and a plan holds each name's city once.
    """
    between = F.create_map(*[x for a, here in CITY_COORDINATES.items() for b, there in CITY_COORDINATES.items()
                             for x in (F.lit(f"{a}>{b}"), F.lit(0.0 if a == b else _km(here, there)))])
    return F.element_at(between, F.concat(team_city(team), F.lit(">"), team_city(venue_team)))


def derby_score(home: Column, away: Column) -> Column:
    home, away = F.lower(home), F.lower(away)
    shared = sum(
        (F.when(home.contains(k) & away.contains(k), 1.0).otherwise(0.0) for k in DERBY_KEYWORDS),
        F.lit(0.0))
    return F.least(shared / len(DERBY_KEYWORDS), F.lit(1.0))
