import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from check_oracles import session
    return session("4")


@pytest.fixture(scope="session")
def matches_of(spark):
    """Build a matches table from (date, home, away, home_score, away_score) rows; ids by position."""
    import datetime

    def build(rows):
        data = [(i, datetime.date.fromisoformat(d), h, a, hs, as_) for i, (d, h, a, hs, as_) in enumerate(rows)]
        return spark.createDataFrame(
            data, "match_id bigint, date date, home_team string, away_team string, home_score int, away_score int")
    return build
