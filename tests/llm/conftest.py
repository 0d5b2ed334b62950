import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def query():
    return entry.queries()


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with a row number and columns of clashing names."""
    def build(rows, *extra):
        data = [(i, t, None, n, *(["x"] * len(extra))) for n, (i, t) in enumerate(rows)]
        columns = "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, row_no bigint{columns}").coalesce(2)
    return build
