"""Every query of the catalogue against DuckDB on the same tables."""

import duckdb
import pytest

from corpusmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    text = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return frame.map(text).sort_values(names).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert plain(want).equals(plain(got))
