"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from wayveil.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ("events", "lineitem", "part", "nation", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame, columns):
    tidy = lambda v: None if v is None or v != v else (round(float(v), 4) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return sorted((tuple(tidy(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4 * max(1, abs(p))) for p, q in zip(x, y))
