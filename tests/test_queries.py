"""Each query of the catalog runs at the smallest size and, where it has SQL, gives the rows that DuckDB gives."""

import duckdb
import pytest

from retort.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def plain(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = con.sql(catalog.SQL[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        assert plain(got, columns) == plain(want, columns)
