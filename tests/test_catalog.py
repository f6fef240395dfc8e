"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pytest

from quire.plans import catalog, edition, gates, placement, publishing, rules, texts  # noqa: F401  (these add their queries to the catalogue)

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got, cols = df.toPandas(), sorted(df.columns)
    if name not in catalog.ORACLE:
        assert len(got.columns) == len(set(cols))
        return
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(want.columns) == cols
    rows = lambda x: sorted(map(str, x[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
