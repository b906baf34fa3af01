import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "orders", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(found)
        return
    wanted = duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
