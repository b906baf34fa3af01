import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, wanted = registry.queries()[name](spark, SF).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(corpus_pipeline.STAGES) == 5
