import os

import duckdb
import pytest

import __spark_entry__
from finquarry.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in queries.queries()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in __spark_entry__.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    twin = duck.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    order = sorted(twin.columns)
    assert sorted(df.columns) == order
    have = sorted(tuple(r[c] for c in order) for r in df.collect())
    assert [tuple(map(str, r)) for r in have] == [tuple(map(str, r)) for r in sorted(twin.select(*order).fetchall())]
