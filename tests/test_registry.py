"""Every registered query against its SQL in DuckDB, over the smallest tables; those without SQL give rows over the next larger ones, as the smallest hold no secrets."""

import duckdb
import pytest

from recollect.plans import registry

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    sql = registry.oracle_sql().get(name)
    frame = registry.queries()[name](spark, DATA if sql is not None else LARGER)
    rows, columns = frame.collect(), sorted(frame.columns)
    if sql is None:
        assert rows
        return
    result = duck.sql(sql)
    places = [result.columns.index(c) for c in columns]
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else v
    assert sorted(columns) == sorted(result.columns)
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in rows) == sorted(str(tuple(plain(r[i]) for i in places)) for r in result.fetchall())
