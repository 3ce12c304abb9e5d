"""The Spark fixture builders and their DuckDB SQL twins give the same rows."""

import duckdb
import pytest

from mintlens.plans.compare import same
from mintlens.plans.queries import comparable
from mintlens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in fx.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(fx.FIXTURES))
def test_fixture_matches_its_sql(spark, con, name):
    got = comparable(fx.FIXTURES[name](spark, SF)).toPandas()
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c == "price" else c for c in got.columns)
    want = con.sql(f"SELECT {cols} FROM ({fx.FX_SQL[name]}) t").df()
    ok, why = same(got, want)
    assert ok, why
