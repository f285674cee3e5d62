"""Each registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from codeloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x if x is None or isinstance(x, (int, bool, str)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert len(got) > 0 or name in ("explain_file", "shared_callers", "shortest_path")  # these are empty on the smallest tables
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
        assert len(got) == len(want)
        assert got == want
