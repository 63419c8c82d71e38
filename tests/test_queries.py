"""Every query of the library beside its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from nomoform.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"create view {p.split('.')[0]} as select * from read_parquet('{SF}/{p}')")
    return c


def norm(v):
    return v if not isinstance(v, float) else "nan" if math.isnan(v) else float(f"{v:.9g}")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rel = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(norm, r)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr) == want
