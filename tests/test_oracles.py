"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

from cairn import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if hasattr(v, "normalize") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    assert got
    if name in registry.ORACLES:
        q = duck.sql(registry.ORACLES[name])
        assert sorted(q.columns) == cols
        at = [q.columns.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)
