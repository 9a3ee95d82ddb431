"""Search of a catalog: every match without a limit, else the first ones and whether there are more."""

import pytest

from cairn.operators import catalog


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(a, f"/d/f{i}.txt", i) for a in (2, 1) for i in range(5)] + [(1, "/d/x.bin", 9)]
    return spark.createDataFrame(rows, "archive_id long, path string, size long")


@pytest.mark.parametrize("limit,truncated", [(3, True), (9, True), (10, False), (11, False)])
def test_limit(entries, limit, truncated):
    want = [(a, f"/d/f{i}.txt", i, truncated) for a in (1, 2) for i in range(5)][:limit]
    got = catalog.search(entries, "*.txt", limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_limit(entries):
    got = catalog.search(entries, "*.txt", limit=None)
    assert got.columns == ["archive_id", "path", "size"] and got.count() == 10
