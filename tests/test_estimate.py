"""Edge cases of estimates, frequencies and the catalog's constraint queries."""

from cairn.operators import catalog as C
from cairn.operators import estimate as M


def test_frequencies_sum_to_the_target(spark):
    rows = [("a", i, n) for i, n in enumerate([1] * 12 + [10_000])] + [("b", 0, 3), ("b", 1, 3), ("b", 2, 3)]
    got = M.normalise(spark.createDataFrame(rows, "k string, symbol int, n long"), "k", target=16).collect()
    f = {k: [r.freq for r in sorted(got, key=lambda r: r.symbol) if r.k == k] for k in "ab"}
    assert f == {"a": [1] * 12 + [4], "b": [6, 5, 5]}


def test_estimate_without_bytes_or_probes(spark):
    a = spark.createDataFrame([("none", 0, 0, 100), ("unread", 2, 500, 100), ("read", 1, 1000, 100)], "archive_id string, files long, source_bytes long, overhead long")
    p = spark.createDataFrame([("read", 1, 600, 300), ("read", 2, 400, 100), ("read", 3, 0, 0)], "archive_id string, ordinal long, bytes long, packed long")
    got = {r.archive_id: (r.probes, r.estimated, r.low, r.high, r.confidence, r.volumes) for r in M.estimate(a, p, 64, 1 << 20, volume=300).collect()}
    assert got == {"none": (0, 100, 100, 100, "high", 1), "unread": (0, 600, 100, 600, "low", 2), "read": (2, 500, 460, 540, "high", 2)}


def test_sample_of_nothing(spark):
    empty = spark.createDataFrame([], "archive_id string, path string, size long")
    assert M.sample_regions(empty, 100, 10).count() == 0


def test_move_violations(spark):
    e = spark.createDataFrame(
        [("x", "d", "directory", None), ("x", "d/f", "file", None), ("x", "g", "file", None), ("x", "l", "hardlink", "g")], "archive_id string, path string, kind string, link_target string"
    )

    def rules(*moves):
        return {r.rule for r in C.move_violations(e, spark.createDataFrame([("x", *m) for m in moves], "archive_id string, src string, dest string")).collect()}

    assert rules(("g", "h")) == set()
    assert rules(("d", "e/d")) == set()
    assert rules(("g", "g")) == {"source is destination"}
    assert "into its own subtree" in rules(("d", "d/e"))
    assert "no such source" in rules(("dd", "e"))
    assert "sources overlap" in rules(("d", "p"), ("d/f", "q"))
    assert "destination exists" in rules(("g", "d/f"))
    assert {"parent is not a directory"} <= rules(("d/f", "g/f"))
