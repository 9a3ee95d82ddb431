"""Checksums of joined parts, sampled and screening entropy, ranges: against plain Python."""

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cairn.operators import streams as R
from cairn.registry import QUERIES

SF = "/root/testdata/sf0.001"


def order1(data):
    n, pairs, left = len(data), Counter(zip(b"\0" + data, data)), Counter((b"\0" + data)[:-1]) if data else Counter()
    return sum(-k * math.log2(k / left[a]) for (a, _), k in pairs.items()) / n if n else None


def test_crc_of_joined_parts(spark):
    parts = {"a": [b"12345", b"", b"6789"], "b": [bytes(range(256)) * 400, None, b"\0" * 70_001, b"x"], "c": [None], "d": [b""]}
    rows = [(k, i, None if p is None else zlib.crc32(p), None if p is None else len(p)) for k, ps in parts.items() for i, p in enumerate(ps)]
    frame = spark.createDataFrame(rows, "k string, i int, c long, n long").repartition(3)
    got = {r.k: (r.crc, r.size) for r in R.crc_combine(frame, ["k"], "i", "c", "n").collect()}
    whole = {k: b"".join(p or b"" for p in ps) for k, ps in parts.items()}
    assert got == {k: (zlib.crc32(w), len(w)) for k, w in whole.items()}
    assert got["a"][0] == 3421780262
    assert R.crc_combine(frame.limit(0), ["k"], "i", "c", "n").count() == 0


def test_crc_across_buckets(spark):
    texts = {i * R.PART_BUCKET // 2: f"part {i}".encode() * (i + 1) for i in range(9)}
    frame = spark.createDataFrame([("k", i, zlib.crc32(t), len(t)) for i, t in texts.items()], "k string, i long, c long, n long")
    whole = b"".join(texts.values())
    assert [tuple(r) for r in R.crc_combine(frame, ["k"], "i", "c", "n").collect()] == [("k", zlib.crc32(whole), len(whole))]


def test_archive_crc_of_all_documents(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("source", "text").collect():
        want[r.source] = want.get(r.source, b"") + (r.text or "").encode()
    got = {r.source: (r.crc, r.size) for r in QUERIES["archive_crc32"](spark, SF).collect()}
    assert got == {k: (f"{zlib.crc32(v):08X}", len(v)) for k, v in want.items()}


def test_sampled_entropy(spark):
    data = [b"", b"aaaa", b"abcabcab" * 3, bytes(i * i % 251 for i in range(1000)), None]
    frame = spark.createDataFrame(list(enumerate(data)), "i int, x binary")
    got = {r.i: r.bits for r in R.sampled_entropy(frame, "i", "x", chunk=8, count=4).collect()}

    def sample(x):
        return x if len(x) <= 32 else b"".join(x[(s := (len(x) - 8) * k // 3) : s + 8] for k in range(4))

    assert got == {i: abs(round(order1(sample(x)), 6)) for i, x in enumerate(data) if x}


def test_screen_entropy_is_8_without_bytes(spark):
    frame = spark.createDataFrame([(1, b""), (2, None), (3, b"ab"), (4, b"aaaa")], "i int, x binary")
    assert {r.i: r.bits for r in R.screen_entropy(frame, "i", "x").collect()} == {1: 8.0, 2: 8.0, 3: 1.0, 4: 0.0}


def test_blocks_of_empty_streams_and_levels_out_of_range(spark):
    frame = spark.createDataFrame([(1, 0), (2, None), (3, 5), (4, 4)], "i int, n long")
    assert sorted(map(tuple, R.uniform_blocks(frame, "i", "n", 4).collect())) == [(3, 0, 0, 4), (3, 1, 4, 1), (4, 0, 0, 4)]
    some = spark.createDataFrame([(-3,), (5,), (99,)], "level int")
    assert sorted(r.level for r in R.with_level(some, "level").select(F.col("level")).collect()) == [1, 5, 9]
