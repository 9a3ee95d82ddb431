"""Block codecs, filters, volumes and repair: round trips and planted damage."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import codec as K
from cairn.operators import volumes as V

RNG = random.Random(5)


def test_blocks_round_trip_and_damage(spark):
    rows = [(1, b"abc" * 1000), (2, RNG.randbytes(3000)), (3, b""), (4, None), (5, b"x")]
    content = spark.createDataFrame(rows, "k int, d binary")
    packed = K.compress_blocks(K.split_blocks(content, "k", "d", 1024)).cache()
    assert {(r.k, r.n) for r in packed.groupBy("k").agg(F.count("*").alias("n")).collect()} == {(1, 3), (2, 3), (5, 1)}
    assert {r.codec for r in packed.where("k = 2 or k = 5").collect()} == {"store"} and packed.where("k = 1").agg(F.max("csize")).first()[0] < 200
    plain = {}
    for r in K.decompress_blocks(packed).orderBy("k", "block_no").collect():
        plain[r.k] = plain.get(r.k, b"") + bytes(r.data)
    assert plain == {1: rows[0][1], 2: rows[1][1], 5: b"x"}
    assert K.test_blocks(packed, ["k", "block_no"]).count() == 0
    broken = packed.withColumn("data", F.when(F.col("block_no") == 1, F.concat(F.lit(b"?"), F.expr("substring(data, 2)"))).otherwise(F.col("data")))
    bad = {(r.k, r.block_no): r.status for r in K.test_blocks(broken, ["k", "block_no"]).collect()}
    assert set(bad) == {(1, 1), (2, 1)} and bad[2, 1] == "bad crc"
    short = packed.withColumn("usize", F.col("usize") - 1)
    assert K.test_blocks(short, ["k"]).count() == packed.count()


@pytest.mark.parametrize("p", K.PARAMETERS)
@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 258, 259, 5001, 20000])
def test_word16_round_trip(p, n):
    raw = RNG.randbytes(n)
    assert K.word16_decode(K.word16_encode(raw, p), p) == raw


def test_word16_against_a_plain_loop():
    raw, width = RNG.randbytes(1200), 128
    w = struct.unpack("<600H", raw)
    r = [w[i] if i <= width else (w[i] - w[i - 1] - w[i - width] + w[i - width - 1]) & 65535 for i in range(600)]
    z = [2 * x if x < 32768 else 2 * (65536 - x) - 1 for x in r]
    assert K.word16_encode(raw, 7) == bytes(x & 255 for x in z) + bytes(x >> 8 for x in z)


def test_screens(spark):
    noise, ramp = RNG.randbytes(1 << 20), bytes(range(256)) * 4096
    smooth = (np.cumsum(np.random.default_rng(1).integers(-3, 4, 1 << 18)) + 20000).astype("<u2").tobytes()
    rows = [(1, noise), (2, ramp), (3, noise[:-1]), (4, smooth), (5, None)]
    got = {r.k: (r.incompressible, r.predictor) for r in K.screen(spark.createDataFrame(rows, "k int, d binary"), "k", "d").collect()}
    assert got == {1: (True, None), 2: (False, got[2][1]), 3: (False, None), 4: (False, 0), 5: (False, None)}


def test_branch_filter():
    raw = bytes([0x90, 0xE8, 1, 0, 0, 0, 0xE9, 0xE8, 0, 0, 0, 0x90, 0xE8, 1])
    coded = K.branch_filter(raw, 1000)
    assert coded == bytes([0x90, 0xE8]) + (1 + 1006).to_bytes(4, "little") + bytes([0xE9]) + (0xE8 + 1011).to_bytes(4, "little") + raw[11:]
    assert K.branch_filter(coded, 1000, False) == raw
    noisy = bytes(RNG.choice([0xE8, 0xE9, 1, 2]) for _ in range(500))
    assert K.branch_filter(K.branch_filter(noisy, 7), 7, False) == noisy


def test_matrix_is_systematic_and_any_rows_invert():
    m = V.encoding_matrix(5, 4)
    assert (m[:5] == np.eye(5)).all()
    for _ in range(20):
        rows = sorted(RNG.sample(range(9), 5))
        assert (V.gf_matmul(V.gf_inverse(m[rows]), m[rows]) == np.eye(5)).all()


def test_repair(spark):
    pieces = [("s", st, i, RNG.randbytes(40)) for st in (0, 1, 2) for i in range(4)]
    full = V.encode_parity(spark.createDataFrame(pieces, "set_id string, stripe long, shard int, data binary"), 4, 2)
    rows = [tuple(r) for r in full.collect()]
    assert len(rows) == 18
    hurt = []
    for s, st, i, d, c in rows:
        if (st, i) in {(0, 1), (2, 0), (2, 1), (2, 5)}:
            continue
        hurt.append((s, st, i, b"!" + bytes(d)[1:] if (st, i) == (0, 4) else bytes(d), c))
    back = V.repair(spark.createDataFrame(hurt, V.SHARDS), 4, 2).collect()
    want = {(st, i): bytes(d) for _, st, i, d, _ in rows}
    assert len(back) == 18
    assert {(r.stripe, r.shard) for r in back if r.state == "lost"} == {(2, 0), (2, 1), (2, 5)}
    assert {(r.stripe, r.shard) for r in back if r.state == "repaired"} == {(0, 1), (0, 4)}
    assert all(bytes(r.data) == want[r.stripe, r.shard] for r in back if r.state != "lost")


def test_volume_layout_and_parts(spark):
    a = spark.createDataFrame([("x", 10), ("y", 0), ("z", 8)], "archive_id string, bytes long")
    got = sorted(tuple(r) for r in V.volume_layout(a, 4).collect())
    assert got == [("x", 0, 0, 4), ("x", 1, 4, 8), ("x", 2, 8, 10), ("y", 0, 0, 0), ("z", 0, 0, 4), ("z", 1, 4, 8)]
    g = {r.archive_id: (r.data_shards, r.parity_shards, r.shard_size) for r in V.recovery_geometry(spark.createDataFrame([("a", 0), ("b", 3 << 20), ("c", 1 << 40)], "archive_id string, bytes long"), 10).collect()}
    assert g == {"a": (1, 1, 1), "b": (3, 1, 1 << 20), "c": (231, 24, -(-(1 << 40) // 231))}
    want = spark.createDataFrame([("x", 0, 5), ("x", 1, 0)], "archive_id string, part long, crc long")
    have = spark.createDataFrame([("x", 0, b"q")], "archive_id string, part long, data binary")
    assert {(r.part, r.state) for r in V.missing_parts(want, have).collect()} == {(0, "bad crc"), (1, "missing")}
    parts = spark.createDataFrame([("p", 1, 2), ("p", 1, 2), ("q", 1, 2), ("q", 1, 3)], "set_id string, n int, size int")
    assert [r.set_id for r in V.foreign_parts(parts, ["n", "size"]).collect()] == ["q"]
