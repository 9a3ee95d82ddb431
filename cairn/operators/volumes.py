"""Volume sets: layout, shard checks, and Reed-Solomon parity and repair over GF(2^8)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.bytes import gf_tables

#: Shards of one set, data and parity together.
MOST = 255


def volume_layout(archives: DataFrame, volume: int) -> DataFrame:
    """(archive_id, part, first, last + 1) for archives (archive_id, bytes); an empty archive has one empty part."""
    last = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / volume))
    rows = archives.select("archive_id", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part"))
    return rows.select("archive_id", "part", (F.col("part") * volume).alias("begin"), F.least(F.col("bytes"), (F.col("part") + 1) * volume).alias("end"))


def recovery_geometry(archives: DataFrame, percent: int, target: int = 1 << 20) -> DataFrame:
    """Adds data_shards, parity_shards and shard_size: shards near target bytes, at most 255 in all, parity by percent, rounded up."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    most = max(1, MOST * 100 // (100 + percent))
    data = F.least(F.greatest(F.lit(1), F.ceil(F.col("bytes") / target)), F.lit(most)).cast("long")
    out = archives.withColumn("data_shards", data)
    parity = F.greatest(F.lit(1), F.least(MOST - F.col("data_shards"), F.floor((F.col("data_shards") * percent + 99) / 100))).cast("long")
    return out.withColumn("parity_shards", parity).withColumn("shard_size", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.col("data_shards"))).cast("long"))


def missing_parts(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Parts (archive_id, part, crc) without a present part (archive_id, part, data), or whose CRC differs."""
    have = present.select("archive_id", "part", F.crc32(F.col("data")).alias("found"))
    both = expected.join(have, ["archive_id", "part"], "left")
    return both.where("found is null or found <> crc").select("archive_id", "part", F.when(F.col("found").isNull(), "missing").otherwise("bad crc").alias("state"))


def foreign_parts(parts: DataFrame, identity: list[str]) -> DataFrame:
    """Sets (set_id) whose parts do not agree on the identity columns."""
    return parts.groupBy("set_id").agg(F.min(F.struct(*identity)).alias("a"), F.max(F.struct(*identity)).alias("b")).where("a <> b").select("set_id")


_EXP, _LOG = gf_tables()
EXP = np.array([*_EXP, *_EXP], np.uint8)
LOG = np.array(_LOG, np.int64)


def gf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element-wise product in GF(2^8)."""
    a, b = np.broadcast_arrays(a, b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def gf_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for i in range(a.shape[1]):
        out ^= gf_product(a[:, i : i + 1], b[i : i + 1, :])
    return out


def gf_inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    w = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(w[c:, c])[0])
        w[[c, p]] = w[[p, c]]
        w[c] = gf_product(w[c], EXP[255 - LOG[w[c, c]]])
        factor = w[:, c].copy()
        factor[c] = 0
        w ^= gf_product(factor[:, None], w[c][None, :])
    return w[:, n:]


def encoding_matrix(data: int, parity: int) -> np.ndarray:
    """Systematic Vandermonde matrix over the points 1, 2, ...: the identity on top, parity rows below."""
    if data < 1 or parity < 0 or data + parity > MOST:
        raise ValueError("1 to 255 shards")
    v = np.ones((data + parity, data), np.uint8)
    for c in range(1, data):
        v[:, c] = gf_product(v[:, c - 1], np.arange(1, data + parity + 1, dtype=np.int64).astype(np.uint8))
    return gf_matmul(v, gf_inverse(v[:data]))


SHARDS = "set_id string, stripe long, shard int, data binary, crc long"


def _rows(set_id, stripe, shards: dict[int, bytes]) -> pd.DataFrame:
    return pd.DataFrame([(set_id, stripe, i, d, zlib.crc32(d)) for i, d in shards.items()], columns=["set_id", "stripe", "shard", "data", "crc"])


def encode_parity(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """Shards (set_id, stripe, shard, data) with their parity shards and CRCs. A stripe holds up to 255 pieces of one size and is one group.

    Long shards are cut into stripes, so that a group stays small whatever the archive's size. A shard that is absent counts as zeros.
    """
    matrix = encoding_matrix(data, parity)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = max(map(len, rows["data"]))
        block = np.zeros((data, size), np.uint8)
        for i, d in zip(rows["shard"], rows["data"], strict=True):
            block[i, : len(d)] = np.frombuffer(d, np.uint8)
        extra = gf_matmul(matrix[data:], block)
        return _rows(*key, {i: x.tobytes() for i, x in enumerate([*block, *extra])})

    return shards.select("set_id", "stripe", "shard", "data").groupBy("set_id", "stripe").applyInPandas(run, SHARDS)


def repair(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """All shards of each stripe again, with state: kept, repaired, or lost where too few are whole. A wrong CRC makes a shard an erasure."""
    matrix = encoding_matrix(data, parity)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good = {int(i): d for i, d, c in zip(rows["shard"], rows["data"], rows["crc"], strict=True) if d is not None and zlib.crc32(d) == c}
        out = dict(good)
        if len(good) >= data and len(good) < data + parity:
            use = sorted(good)[:data]
            block = np.stack([np.frombuffer(good[i], np.uint8) for i in use])
            gone = [i for i in range(data + parity) if i not in good]
            whole = gf_matmul(matrix[gone], gf_matmul(gf_inverse(matrix[use]), block))
            out |= {i: x.tobytes() for i, x in zip(gone, whole, strict=True)}
        table = _rows(*key, dict(sorted(out.items())))
        table["state"] = ["kept" if i in good else "repaired" for i in table["shard"]]
        lost = [(*key, i, None, None, "lost") for i in range(data + parity) if i not in out]
        return pd.DataFrame([*table.itertuples(index=False, name=None), *lost], columns=[*table.columns]).astype({"crc": "Int64"})

    return shards.select("set_id", "stripe", "shard", "data", "crc").groupBy("set_id", "stripe").applyInPandas(run, SHARDS + ", state string")
