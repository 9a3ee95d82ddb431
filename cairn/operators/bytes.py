"""Byte statistics and parity, without one row for each byte where it can be helped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_counts(content: DataFrame, key: str, data: str, order: int = 0) -> DataFrame:
    """(key, prev, b, n): how often byte b follows prev (0 for the first byte; always 0 at order 0), counted in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, codes, counts = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(x.as_py() or b"", np.uint8).astype(np.int64)
                if order:
                    raw = raw + 256 * np.concatenate([[0], raw[:-1]])[: len(raw)]
                code, n = np.unique(raw, return_counts=True)
                keys += [k] * len(code)
                codes.append(code)
                counts.append(n)
            code = np.concatenate([*codes, np.zeros(0, np.int64)])
            n = np.concatenate([*counts, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array((code // 256).astype(np.int32)), pa.array((code % 256).astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "prev", "b", "n"]
            )

    kind = content.schema[key].dataType.simpleString()
    rows = content.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"key {kind}, prev int, b int, n long")
    return rows.groupBy(F.col("key").alias(key), "prev", "b").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, key: str) -> DataFrame:
    """Bits a byte given its context: order 0 or 1, as the counts are; nothing counts as 0."""
    context = counts.groupBy(key, "prev").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.sum(F.col("m") * F.log2("m") - F.col("s")) / F.sum("m")
    return context.groupBy(key).agg(F.abs(F.round(bits, 6)).alias("bits"), F.sum("m").alias("n_bytes"))


def byte_lanes(content: DataFrame, key: str, data: str) -> DataFrame:
    """(key, pos, lane): for each byte (from 1) of each row, the top three bits of the byte before it, 0 for the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                raw = np.frombuffer(x.as_py() or b"", np.uint8)
                if n := len(raw):
                    keys = batch.column(0).take(pa.array(np.full(n, i)))
                    lane = np.concatenate([[0], raw[:-1] >> 5]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(lane)], names=[key, "pos", "lane"])

    kind = content.schema[key].dataType.simpleString()
    return content.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, f"{key} {kind}, pos int, lane int")


def gf_tables() -> tuple[list[int], list[int]]:
    """Powers and logarithms of 2 in GF(2^8) modulo 0x11D."""
    exp, log, x = [], [0] * 256, 1
    for i in range(255):
        exp.append(x)
        log[x] = i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    return exp, log


def gf_mul(a, b):
    exp, log = gf_tables()
    lit = lambda t: F.array(*[F.lit(x) for x in t])
    e = F.get(lit(exp), (F.get(lit(log), a) + F.get(lit(log), b)) % 255)
    return F.when((a == 0) | (b == 0), 0).otherwise(e)


def parity(shards: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Parity bytes: XOR over shards (shard, pos, b) of coefficient (row, shard, c) times byte."""
    both = shards.join(F.broadcast(coefficients), "shard")  # at most 255 x 255 coefficients
    return both.groupBy("row", "pos").agg(F.bit_xor(gf_mul(F.col("c"), F.col("b"))).alias("parity"))
