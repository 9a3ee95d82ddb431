"""Byte streams: block plans, checksums of joined parts, sampled entropy, ranges of byte filters and the options of the levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import scalars as S
from cairn.operators import bytes as Y
from cairn.operators.running import running_before

#: The CRC-32 polynomial, lowest power first.
CRC_POLY = 0xEDB88320
#: Parts of a stream that share a bucket of the running total.
PART_BUCKET = 65536


def uniform_blocks(streams: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """(key, block_no, offset, size): every stream cut at multiples of block. Empty and null sizes have no block."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(block).cast("long")))
    cut = streams.where(F.col(size) > 0).select(F.col(key), F.col(size).alias("_all"), starts.alias("offset"))
    return cut.select(key, (F.col("offset") / block).cast("long").alias("block_no"), "offset", F.least(F.lit(block), F.col("_all") - F.col("offset")).alias("size"))


def crc_times(a, b):
    """Product of polynomials over GF(2) modulo that of CRC-32; arrays of 32-bit numbers, lowest power in the top bit."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    out = np.zeros(a.shape, np.uint64)
    for i in range(32):
        out ^= np.where((a >> np.uint64(31 - i)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(CRC_POLY), np.uint64(0))
    return out


def crc_past(crc, after):
    """What a CRC-32 gives to that of a text with so many bytes after it: the CRC times x^(8 * after)."""
    crc, after = np.array(crc, np.uint64), np.asarray(after, np.uint64)
    power = np.uint64(1 << 23)  # x^8
    for k in range(int(after.max(initial=0)).bit_length()):
        on = (after >> np.uint64(k)) & np.uint64(1) == 1
        crc[on] = crc_times(power, crc[on])
        power = crc_times(power, power)[()]
    return crc


def crc_combine(parts: DataFrame, keys: list[str], order: str, crc: str, size: str) -> DataFrame:
    """(keys, crc, size) of the streams whose parts, in order (a whole number, unique in its keys), have these CRC-32 values and sizes.

    A CRC is linear, so every part is moved past the bytes after it on its own and the results meet in an XOR, which merges in any order
    and before the shuffle. The bytes after a part are a running total over buckets. Null parts count as empty.
    """

    @F.pandas_udf("long")
    def moved(c: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_past(c.to_numpy(), after.to_numpy()).astype(np.int64))

    zero = F.lit(0).cast("long")
    rows = parts.select(*keys, (-F.col(order).cast("long")).alias("_back"), F.coalesce(crc, zero).alias("_crc"), F.coalesce(F.col(size).cast("long"), zero).alias("_size"))
    rows = running_before(rows, keys, "_back", F.col("_size"), F.floor(F.col("_back") / PART_BUCKET), "_after")
    return rows.groupBy(*keys).agg(F.bit_xor(moved("_crc", "_after")).alias("crc"), F.sum("_size").alias("size"))


def sample_bytes(data: Column, chunk: int = 1 << 16, count: int = 4) -> Column:
    """count pieces of chunk bytes, spread evenly from the first byte to the last; shorter data whole."""
    size = F.octet_length(data).cast("long")
    at = [F.floor((size - chunk) * k / (count - 1)).cast("int") + 1 for k in range(count)]
    return F.when(size <= chunk * count, data).otherwise(F.concat(*[F.substring(data, p, F.lit(chunk)) for p in at]))


def sampled_entropy(content: DataFrame, key: str, data: str, chunk: int = 1 << 16, count: int = 4) -> DataFrame:
    """Order-1 entropy of the sample of each row: the sample is what the method measures, whatever the length."""
    sample = content.select(key, sample_bytes(F.col(data).cast("binary"), chunk, count).alias("_sample"))
    return Y.entropy(Y.byte_counts(sample, key, "_sample", order=1), key)


def screen_entropy(content: DataFrame, key: str, data: str) -> DataFrame:
    """Order-0 entropy by which filters are screened; 8 bits, the worst, for rows without bytes. key is unique."""
    bits = Y.entropy(Y.byte_counts(content, key, data), key).select(key, "bits")
    return content.select(key).join(bits, key, "left").select(key, F.coalesce("bits", F.lit(8.0)).alias("bits"))


def stream_lower_bound(bits: Column, size: Column) -> Column:
    """Least bytes of a coded stream: its payload at so many bits a byte, both lengths as varints and a byte for the coder."""
    payload = bits * size / 8.0
    return S.varint_size(size) + 1 + S.varint_size(F.floor(payload)) + payload


# The least size of a filtered range, the greatest stride, the row exponents of the 16-bit predictor (0: left neighbour).
LEAST_RANGE, MOST_STRIDE, EXPONENTS = 4096, 64, (0, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def range_violations(ranges: DataFrame, key: str) -> DataFrame:
    """(key, offset, rule) for ranges (key, offset, size, kind, parameter, total) of byte filters that may not be applied.

    Ranges of kind none and short ones are passed over. total is the size of the stream. Overlaps are looked for along the
    ranges of one stream, which are few (each has LEAST_RANGE bytes or more of it).
    """
    used = ranges.where((F.col("kind") != "none") & (F.col("size") >= LEAST_RANGE)).withColumn("_end", F.col("offset") + F.col("size"))
    before = Window.partitionBy(key).orderBy("offset", "size", "parameter").rowsBetween(Window.unboundedPreceding, -1)
    kind, p = F.col("kind"), F.col("parameter")
    rules = [
        (F.col("_end") > F.col("total"), "beyond the end"),
        (~kind.isin("branch", "delta", "word16"), "unknown filter"),
        ((kind == "branch") & (p != 0) | (kind == "delta") & ~p.between(1, MOST_STRIDE) | (kind == "word16") & ~p.isin(*EXPONENTS), "parameter"),
        (F.col("offset") < F.max("_end").over(before), "overlap"),
    ]
    found = used.select(key, "offset", F.array(*[F.when(c, F.lit(r)) for c, r in rules]).alias("_rules"))
    return found.select(key, "offset", F.explode(F.array_compact("_rules")).alias("rule"))


# For each level its search depth, good length, block and window size in MiB, longest match, and whether it matches lazily.
LEVELS = [
    (1, 8, 64, 4, 1, 273, False), (2, 16, 64, 4, 1, 273, True), (3, 32, 128, 4, 1, 273, True), (4, 64, 128, 4, 1, 273, True), (5, 128, 128, 4, 1, 273, True),
    (6, 256, 192, 4, 1, 273, True), (7, 128, 128, 8, 8, 273, True), (8, 128, 128, 32, 32, 273, False), (9, 512, 128, 64, 64, 4096, False),
]


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, depth int, good_length int, block_mib int, window_mib int, longest int, lazy boolean")


def with_level(rows: DataFrame, level: str) -> DataFrame:
    """Adds the options of each row's level, which is taken into 1 to 9."""
    clamped = F.greatest(F.lit(1), F.least(F.lit(9), F.col(level).cast("int")))
    return rows.withColumn(level, clamped).join(F.broadcast(levels(rows.sparkSession).withColumnRenamed("level", level)), level)  # nine rows
