"""Benchmark statistics: rolling windows, best runs, medians and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling(passes: DataFrame, key: str, order: list[str], last: int = 8) -> DataFrame:
    """Totals, throughput, coefficient of variation and a stability label over the last passes of each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    speed = F.when(F.col("wall") > 0, F.col("bytes") / F.col("wall"))
    cv = F.coalesce(F.stddev_samp(speed).over(w) / F.avg(speed).over(w) * 100, F.lit(0.0))
    out = passes.select(key, *order, F.sum("bytes").over(w).alias("bytes"), F.round(F.sum("wall").over(w), 4).alias("wall"), F.round(cv, 4).alias("variation"), n.alias("pass"))
    label = F.when(F.col("pass") < 5, "warming up").when(F.col("variation") <= 2.0, "stable").otherwise("variable")
    return out.withColumn("stability", label)


def best_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(keys).agg(F.min("wall").alias("best"), F.round(F.median("wall"), 6).alias("median"), (F.countDistinct("bytes") == 1).alias("agree"))


def compare(base: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    b, c = base.withColumnRenamed("median", "before").select(*keys, "before"), now.withColumnRenamed("median", "after").select(*keys, "after")
    return b.join(c, keys).withColumn("delta", F.round((F.col("after") / F.col("before") - 1) * 100, 4))


def gap_report(base: DataFrame, now: DataFrame, key: str, size: str) -> DataFrame:
    """key, base, now, delta, percent for each member of both, and a row TOTAL over them."""
    both = base.select(F.col(key).cast("string").alias(key), F.col(size).alias("base")).join(now.select(F.col(key).cast("string").alias(key), F.col(size).alias("now")), key)
    total = both.agg(F.lit("TOTAL").alias(key), F.sum("base").alias("base"), F.sum("now").alias("now"))
    delta = F.col("now") - F.col("base")
    out = both.unionByName(total).withColumn("delta", delta)
    return out.withColumn("percent", F.when(F.col("base") != 0, 100.0 * F.col("delta") / F.col("base")))


def stream_share(streams: DataFrame, key: str, raw: str, coded: str) -> DataFrame:
    """Raw and coded bytes of each stream, bits per raw byte and the share of all coded bytes. A row per stream meets in the total, not the input."""
    sums = streams.groupBy(key).agg(F.sum(raw).alias("raw"), F.sum(coded).alias("coded"))
    total = sums.agg(F.sum("coded").alias("total"))
    bits = F.when(F.col("raw") > 0, 8.0 * F.col("coded") / F.col("raw"))
    return sums.join(F.broadcast(total)).select(key, "raw", "coded", bits.alias("bits"), F.when(F.col("total") > 0, F.col("coded") / F.col("total")).alias("share"))


def metric_rows(runs: DataFrame, keys: list[str], size: str, wall: str, cpu: str) -> DataFrame:
    """Totals of runs: bytes, KiB a second, CPU use (CPU over wall seconds), KiB a CPU second; null where no time passed."""
    sums = runs.groupBy(*keys).agg(F.sum(size).alias("bytes"), F.sum(wall).alias("wall"), F.sum(cpu).alias("cpu"))
    kib = F.col("bytes") / 1024.0
    speed, use, core = (F.when(F.col(b) > 0, a / F.col(b)) for a, b in ((kib, "wall"), (F.col("cpu"), "wall"), (kib, "cpu")))
    return sums.select(*keys, "bytes", speed.alias("kib_s"), use.alias("cpu_use"), core.alias("kib_core_s"))


def canonical_codes(lengths: DataFrame, key: str, symbol: str, length: str) -> DataFrame:
    """code of every symbol of a prefix code given by lengths (1 to 48): symbols in order of (length, symbol) take consecutive codes.

    A code is the sum of 2^-length over the symbols before, as a binary fraction of its own length, exact in a double. Codes of one
    table (key) are one group; an alphabet is small.
    """
    before = Window.partitionBy(key).orderBy(length, symbol).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col(length))).over(before), F.lit(0.0))
    return lengths.withColumn("code", (start * F.pow(F.lit(2.0), F.col(length))).cast("long"))
