"""Compression estimates from samples: regions, statistics, adaptive stop, overhead and confidence; context clusters and code frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import scalars as S
from cairn.operators.running import running_before

# Fixed values of the estimate.
BATCH = 8
LEAST_PROBES = 16
STABLE = 0.01
HIGH = 0.025
MEDIUM = 0.05

#: Characters of a path that form a bucket of the running total over paths.
PREFIX = 12


def sample_regions(files: DataFrame, budget: int, chunk: int) -> DataFrame:
    """(archive_id, ordinal, path, offset, size): what to probe of files (archive_id, path, size), in path order.

    An archive within the budget is read whole, in chunks. Of a larger one, budget / chunk points (a bound by parameters) spread by the
    radical inverse each give the chunk around them, clamped to its file; equal regions count once. Points meet files by the slice of
    the archive they lie in, an equi-join; no file meets more points than lie in its slices.
    """
    full = files.where("size > 0").select("archive_id", "path", "size")
    placed = running_before(full, ["archive_id"], "path", F.col("size"), F.left("path", F.lit(PREFIX)), "begin")
    total = full.groupBy("archive_id").agg(F.sum("size").alias("total"))
    whole = placed.join(total.where(F.col("total") <= budget), "archive_id")
    whole = whole.select("archive_id", (F.col("begin") * F.lit(1)).alias("at"), "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("offset"))
    whole = whole.select("archive_id", (F.col("at") + F.col("offset")).alias("ordinal"), "path", "offset", F.least(F.lit(chunk), F.col("size") - F.col("offset")).cast("long").alias("size"))
    count = max(1, -(-budget // chunk))
    big = total.where(F.col("total") > budget).withColumn("width", F.ceil(F.col("total") / count).cast("long"))
    points = big.select("archive_id", "total", "width", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long"))).alias("ordinal"))
    point = F.least(F.col("total") - 1, F.floor(S.radical_inverse(F.col("ordinal")) * F.col("total")))
    points = points.select("archive_id", "ordinal", point.alias("point"), F.floor(point / F.col("width")).alias("slice"))
    spans = placed.join(big, "archive_id").withColumn("end", F.col("begin") + F.col("size"))
    spans = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("begin") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width")))))
    hit = spans.join(points, ["archive_id", "slice"]).where("begin <= point and point < end")
    take = F.least(F.lit(chunk), F.col("size")).cast("long")
    local = F.col("point") - F.col("begin") - F.floor(take / 2)
    hit = hit.select("archive_id", "ordinal", "path", F.least(F.greatest(local, F.lit(0)), F.col("size") - take).alias("offset"), take.alias("size"))
    return whole.unionByName(hit.groupBy("archive_id", "path", "offset", "size").agg(F.min("ordinal").alias("ordinal")))


def _margin(weight, square, moment, second):
    """Mean, effective samples and margin from the sums of w, w w, w x and w x x."""
    mean = moment / weight
    deviation = F.sqrt(F.greatest(F.lit(0.0), second / weight - mean * mean))
    n = weight * weight / square
    return mean, n, F.when(n > 1, F.greatest(F.lit(0.015), 2.5 * deviation / F.sqrt(n))).otherwise(1.0)


def sample_statistics(probes: DataFrame, key: str) -> DataFrame:
    """mean, effective and margin of the packed ratio of probes (key, bytes, packed), weighted by bytes; margin is 1 below two effective samples."""
    p = probes.where("bytes > 0")
    w, x = F.col("bytes").cast("double"), F.col("packed") / F.col("bytes")
    sums = p.groupBy(key).agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean, n, margin = _margin(*map(F.col, ("w", "ww", "wx", "wxx")))
    return sums.select(key, F.round(mean, 6).alias("mean"), F.round(n, 4).alias("effective"), F.round(margin, 6).alias("margin"))


def least_sample(files: int | F.Column, source, chunk: int, budget: int):
    """Bytes that a sample needs: by tiers of size and of the number of files."""
    n = F.lit(4 << 20) + F.when(source >= 16 << 30, 8 << 20).when(source >= 1 << 30, 4 << 20).otherwise(0)
    n = n + F.when(files >= 100_000, 4 << 20).when(files >= 10_000, 2 << 20).otherwise(0)
    return F.when(source <= budget, source).otherwise(F.least(F.lit(budget), F.greatest(n, F.lit(LEAST_PROBES * chunk)))).cast("long")


def overhead(entries: DataFrame, block: int, zip_format: bool = False, sealed: bool = False) -> DataFrame:
    """archive_id, files, source_bytes, overhead: container bytes by items, path bytes and blocks."""
    e = entries.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("kind") == "file").alias("files"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("source_bytes"),
        F.coalesce(F.sum(F.when(F.col("kind") == "file", F.octet_length("path"))), F.lit(0)).alias("names"),
    )
    blocks = F.ceil(F.col("source_bytes") / block)
    base, item, name = (64, 110, 2) if zip_format else (96, 96, 1)
    cost = base + F.col("items") * item + F.col("names") * name + blocks * 48 + ((128 + blocks * 40) if sealed else 0)
    return e.select("archive_id", "files", "source_bytes", cost.cast("long").alias("overhead"))


def estimate(archives: DataFrame, probes: DataFrame, chunk: int, budget: int, recovery: int = 0, volume: int = 0) -> DataFrame:
    """One row for each archive (archive_id, files, source_bytes, overhead) from its probes (archive_id, ordinal, bytes, packed).

    Probes count in their order up to the first batch of eight that is representative (16 probes and enough bytes), stable (its mean moved by
    0.01 or less) and within a margin of 0.025. Time budgets do not exist here, so that results repeat. estimated, low and high are bytes;
    confidence is high, medium or low. A source without bytes costs its overhead; one without probes counts as stored.
    """
    w = Window.partitionBy("archive_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    b, x = F.col("bytes").cast("double"), F.col("packed") / F.col("bytes")
    p = probes.where("bytes > 0").join(archives, "archive_id")
    p = p.select(
        "archive_id", "ordinal", F.count(F.lit(1)).over(w).alias("n"), F.sum("bytes").over(w).alias("sampled"), F.sum("packed").over(w).alias("packed"),
        F.sum(b).over(w).alias("w"), F.sum(b * b).over(w).alias("ww"), F.sum(b * x).over(w).alias("wx"), F.sum(b * x * x).over(w).alias("wxx"),
        least_sample(F.col("files"), F.col("source_bytes"), chunk, budget).alias("least"),
    )
    mean, _, margin = _margin(*map(F.col, ("w", "ww", "wx", "wxx")))
    p = p.withColumn("mean", mean).withColumn("margin", margin)
    by = Window.partitionBy("archive_id").orderBy("n")
    before = F.lag("mean", BATCH).over(by)
    p = p.withColumn("stable", (F.col("n") % BATCH == 0) & (F.col("n") > BATCH) & (F.abs(F.col("mean") - before) <= STABLE))
    p = p.withColumn("good", F.coalesce("stable", F.lit(False)) & (F.col("n") >= LEAST_PROBES) & (F.col("sampled") >= F.col("least")) & (F.col("margin") <= HIGH))
    #: whether the last full batch was stable
    p = p.withColumn("steady", F.last(F.when(F.col("n") % BATCH == 0, F.coalesce("stable", F.lit(False))), ignorenulls=True).over(by))
    stop = F.coalesce(F.min(F.when(F.col("good"), F.col("n"))), F.max("n"))
    cut = p.groupBy("archive_id").agg(stop.alias("n"))
    last = p.join(cut, ["archive_id", "n"]).select("archive_id", "n", "sampled", "packed", "margin", "least", F.coalesce("steady", F.lit(False)).alias("steady"))
    e = archives.join(last, "archive_id", "left")
    source, sampled = F.col("source_bytes"), F.coalesce("sampled", F.lit(0))
    payload = F.floor(F.col("packed") / F.col("sampled") * source + 0.5)
    plain = F.when(source == 0, F.col("overhead")).when(sampled == 0, source + F.col("overhead")).otherwise(payload + F.col("overhead")).cast("long")
    e = e.withColumn("_plain", plain).withColumn("_real", (source > 0) & (sampled > 0))
    e = e.withColumn("estimated", F.when(F.col("_real"), F.col("_plain") + F.floor(F.col("_plain") * recovery / 100 + 0.5)).otherwise(F.col("_plain")).cast("long"))
    full = sampled / source >= 0.999
    spread = F.when(full, 0.08).otherwise(F.greatest(F.lit(0.03), F.least(F.lit(0.35), F.col("margin") * source / F.col("estimated"))))
    bound = lambda s: F.floor(F.col("estimated") * (1 + s * spread) + 0.5)
    strong = full | ((F.col("n") >= LEAST_PROBES) & (F.col("sampled") >= F.col("least")) & F.col("steady") & (F.col("margin") <= HIGH))
    confidence = F.when(source == 0, "high").when(sampled == 0, "low").when(strong, "high").when((F.col("n") >= BATCH) & (F.col("margin") <= MEDIUM), "medium").otherwise("low")
    volumes = F.when(F.col("estimated") > 0, F.ceil(F.col("estimated") / volume)).otherwise(0) if volume else F.lit(0)
    return e.select(
        "archive_id", F.coalesce("n", F.lit(0)).cast("long").alias("probes"), sampled.cast("long").alias("sampled"), "estimated",
        F.when(F.col("_real"), bound(-1)).otherwise(F.col("overhead")).cast("long").alias("low"), F.when(F.col("_real"), bound(1)).otherwise(F.col("estimated")).cast("long").alias("high"),
        confidence.alias("confidence"), volumes.cast("long").alias("volumes"),
    )


def normalise(counts: DataFrame, key: str, target: int = 4096) -> DataFrame:
    """freq of counts (key, symbol, n) so that each key sums to target, 1 at least: a lack goes to the commonest symbol, an excess comes off
    the largest frequency, one at a time; the smaller symbol wins ties. A key holds one alphabet (256 symbols)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("symbol", ignore_index=True)
        total = int(rows["n"].sum())
        freq = [max(1, int(n) * target // total) for n in rows["n"]]
        over = sum(freq) - target
        while over > 0 and max(freq) > 1:
            freq[freq.index(max(freq))] -= 1
            over -= 1
        if over < 0:
            freq[int(rows["n"].to_numpy().argmax())] -= over
        return rows.assign(freq=freq)

    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in (key, "symbol", "n"))
    return counts.where("n > 0").select(key, "symbol", "n").groupBy(key).applyInPandas(run, f"{kinds}, freq long")


def cluster_contexts(counts: DataFrame, k: int = 16, passes: int = 3) -> DataFrame:
    """(ctx, cluster) for counts (ctx, symbol, n): the k heaviest contexts seed the clusters, then contexts move to the cluster that codes
    them in the fewest bits (+1 smoothed, 256 symbols); the lower cluster wins ties. Contexts and symbols are bytes, so all tables are bounded."""
    heavy = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    seeds = heavy.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("total"), "ctx")) - 1).where(F.col("cluster") < k)
    member = seeds.select("ctx", "cluster")
    for _ in range(passes):
        code = counts.join(member, "ctx").groupBy("cluster", "symbol").agg(F.sum("n").alias("m"))
        size = code.groupBy("cluster").agg(F.sum("m").alias("all"))
        ids = size.agg(F.collect_list(F.struct("cluster", "all")).alias("ids"))  # k at most
        wide = counts.join(F.broadcast(ids)).select("ctx", "symbol", "n", F.explode("ids").alias("c")).select("ctx", "symbol", "n", "c.*")
        bits = F.sum(F.col("n") * (F.log2(F.col("all") + 256) - F.log2(F.coalesce("m", F.lit(0)) + 1)))
        cost = wide.join(code, ["cluster", "symbol"], "left").groupBy("ctx", "cluster").agg(F.round(bits, 6).alias("bits"))
        member = cost.groupBy("ctx").agg(F.min(F.struct("bits", "cluster"))["cluster"].alias("cluster"))
    return member


def symbol_costs(counts: DataFrame, key: str, alphabet: int) -> DataFrame:
    """Cost in sixteenths of a bit of each symbol seen (key, symbol, n), +1 smoothed."""
    w = Window.partitionBy(key)
    return counts.withColumn("cost", F.round(-F.log2((F.col("n") + 1) / (F.sum("n").over(w) + alphabet)) * 16).cast("long"))


def nearest_match(text: DataFrame, key: str, column: str, width: int = 4, window: int = 65536) -> DataFrame:
    """(key, pos, distance): for each position (from 0), how far back the nearest equal run of width characters lies, within the window."""
    at = F.explode(F.sequence(F.lit(0), F.length(column) - width))
    rows = text.where(F.length(column) >= width).select(key, column, at.alias("pos")).select(key, "pos", F.substring(column, F.col("pos") + 1, F.lit(width)).alias("gram"))
    back = F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))
    return rows.withColumn("distance", back).where(F.col("distance") <= window).select(key, "pos", "distance")


def nearest_match_whole(text: DataFrame, key: str, column: str, width: int = 4, window: int = 65536) -> DataFrame:
    """nearest_match, each row's text searched as a whole in Arrow batches: nothing is shuffled, and rows that repeat a key stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                c = np.frombuffer((x.as_py() or "").encode("utf-32-le"), np.uint32)
                n = len(c) - width + 1
                if n < 2:
                    continue
                gram = np.zeros(n, np.int64)
                for k in range(width):
                    gram = np.unique(gram * 0x110000 + c[k : k + n], return_inverse=True)[1]
                order = np.argsort(gram, kind="stable")
                same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
                pos, back = order[same + 1], order[same + 1] - order[same]
                pos, back = pos[back <= window], back[back <= window]
                keys = batch.column(0).take(pa.array(np.full(len(pos), i)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int32))], names=[key, "pos", "distance"])

    kind = text.schema[key].dataType.simpleString()
    return text.select(key, column).mapInArrow(run, f"{key} {kind}, pos int, distance int")
