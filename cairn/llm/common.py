"""Shared helpers: table access, scratch tables in the shared folder, size-checked joins and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column table of longs may be broadcast (16 MB raw); past it the join shuffles.
BROADCAST_ROWS = 500_000

#: Blocks of 4,096 ids up to which their bits may be broadcast (0.6 kB each); past it the join shuffles.
BROADCAST_BLOCKS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(name: str) -> str:
    """A column name as one identifier, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where none is set, one is set here for a local session (tests); on a cluster that raises, since a machine-local folder would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file:///tmp/checkpoints/cairn-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


#: Folders of all operator runs of this process.
_roots: set[str] = set()


def sweep(spark: SparkSession) -> int:
    """Deletes the intermediate tables, archives and token files of all operator runs so far; call it when their results have been written."""
    n = len(_roots)
    while _roots:
        delete(spark, _roots.pop())
    return n


class Scratch:
    """Intermediate tables of one operator run, written as Parquet in the shared folder.

    A written table cuts lineage: a lost executor costs a re-read, not a recomputation of the stages before.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _roots.add(self.root)
        self.n = 0
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._cairn_scratch = self  # keeps id() unique while the table is known
        return back

    def free(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.paths.pop(id(df), None)
        if path:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast when its counted rows prove it small; otherwise leaves the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def marked(df: DataFrame, ids: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """df with a boolean column of that name: whether its id is in ids (id, distinct). For ids counted up from a few starts, as monotonically_increasing_id gives them.

    The ids are broadcast as one bit each in blocks of 64 words, so that wide rows of df stay where they are.
    """
    bits = ids.groupBy(F.expr("shiftright(id, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(id & 63 as int)))").alias("bits"))
    found = bits.groupBy(F.expr("shiftright(word, 6)").alias("_block")).agg(F.map_from_entries(F.collect_list(F.expr("struct(cast(word & 63 as int), bits)"))).alias("_bits"))
    found = scratch.cut(found.select("_block", F.expr("transform(sequence(0, 63), i -> coalesce(_bits[i], 0L))").alias("_bits")))
    if found.count() > BROADCAST_BLOCKS:
        return df.join(ids.withColumn("_found", F.lit(True)), "id", "left").select(*df.columns, F.coalesce("_found", F.lit(False)).alias(name))
    both = df.withColumn("_block", F.expr("shiftright(id, 12)")).join(F.broadcast(found), "_block", "left")
    hit = F.expr("shiftright(get(_bits, cast(shiftright(id, 6) & 63 as int)), cast(id & 63 as int)) & 1 = 1")
    return both.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in edges (src, dst); component is the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two
    partial aggregations and two joins over the edge list, nothing is collected but a checksum.
    Nulls and self-loops in edges are ignored.
    """
    state = scratch.cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low2, "u")
        nxt = scratch.cut(
            star.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        scratch.free(state)
        state = nxt
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    label = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = label.select(F.col("component").alias("id"), "component").distinct()
    return label.unionByName(roots)


def skew_left_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Column, spread: list[str]) -> DataFrame:
    """left LEFT JOIN right on keys (unique in right), where a few keys may hold much of left.

    Right rows for which hot holds are broadcast when their count proves them small; left rows they match are spread over all
    partitions by a hash of the spread columns in the shuffled join with the rest. right must be a written table: it is read three times.
    """
    values = [c for c in right.columns if c not in keys]
    top = right.where(hot)
    if not 0 < (n := top.count()) <= BROADCAST_ROWS:
        return left.join(right, keys, "left")
    first = left.join(F.broadcast(top.select(*keys, F.struct(*values).alias("_hot"))), keys, "left")
    found = F.col("_hot").isNotNull()
    first = first.withColumn("_k0", F.when(found, F.xxhash64(*spread)).otherwise(F.xxhash64(*keys)))
    for i, k in enumerate(keys):
        first = first.withColumn(f"_key{i}", F.when(~found, F.col(k)))
    rest = right.where(~F.coalesce(hot, F.lit(False))).select(
        F.xxhash64(*keys).alias("_k0"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_cold")
    )
    both = first.join(rest, ["_k0", *[f"_key{i}" for i in range(len(keys))]], "left")
    pick = F.coalesce("_hot", "_cold")
    return both.select(*left.columns, *[pick[v].alias(v) for v in values])
