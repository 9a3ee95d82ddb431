"""Byte, benchmark and progress queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import scalars as S
from cairn.operators import benchstats as B
from cairn.operators import bytes as Y
from cairn.plans import query
from cairn.streaming import progress as P


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BYTES = "x as (select item_id, unnest(range(1, length(h) // 2 + 1)) as pos, h from (select item_id, hex(encode(text)) as h from benchmark)), y as (select item_id, pos, ('0x' || substr(h, 2 * pos - 1, 2))::int as b from x)"


@query(f"with {_BYTES} select item_id, b, count(*) as n from y group by all")
def byte_histogram(spark, sf_dir):
    return Y.byte_counts(_read(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "b", "n")


@query(f"with {_BYTES}, c as (select item_id, b, count(*) as n from y group by all), t as (select item_id, sum(n) as m from c group by all) select item_id, round(-sum(n / m * log2(n / m)), 6) as bits, max(m)::bigint as n_bytes from c join t using (item_id) group by item_id")
def byte_entropy_order0(spark, sf_dir):
    return Y.entropy(Y.byte_counts(_read(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id")


@query(f"with {_BYTES}, z as (select item_id, b, coalesce(lag(b) over (partition by item_id order by pos), 0) as prev from y), c as (select item_id, prev, b, count(*) as n from z group by all), t as (select item_id, prev, sum(n) as m from c group by all), r as (select item_id, sum(m) as total from t group by all) select item_id, abs(round(sum(-n * log2(n / m)) / max(total), 6)) as bits, max(total)::bigint as n_bytes from c join t using (item_id, prev) join r using (item_id) group by item_id")
def byte_entropy_order1(spark, sf_dir):
    return Y.entropy(Y.byte_counts(_read(spark, sf_dir, "benchmark"), "item_id", "text", order=1), "item_id")


@query("select item_id, sha256(text) as digest, octet_length(encode(text))::bigint as size from benchmark")
def content_digest(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query()
def content_crc32(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", S.crc_text(F.crc32(F.col("text").cast("binary"))).alias("crc"))


@query()
def document_byte_histogram(spark, sf_dir):
    return Y.byte_counts(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "b", "n")


@query()
def document_byte_entropy_order0(spark, sf_dir):
    return Y.entropy(Y.byte_counts(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query()
def document_byte_entropy_order1(spark, sf_dir):
    return Y.entropy(Y.byte_counts(_read(spark, sf_dir, "documents"), "doc_id", "text", order=1), "doc_id")


@query("select doc_id, sha256(text) as digest, octet_length(encode(text))::bigint as size from documents")
def document_content_digest(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query()
def document_content_crc32(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", S.crc_text(F.crc32(F.col("text").cast("binary"))).alias("crc"))


@query("""with s as (select l_orderkey as pos, min(l_quantity)::int as b0, max(l_quantity)::int as b1 from lineitem group by 1) select pos, 0 as "row", xor(b0, b1) as parity from s""")
def parity_xor_row(spark, sf_dir):
    s = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.min("l_quantity").cast("int").alias("b0"), F.max("l_quantity").cast("int").alias("b1"))
    shards = s.select("pos", F.posexplode(F.array("b0", "b1")).alias("shard", "b"))
    ones = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "row int, shard int, c int")
    return Y.parity(shards, ones)


_PASSES = "p as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(l_quantity)::bigint as bytes, round(sum(l_tax) + 0.01, 4) as wall from lineitem group by all)"
_ROLL = f"""with {_PASSES}, r as (select *, case when wall > 0 then bytes / wall end as speed from p), s as (
select l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(bytes) over w as bytes, round(sum(wall) over w, 4) as wall, round(coalesce(stddev_samp(speed) over w / avg(speed) over w * 100, 0), 4) as variation,
row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as pass from r window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey rows between 7 preceding and current row))"""


def passes(spark, sf_dir):
    keys = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    return _read(spark, sf_dir, "lineitem").groupBy(keys).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.round(F.sum("l_tax") + 0.01, 4).alias("wall"))


@query(_ROLL + " select l_suppkey, l_orderkey, l_linenumber, l_partkey, bytes::bigint as bytes, pass::int as pass, case when pass < 5 then 'warming up' when variation <= 2.0 then 'stable' else 'variable' end as stability from s")
def bench_rolling(spark, sf_dir):
    return B.rolling(passes(spark, sf_dir), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).drop("wall", "variation")


@query(f"with {_PASSES} select l_suppkey, min(wall) as best, round(median(wall), 6) as median, count(distinct bytes) = 1 as agree from p group by 1")
def bench_best_and_median(spark, sf_dir):
    return B.best_of(passes(spark, sf_dir), ["l_suppkey"])


@query(f"with {_PASSES}, h as (select l_suppkey, l_linenumber % 2 as half, round(median(wall), 6) as m from p group by 1, 2) select l_suppkey, a.m as before, b.m as after, round((b.m / a.m - 1) * 100, 4) as delta from h a join h b using (l_suppkey) where a.half = 0 and b.half = 1")
def bench_delta(spark, sf_dir):
    half = lambda k: B.best_of(passes(spark, sf_dir).where(F.col("l_linenumber") % 2 == k), ["l_suppkey"])
    return B.compare(half(0), half(1), ["l_suppkey"])


_EV = """f as (select *, coalesce(value < lag(value) over (partition by user_id order by ts), false)::int as fall from events),
g as (select *, sum(fall) over (partition by user_id order by ts rows unbounded preceding) as epoch from f)"""


def _epochs(spark, sf_dir):
    return P.epochs(_read(spark, sf_dir, "events"), "user_id", "ts", "value")


@query(f"with {_EV} select event_id, epoch::bigint as epoch, max(value) over (partition by user_id, epoch order by ts rows unbounded preceding) as high from g")
def progress_high_water(spark, sf_dir):
    return P.high_water(_epochs(spark, sf_dir), "user_id", "ts", "value").select("event_id", "epoch", "high")


@query(f"""with {_EV}, h as (select *, epoch_us(ts) as t from g), r as (select event_id, t, value, min(t) over w as t0, arg_min(value, t) over w as v0 from h
window w as (partition by user_id, epoch order by t range between 86400000000 preceding and current row))
select event_id, case when t > t0 then round((value - v0) / ((t - t0) / 1e6), 6) end as rate from r""")
def progress_sliding_rate(spark, sf_dir):
    return P.sliding_rate(_epochs(spark, sf_dir), "user_id", "ts", "value", 86_400).select("event_id", "rate")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def progress_latest(spark, sf_dir):
    return P.latest(_read(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"])


_WORDS = "w as (select l_suppkey as src, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos, (l_extendedprice::bigint % 256) as b from lineitem)"


def _words(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.row_number().over(order).alias("pos"), (F.floor("l_extendedprice") % 256).alias("b"))


@query(f"with {_WORDS.replace('l_extendedprice::bigint', 'floor(l_extendedprice)::bigint')} select src, pos::int as pos, ((b - coalesce(lag(b, 4) over (partition by src order by pos), 0)) % 256 + 256) % 256 as d from w")
def transform_stride_delta(spark, sf_dir):
    w = Window.partitionBy("src").orderBy("pos")
    return _words(spark, sf_dir).select("src", "pos", F.pmod(F.col("b") - F.lag("b", 4, 0).over(w), F.lit(256)).alias("d"))


@query(f"with {_WORDS.replace('l_extendedprice::bigint', 'floor(l_extendedprice)::bigint')} select src, pos::int as pos, b from w")
def transform_stride_delta_inverse(spark, sf_dir):
    w = Window.partitionBy("src", F.col("pos") % 4).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = transform_stride_delta(spark, sf_dir)
    return d.select("src", "pos", F.pmod(F.sum("d").over(w), F.lit(256)).alias("b"))


@query("select event_id, props->>'k' as k from events")
def json_property(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select user_id, max(ts) as last_seen from events group by 1 order by 2 desc, 1 limit 20")
def recent_unique(spark, sf_dir):
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return e.orderBy(F.desc("last_seen"), "user_id").limit(20)
