"""Estimator, codec, volume and constraint queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import scalars as S
from cairn.operators import bytes as Y
from cairn.operators import catalog as C
from cairn.operators import codec as K
from cairn.operators import estimate as M
from cairn.operators import volumes as V
from cairn.plans import query
from cairn.plans.catalog_queries import E_SQL, entries

BUDGET, CHUNK = 262_144, 4096


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""with {E_SQL}, f as (select archive_id, path, size, coalesce(sum(size) over (partition by archive_id order by path rows between unbounded preceding and 1 preceding), 0)::bigint as start from e where size > 0),
t as (select archive_id, sum(size)::bigint as total from f group by 1), b as (select * from t where total > {BUDGET}),
w as (select archive_id, path, size, start, unnest(range(0, size, {CHUNK})) as off from f join t using (archive_id) where total <= {BUDGET}),
i as (select archive_id, total, unnest(range(1, {BUDGET // CHUNK} + 1)) as i from b),
g as (select archive_id, i, least(total - 1, floor(list_sum(list_transform(range(0, 8), lambda k: ((i >> k) & 1) / pow(2, k + 1))) * total))::bigint as point from i),
h as (select archive_id, i, path, least(size, {CHUNK}) as take, size, point - start as loc from g join f using (archive_id) where start <= point and point < start + size),
r as (select archive_id, path, least(greatest(loc - take // 2, 0), size - take)::bigint as off, take, min(i) as i from h group by all)
select archive_id, (start + off)::bigint as ordinal, path, off::bigint as "offset", least({CHUNK}, size - off)::bigint as size from w union all select archive_id, i::bigint, path, off, take::bigint from r""")
def sample_plan(spark, sf_dir):
    return M.sample_regions(entries(spark, sf_dir), BUDGET, CHUNK)


_PROBES = """p as (select l_suppkey as archive_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as ordinal,
  (l_quantity * 1024)::bigint as bytes, floor((l_quantity * 1024)::bigint * (0.3 + l_discount::double))::bigint as packed from lineitem)"""


def probes(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = (F.col("l_quantity") * 1024).cast("long")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("archive_id"), F.row_number().over(order).cast("long").alias("ordinal"), n.alias("bytes"), F.floor(n * (F.lit(0.3) + F.col("l_discount").cast("double"))).cast("long").alias("packed"))


@query(f"""with {_PROBES}, x as (select archive_id, bytes::double as w, packed / bytes as x from p), m as (select archive_id, sum(w * x) / sum(w) as mean from x group by 1),
s as (select archive_id, any_value(mean) as mean, sum(w) * sum(w) / sum(w * w) as n, sqrt(sum(w * (x - mean) * (x - mean)) / sum(w)) as dev from x join m using (archive_id) group by 1)
select archive_id, round(mean, 6) as mean, round(n, 4) as effective, round(case when n > 1 then greatest(0.015, 2.5 * dev / sqrt(n)) else 1 end, 6) as margin from s""")
def sample_statistics(spark, sf_dir):
    return M.sample_statistics(probes(spark, sf_dir), "archive_id")


_ESTIMATE = f"""with {_PROBES}, a as (select archive_id, count(*) as files, sum(bytes)::bigint * 4 as source, 96 + count(*) * 120 as overhead from p group by 1),
r as (select archive_id, files, source, overhead, count(*) over w as n, sum(bytes) over w as sampled, sum(packed) over w as packed, sum(bytes::double) over w as w, sum(bytes::double * bytes) over w as ww, sum(packed::double) over w as wx, sum(packed::double * packed / bytes) over w as wxx,
  case when source <= 16777216 then source else least(16777216, greatest(4194304 + case when source >= 1073741824 then 4194304 else 0 end, 65536 * 16)) end as least_bytes
  from p join a using (archive_id) window w as (partition by archive_id order by ordinal rows unbounded preceding)),
m as (select *, wx / w as mean, case when w * w / ww > 1 then greatest(0.015, 2.5 * sqrt(greatest(0, wxx / w - (wx / w) * (wx / w))) / sqrt(w * w / ww)) else 1 end as margin from r),
s as (select *, n % 8 = 0 and n > 8 and abs(mean - lag(mean, 8) over (partition by archive_id order by n)) <= 0.01 as stable from m),
g as (select *, coalesce(stable, false) and n >= 16 and sampled >= least_bytes and margin <= 0.025 as good, last_value(case when n % 8 = 0 then coalesce(stable, false) end ignore nulls) over (partition by archive_id order by n) as steady from s),
c as (select archive_id, coalesce(min(n) filter (good), max(n)) as n from g group by 1),
l as (select g.*, floor(packed / sampled * source + 0.5)::bigint + overhead as plain from g join c using (archive_id, n)),
k as (select *, (plain + floor(plain * 5 / 100 + 0.5))::bigint as estimated, sampled / source >= 0.999 as whole from l),
z as (select *, case when whole then 0.08 else greatest(0.03, least(0.35, margin * source / estimated)) end as spread from k)
select archive_id, n::bigint as probes, sampled::bigint as sampled, estimated, floor(estimated * (1 - spread) + 0.5)::bigint as low, floor(estimated * (1 + spread) + 0.5)::bigint as high,
case when whole or (n >= 16 and sampled >= least_bytes and coalesce(steady, false) and margin <= 0.025) then 'high' when n >= 8 and margin <= 0.05 then 'medium' else 'low' end as confidence, ceil(estimated / 1048576)::bigint as volumes from z"""


@query(_ESTIMATE)
def estimate_archive(spark, sf_dir):
    p = probes(spark, sf_dir)
    n = F.count(F.lit(1))
    a = p.groupBy("archive_id").agg(n.alias("files"), (F.sum("bytes") * 4).alias("source_bytes"), (96 + n * 120).alias("overhead"))
    return M.estimate(a, p, chunk=65_536, budget=16 << 20, recovery=5, volume=1 << 20)


@query(f"""with {E_SQL} select archive_id, count(*) as files, sum(size)::bigint as source_bytes, (64 + count(*) * 110 + 2 * sum(octet_length(encode(path))) + ceil(sum(size) / 65536) * 88 + 128)::bigint as overhead from e group by 1""")
def estimate_overhead(spark, sf_dir):
    return M.overhead(entries(spark, sf_dir), 65_536, zip_format=True, sealed=True)


@query("""with c as (select user_id, event_type as symbol, count(*) as n from events group by all), s as (select *, greatest(1, n * 4096 // sum(n) over (partition by user_id))::bigint as f, row_number() over (partition by user_id order by n desc, symbol) as r from c)
select user_id, symbol, n, (f + case when r = 1 then 4096 - sum(f) over (partition by user_id) else 0 end)::bigint as freq from s""")
def frequency_normalise(spark, sf_dir):
    c = _read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return M.normalise(c, "user_id")


@query("with c as (select user_id, event_type as symbol, count(*) as n from events group by all) select user_id, symbol, n, round(-log2((n + 1) / (sum(n) over (partition by user_id) + 256)) * 16)::bigint as cost from c")
def symbol_costs(spark, sf_dir):
    c = _read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return M.symbol_costs(c, "user_id", 256)


_BYTES = "x as (select item_id, unnest(range(1, length(h) // 2 + 1)) as pos, h from (select item_id, hex(encode(text)) as h from benchmark)), y as (select item_id, pos, ('0x' || substr(h, 2 * pos - 1, 2))::int as b from x)"


@query(f"""with {_BYTES}, z as (select coalesce(lag(b) over (partition by item_id order by pos), 0) as ctx, b as symbol from y), c as (select ctx, symbol, count(*) as n from z group by all),
h as (select ctx, sum(n) as total from c group by 1), s as (select ctx, row_number() over (order by total desc, ctx) - 1 as cluster from h qualify cluster < 16), m as (select cluster, symbol, n as m from c join s using (ctx)),
a as (select cluster, sum(m) as total from m group by 1), k as (select c.ctx, a.cluster, round(sum(c.n * (log2(a.total + 256) - log2(coalesce(m.m, 0) + 1))), 6) as bits from c cross join a left join m on m.cluster = a.cluster and m.symbol = c.symbol group by 1, 2)
select ctx, arg_min(cluster, (bits, cluster))::int as cluster from k group by 1""")
def context_clusters(spark, sf_dir):
    c = Y.byte_counts(_read(spark, sf_dir, "benchmark"), "item_id", "text", order=1)
    c = c.groupBy(F.col("prev").alias("ctx"), F.col("b").alias("symbol")).agg(F.sum("n").alias("n"))
    return M.cluster_contexts(c, passes=1)


@query()
def document_context_clusters(spark, sf_dir):
    c = Y.byte_counts(_read(spark, sf_dir, "documents").withColumn("all", F.lit(0)), "all", "text", order=1)
    return M.cluster_contexts(c.select(F.col("prev").alias("ctx"), F.col("b").alias("symbol"), "n"), passes=1)


@query()
def document_nearest_match(spark, sf_dir):
    return M.nearest_match_whole(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def document_literal_lanes(spark, sf_dir):
    return Y.byte_lanes(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""with x as (select item_id, text, unnest(range(0, length(text) - 3)) as pos from benchmark), g as (select item_id, pos, substr(text, pos + 1, 4) as gram from x), d as (select item_id, pos, pos - lag(pos) over (partition by item_id, gram order by pos) as distance from g)
select item_id, pos::int as pos, distance::int as distance from d where distance <= 65536""")
def nearest_match(spark, sf_dir):
    return M.nearest_match(_read(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""with d as (select distinct l_orderkey::bigint as d from lineitem), p as (select d, d - 1 as p, length(bin(d - 1)) - 1 as n, length(bin(d)) - 1 as m from d),
s as (select *, case when p < 4 then p else 2 * n + ((p >> (n - 1)) & 1) end as slot from p)
select d, slot::bigint as slot, case when p < 4 then 0 else n - 1 end::int as bits, case when p < 4 then 0 else p - ((2 + slot % 2)::bigint << (n - 1)) end::bigint as footer, case when d < 16 then d else 12 + m end::int as code,
case when d < 16 then 0 else d - (1::bigint << m) end::bigint as extra from s""")
def match_codes(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("d")).distinct()
    d = d.withColumn("s", S.distance_slot(F.col("d"))).withColumn("v", S.value_code(F.col("d")))
    return d.select("d", "s.slot", "s.bits", F.col("s.value").alias("footer"), "v.code", "v.extra")


_WORDS = "w as (select l_suppkey as src, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos, floor(l_extendedprice)::bigint % 65536 as w from lineitem)"
_ZIG = "case when r < 32768 then 2 * r else 2 * (65536 - r) - 1 end"


def _word_rows(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.row_number().over(order).alias("pos"), (F.floor("l_extendedprice") % 65536).alias("w"))


@query(f"""with {_WORDS}, d as (select src, pos, ((w - coalesce(lag(w) over (partition by src order by pos), 0)) % 65536 + 65536) % 65536 as r from w), z as (select src, pos, {_ZIG} as z from d)
select src, pos::int as pos, (z & 255)::bigint as low, (z >> 8)::bigint as high from z""")
def word16_left(spark, sf_dir):
    by = Window.partitionBy("src").orderBy("pos")
    z = _word_rows(spark, sf_dir).select("src", "pos", S.zigzag16(F.col("w") - F.lag("w", 1, 0).over(by)).alias("z"))
    return z.select("src", "pos", (F.col("z") % 256).alias("low"), F.floor(F.col("z") / 256).alias("high"))


@query(f"""with {_WORDS}, d as (select src, pos, case when pos <= 9 then w else ((w - lag(w) over v - lag(w, 8) over v + lag(w, 9) over v) % 65536 + 65536) % 65536 end as r from w window v as (partition by src order by pos)), z as (select src, pos, {_ZIG} as z from d)
select src, pos::int as pos, (z & 255)::bigint as low, (z >> 8)::bigint as high from z""")
def word16_row(spark, sf_dir):
    by, w = Window.partitionBy("src").orderBy("pos"), F.col("w")
    lag = lambda k: F.lag("w", k).over(by)
    r = F.when(F.col("pos") <= 9, w).otherwise(w - lag(1) - lag(8) + lag(9))
    z = _word_rows(spark, sf_dir).select("src", "pos", S.zigzag16(r).alias("z"))
    return z.select("src", "pos", (F.col("z") % 256).alias("low"), F.floor(F.col("z") / 256).alias("high"))


@query(f"with {_BYTES} select item_id, pos::int as pos, (coalesce(lag(b) over (partition by item_id order by pos), 0) >> 5)::int as lane from y")
def literal_lanes(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.hex(F.col("text").cast("binary")).alias("h"))
    rows = b.where("length(h) > 0").select("item_id", "h", F.explode(F.sequence(F.lit(1), F.expr("int(length(h) / 2)"))).alias("pos"))
    before = F.conv(F.substring("h", 2 * F.col("pos") - 3, F.lit(2)), 16, 10).cast("int")
    return rows.select("item_id", "pos", F.when(F.col("pos") == 1, 0).otherwise(F.shiftright(before, 5)).alias("lane"))


@query(f"with {E_SQL}, a as (select archive_id, sum(size)::bigint as n from e group by 1), p as (select archive_id, n, unnest(range(0, greatest(1, (n + 99999) // 100000))) as part from a) select archive_id, part::bigint as part, (part * 100000)::bigint as \"begin\", least(n, (part + 1) * 100000)::bigint as \"end\" from p")
def volume_layout(spark, sf_dir):
    return V.volume_layout(entries(spark, sf_dir).groupBy("archive_id").agg(F.sum("size").alias("bytes")), 100_000)


@query(f"""with {E_SQL}, a as (select archive_id, sum(size)::bigint as bytes from e group by 1), d as (select *, least(greatest(1, (bytes + 65535) // 65536), 231) as k from a)
select archive_id, bytes, k::bigint as data_shards, greatest(1, least(255 - k, (k * 10 + 99) // 100))::bigint as parity_shards, greatest(1, (bytes + k - 1) // k)::bigint as shard_size from d""")
def recovery_geometry(spark, sf_dir):
    return V.recovery_geometry(entries(spark, sf_dir).groupBy("archive_id").agg(F.sum("size").alias("bytes")), 10, target=65_536)


@query("""with h as (select item_id, hex(encode(text)) as h, (octet_length(encode(text)) + 3) // 4 as n from benchmark where text <> ''), s as (select item_id, h, n, unnest(range(0, 4)) as shard from h)
select item_id::bigint as item_id, shard::int as shard, sha256(unhex(rpad(substr(h, 2 * n * shard + 1, 2 * n), (2 * n)::int, '0'))) as digest from s""")
def parity_repair(spark, sf_dir):
    """Two of four data shards of each text are lost or damaged and come back from two parity shards."""
    b = _read(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").cast("long").alias("stripe"), F.col("text").cast("binary").alias("d"))
    n = F.floor((F.octet_length("d") + 3) / 4).cast("int")
    cut = b.select(F.lit("b").alias("set_id"), "stripe", n.alias("n"), "d", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard"))
    piece = F.rpad(F.substring("d", F.col("shard") * F.col("n") + 1, F.col("n")), F.col("n"), F.lit(b"\0"))
    full = V.encode_parity(cut.select("set_id", "stripe", "shard", piece.alias("data")), 4, 2)
    hurt = full.where("shard <> stripe % 4").withColumn("data", F.when(F.col("shard") == (F.col("stripe") + 1) % 4, F.concat(F.lit(b"\0"), F.col("data"))).otherwise(F.col("data")))
    back = V.repair(hurt, 4, 2).where("shard < 4")
    return back.select(F.col("stripe").alias("item_id"), "shard", F.sha2("data", 256).alias("digest"))


@query()
def document_parity_repair(spark, sf_dir):
    """parity_repair for every document that is not empty; rows that repeat doc_id and text are one."""
    d = _read(spark, sf_dir, "documents").where("text <> ''")
    d = d.select(F.concat_ws(":", F.xxhash64("text"), "doc_id").alias("set_id"), F.pmod(F.xxhash64("text"), F.lit(4)).alias("stripe"), F.col("text").cast("binary").alias("d")).distinct()
    n = F.floor((F.octet_length("d") + 3) / 4).cast("int")
    cut = d.select("set_id", "stripe", n.alias("n"), "d", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard"))
    piece = F.rpad(F.substring("d", F.col("shard") * F.col("n") + 1, F.col("n")), F.col("n"), F.lit(b"\0"))
    full = V.encode_parity(cut.select("set_id", "stripe", "shard", piece.alias("data")), 4, 2)
    hurt = full.where("shard <> stripe").withColumn("data", F.when(F.col("shard") == (F.col("stripe") + 1) % 4, F.concat(F.lit(b"\0"), F.col("data"))).otherwise(F.col("data")))
    back = V.repair(hurt, 4, 2).where("shard < 4")
    return back.select(F.get(F.split("set_id", ":"), F.lit(1)).cast("long").alias("doc_id"), "shard", F.sha2("data", 256).alias("digest"))


@query("select doc_id, ceil(octet_length(encode(text)) / 4096)::bigint as blocks, octet_length(encode(text))::bigint as bytes, true as whole from documents where text <> ''")
def codec_round_trip(spark, sf_dir):
    """Every text through the block codecs and back."""
    packed = K.compress_blocks(K.split_blocks(_read(spark, sf_dir, "documents"), "doc_id", "text", 4096))
    back = K.decompress_blocks(packed)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.every(F.col("status") == "ok").alias("whole"))


@query(f"""with {E_SQL} select archive_id, path, upper(regexp_extract(path, '[^.]*$')) || ' file' as type_text, case when path like '%.zip' then 'ZIP archive' end as archive_type from e""")
def type_labels(spark, sf_dir):
    return entries(spark, sf_dir).select("archive_id", "path", S.type_text(F.col("path"), F.col("kind")).alias("type_text"), S.archive_type(F.col("path")).alias("archive_type"))


@query(f"""with {E_SQL} select archive_id, path, 'destination given twice' as rule from e where ord % 5 = 0 union select archive_id, path, 'not a directory but has children' from e where ord % 11 = 0 and ord % 13 <> 0 union select archive_id, path, 'type change' from e where ord % 13 = 0 and ord % 5 <> 0
union select archive_id, path, 'type change' from e where ord % 13 = 0 and ord % 5 = 0""")
def catalog_map_violations(spark, sf_dir):
    """Planted faults: paths given twice, children of files, directories over files."""
    e = entries(spark, sf_dir)
    new = e.unionByName(e.where("ord % 5 = 0")).withColumn("kind", F.when(F.col("ord") % 13 == 0, "directory").otherwise(F.col("kind")))
    new = new.unionByName(e.where("ord % 11 = 0").withColumn("path", F.concat("path", F.lit("/x"))))
    return C.map_violations(e, new)
