"""Queries over byte streams, hashes and kinds of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import catalog as C
from cairn.operators import streams as R
from cairn.plans import query
from cairn.plans.tree_queries import T_SQL, tree


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""with d as (select doc_id, octet_length(encode(text))::bigint as n from documents), x as (select doc_id, n, unnest(range(0, n, 1024)) as off from d where n > 0)
select doc_id, off // 1024 as block_no, off as "offset", least(1024, n - off) as size from x""")
def uniform_blocks(spark, sf_dir):
    return R.uniform_blocks(_read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")), "doc_id", "n", 1024)


@query()
def archive_crc32(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id", F.crc32(F.col("text").cast("binary")).alias("c"), F.octet_length("text").alias("n"))
    return R.crc_combine(docs, ["source"], "doc_id", "c", "n").select("source", S.crc_text(F.col("crc")).alias("crc"), "size")


@query()
def document_sampled_entropy(spark, sf_dir):
    return R.sampled_entropy(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def document_screen_entropy(spark, sf_dir):
    return R.screen_entropy(_read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""with s as (select p_partkey, (p_size % 9)::double as bits, (p_partkey * 37)::bigint as n from part), t as (select *, bits * n / 8.0 as payload from s)
select p_partkey, ceil(length(bin(n)) / 7.0) + 1 + ceil(length(bin(floor(payload)::bigint)) / 7.0) + payload as bound from t""")
def stream_lower_bound(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select("p_partkey", R.stream_lower_bound((F.col("p_size") % 9).cast("double"), F.col("p_partkey").cast("long") * 37).alias("bound"))


@query("""with x as (select o_orderkey, (o_orderkey::hugeint * 2654435 % 4294967296)::bigint as v from orders), a as (select *, xor(v, v >> 16) as v1 from x),
b as (select *, (v1::hugeint * 2146121005 % 4294967296)::bigint as v2 from a), c as (select *, xor(v2, v2 >> 15) as v3 from b),
d as (select *, (v3::hugeint * 2221713035 % 4294967296)::bigint as v4 from c)
select o_orderkey, xor(v4, v4 >> 16) as mixed, (v::hugeint * 2654435761 % 4294967296)::bigint >> 12 as slot from d""")
def integer_hashes(spark, sf_dir):
    v = F.col("o_orderkey").cast("long") * 2_654_435 % (1 << 32)
    return _read(spark, sf_dir, "orders").select("o_orderkey", S.avalanche32(v).alias("mixed"), S.gram_slot(v).alias("slot"))


@query(f"{T_SQL} select archive_id, path, kind from t where kind = 'dir' or kind = 'file' and path like '%.zip'")
def kinds_without_files(spark, sf_dir):
    return C.of_kinds(tree(spark, sf_dir), files=False).select("archive_id", "path", "kind")


_RANGES = """r as (select l_orderkey as stream, l_linenumber * 6000 as off, (l_quantity * 200)::bigint as size, case l_linenumber % 5 when 0 then 'branch' when 1 then 'delta' when 2 then 'word16'
  when 3 then 'none' else 'other' end as kind, case when l_linenumber % 5 = 2 then l_suppkey % 17 else l_suppkey % 90 * (l_linenumber % 5)::int end as p, 36000 as total from lineitem),
u as (select *, max(off + size) over (partition by stream order by off, size, p rows between unbounded preceding and 1 preceding) as e from r where kind <> 'none' and size >= 4096)"""


@query(f"""with {_RANGES} select stream, off as "offset", 'beyond the end' as rule from u where off + size > total union all select stream, off, 'unknown filter' from u where kind = 'other'
union all select stream, off, 'parameter' from u where kind = 'branch' and p <> 0 or kind = 'delta' and (p < 1 or p > 64) or kind = 'word16' and not (p = 0 or p between 7 and 15)
union all select stream, off, 'overlap' from u where off < e""")
def range_violations(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    kind = F.when(n == 0, "branch").when(n == 1, "delta").when(n == 2, "word16").when(n == 3, "none").otherwise("other")
    p = F.when(n == 2, F.col("l_suppkey") % 17).otherwise(F.col("l_suppkey") % 90 * n)
    ranges = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream"), (F.col("l_linenumber") * 6000).alias("offset"), (F.col("l_quantity") * 200).cast("long").alias("size"), kind.alias("kind"), p.alias("parameter"), F.lit(36_000).alias("total")
    )
    return R.range_violations(ranges, "stream")


_LEVELS = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in R.LEVELS)


@query(f"""with v(level, depth, good_length, block_mib, window_mib, longest, lazy) as (values {_LEVELS})
select p_partkey, v.* from part join v on level = greatest(1, least(9, p_size - 20))""")
def level_options(spark, sf_dir):
    return R.with_level(_read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 20).alias("level")), "level")
