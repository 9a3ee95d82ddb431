"""Queries over trees of all kinds of rows: files, folders, hard links (some dangling) and symbolic links; and further scalar and benchmark rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import benchstats as B
from cairn.operators import catalog as C
from cairn.plans import query
from cairn.plans.catalog_queries import E_SQL, entries

T_SQL = "with " + E_SQL + """,
d as (select distinct archive_id, split_part(path, '/', 1) as path from e union select distinct archive_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from e),
t as (select archive_id, ord, path, kind, link_target, size, mtime, digest from e
  union all select archive_id, null, path, 'dir', null, null, 0, null from d
  union all select archive_id, 20000000 + ord, 'links/h' || ord, 'hardlink', case when ord % 20 = 5 then 'gone/' || ord else path end, null, mtime, null from e where ord % 5 = 0
  union all select archive_id, 30000000 + ord, 'links/s' || ord, 'symlink', path, null, mtime, null from e where ord % 9 = 0)"""


def tree(spark, sf_dir):
    e = entries(spark, sf_dir)
    part = F.split("path", "/")
    dirs = e.select("archive_id", F.explode(F.array(part[0], F.concat_ws("/", part[0], part[1]))).alias("path")).distinct()
    none = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    dirs = dirs.select("archive_id", *none("long", "ord"), "path", F.lit("dir").alias("kind"), *none("string", "link_target"), *none("long", "size"), F.lit(0).cast("long").alias("mtime"), *none("string", "digest"))

    def links(kind, letter, every, first, target):
        path = F.concat(F.lit(f"links/{letter}"), F.col("ord").cast("string"))
        return e.where(F.col("ord") % every == 0).select(
            "archive_id", (first + F.col("ord")).alias("ord"), path.alias("path"), F.lit(kind).alias("kind"), target.alias("link_target"), *none("long", "size"), "mtime", *none("string", "digest")
        )

    gone = F.when(F.col("ord") % 20 == 5, F.concat(F.lit("gone/"), F.col("ord").cast("string"))).otherwise(F.col("path"))
    return e.unionByName(dirs).unionByName(links("hardlink", "h", 5, 20_000_000, gone)).unionByName(links("symlink", "s", 9, 30_000_000, F.col("path")))


def _targets(spark, sf_dir):
    return entries(spark, sf_dir).select("archive_id", F.concat_ws("/", F.split("path", "/")[0], F.lit("d3")).alias("target")).distinct()


_TARGETS = "g as (select distinct archive_id, split_part(path, '/', 1) || '/d3' as target from e)"
_RANK = "case when kind = 'dir' then 0 when path like '%.zip' then 1 else 2 end"


@query(f"""{T_SQL} select archive_id, path, row_number() over (partition by archive_id order by {_RANK}, coalesce(size, 0) desc, lower(path) desc, path desc)::int as place from t""")
def browser_sort_desc(spark, sf_dir):
    return C.browser_order(tree(spark, sf_dir), "size", descending=True).select("archive_id", "path", "place")


@query(f"""{T_SQL} select archive_id, path, row_number() over (partition by archive_id order by {_RANK}, lower(path), path)::int as place from t""")
def browser_sort_default(spark, sf_dir):
    return C.browser_order(tree(spark, sf_dir), "path").select("archive_id", "path", "place")


@query(f"""{T_SQL} select archive_id, path, len(string_split(path, '/'))::int as depth from t where kind = 'dir'""")
def restore_order(spark, sf_dir):
    return C.restore_order(tree(spark, sf_dir))


@query(f"""{T_SQL} select h.archive_id, h.path, h.link_target, f.ord as file_ord, f.size as file_size, f.digest as file_digest, f.ord is null as dangling
from t h left join t f on f.archive_id = h.archive_id and f.path = h.link_target and f.kind = 'file' where h.kind = 'hardlink'""")
def hardlink_targets(spark, sf_dir):
    return C.hard_link_targets(tree(spark, sf_dir))


@query(f"""{T_SQL}, {_TARGETS},
k as (select t.* from t where not exists (select 1 from g where g.archive_id = t.archive_id and (t.path = target or starts_with(t.path, target || '/'))))
select archive_id, path, kind from k where kind <> 'hardlink' or exists (select 1 from k x where x.archive_id = k.archive_id and x.path = k.link_target)""")
def hardlink_survivors(spark, sf_dir):
    return C.delete(tree(spark, sf_dir), _targets(spark, sf_dir)).select("archive_id", "path", "kind")


@query(f"""{T_SQL}, {_TARGETS}, c as (select t.archive_id, t.path from t join g on g.archive_id = t.archive_id and (t.path = target or starts_with(t.path, target || '/')))
select archive_id, path from c union select archive_id, split_part(path, '/', 1) from c union select archive_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from c""")
def selection_with_parents(spark, sf_dir):
    return C.with_parents(tree(spark, sf_dir), _targets(spark, sf_dir))


@query(f"""{T_SQL} select path, min(archive_id) as archive_id, arg_min(size, archive_id) as size from t where kind = 'file' group by path""")
def overlapping_roots(spark, sf_dir):
    files = tree(spark, sf_dir).where("kind = 'file'").select("path", "archive_id", "size")
    return C.first_scan(files, ["path"], "archive_id")


@query("""select o_orderkey, (133000000000000000 + o_orderkey * 9999999) // 10000000 - 11644473600 as seconds,
(o_orderkey + 11644473600) * 10000000 as ticks, (date '1970-01-01' + (o_orderkey % 9000)::int - date '1970-01-01')::int as day,
translate(o_orderpriority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
case when o_orderkey % 2 = 0 then o_orderstatus || '/' || o_orderpriority else o_orderstatus end as joined,
least(18446744073709551600::decimal(38,0) + o_orderkey, 18446744073709551615)::double as capped from orders""")
def scalar_times_and_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    date = F.date_add(F.lit("1970-01-01").cast("date"), (k % 9000).cast("int"))
    child = F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("")
    capped = S.saturated_add(F.lit("18446744073709551600").cast("decimal(20,0)"), k.cast("decimal(20,0)"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k, S.filetime_seconds(F.lit(133_000_000_000_000_000) + k * 9_999_999).alias("seconds"), S.seconds_filetime(k).alias("ticks"),
        S.civil_day(F.year(date), F.month(date), F.day(date)).alias("day"), S.ascii_lower(F.col("o_orderpriority")).alias("low"),
        S.join_path(F.col("o_orderstatus"), child).alias("joined"), capped.cast("double").alias("capped"),
    )


_GAP = """with b as (select l_suppkey::varchar as member, sum(l_partkey)::bigint as n from lineitem where l_returnflag = 'R' group by 1),
c as (select l_suppkey::varchar as member, sum(l_partkey)::bigint as n from lineitem where l_returnflag <> 'R' group by 1),
j as (select member, b.n as base, c.n as now from b join c using (member)), a as (select * from j union all select 'TOTAL', sum(base)::bigint, sum(now)::bigint from j)
select member, base, now, now - base as delta, case when base <> 0 then 100.0 * (now - base) / base end as percent from a"""


@query(_GAP)
def gap_report(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda rows: rows.groupBy(F.col("l_suppkey").alias("member")).agg(F.sum("l_partkey").alias("n"))
    return B.gap_report(side(lines.where("l_returnflag = 'R'")), side(lines.where("l_returnflag <> 'R'")), "member", "n")


@query("""with s as (select event_type, sum(octet_length(encode(props)))::bigint as raw, sum(user_id)::bigint as coded from events group by event_type)
select event_type, raw, coded, case when raw > 0 then 8.0 * coded / raw end as bits, coded / (select sum(coded) from s) as share from s""")
def stream_share(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.octet_length("props").cast("long").alias("raw"), "user_id")
    return B.stream_share(events, "event_type", "raw", "user_id")


@query("""select l_linestatus, sum(l_partkey)::bigint as bytes, sum(l_partkey) / 1024.0 / sum(l_linenumber) as kib_s, sum(l_suppkey) / sum(l_linenumber) as cpu_use,
sum(l_partkey) / 1024.0 / sum(l_suppkey) as kib_core_s from lineitem group by l_linestatus""")
def metric_rows(spark, sf_dir):
    return B.metric_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_linestatus"], "l_partkey", "l_linenumber", "l_suppkey")


@query("""with p as (select p_brand, p_partkey, 12 + p_size % 5 as len from part)
select p_brand, p_partkey, len::int as len, (coalesce(sum(pow(2.0, -len)) over (partition by p_brand order by len, p_partkey rows between unbounded preceding and 1 preceding), 0) * pow(2.0, len))::bigint as code from p""")
def canonical_codes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", (12 + F.col("p_size") % 5).cast("int").alias("len"))
    return B.canonical_codes(part, "p_brand", "p_partkey", "len")
