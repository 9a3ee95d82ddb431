"""Catalog queries. The documents stand for files: an archive for each source, a path from language and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import catalog as C
from cairn.plans import query

BLOCK = 65536


def entries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.when(F.col("doc_id") % 4 == 0, "txt").when(F.col("doc_id") % 4 == 1, "JSON").when(F.col("doc_id") % 4 == 2, "py").otherwise("zip")
    path = F.concat_ws("/", "lang", F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return docs.select(
        F.col("source").alias("archive_id"), F.col("doc_id").alias("ord"), path.alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_target"),
        F.octet_length("text").cast("long").alias("size"), (1_700_000_000 + F.col("doc_id") * 37 % 100_000).alias("mtime"), F.sha2("text", 256).alias("digest"),
    )


E_SQL = """e as (select source as archive_id, doc_id as ord, lang || '/d' || (doc_id % 7) || '/f' || doc_id || '.' ||
  case doc_id % 4 when 0 then 'txt' when 1 then 'JSON' when 2 then 'py' else 'zip' end as path, 'file' as kind, null::varchar as link_target,
  octet_length(encode(text))::bigint as size, 1700000000 + doc_id * 37 % 100000 as mtime, sha256(text) as digest from documents)"""

P_SQL = E_SQL + f""",
p as (select *, coalesce(sum(size) over (partition by archive_id order by ord rows between unbounded preceding and 1 preceding), 0) as b0 from e),
q as (select *, b0 + size as b1 from p),
x as (select archive_id, path, n as block_no, greatest(b0, n * {BLOCK}) - n * {BLOCK} as block_from, least(b1, (n + 1) * {BLOCK}) - n * {BLOCK} as block_to
  from (select *, unnest(range((b0 // {BLOCK})::bigint, ((b1 - 1) // {BLOCK})::bigint + 1)) as n from q where size > 0)),
k as (select archive_id, block_no, sum(block_to - block_from) as usize, greatest(1, (sum(block_to - block_from) * (30 + block_no % 50)) // 100) as csize from x group by archive_id, block_no),
l as (select e.*, case when size = 0 then 0 else greatest(1, floor(s + 0.5)) end::bigint as packed from e
  left join (select x.archive_id, x.path, sum((block_to - block_from) * csize / usize) as s from x join k using (archive_id, block_no) group by x.archive_id, x.path) using (archive_id, path))"""


def placed(spark, sf_dir):
    return C.layout(entries(spark, sf_dir), BLOCK)


def pieces(spark, sf_dir):
    return C.extents(placed(spark, sf_dir), BLOCK)


def blocks(spark, sf_dir):
    out = pieces(spark, sf_dir).groupBy("archive_id", "block_no").agg(F.sum(F.col("block_to") - F.col("block_from")).alias("usize"))
    return out.withColumn("csize", F.greatest(F.lit(1), F.floor(F.col("usize") * (30 + F.col("block_no") % 50) / 100)))


def listing(spark, sf_dir):
    return C.packed_sizes(entries(spark, sf_dir), pieces(spark, sf_dir), blocks(spark, sf_dir))


def disk(spark, sf_dir):
    """The same files later: some gone, some newer, some new."""
    e = entries(spark, sf_dir).where("ord % 10 <> 3")
    newer = e.withColumn("mtime", F.col("mtime") + F.when(F.col("ord") % 3 == 0, 60).when(F.col("ord") % 3 == 1, 0).otherwise(-60))
    new = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.lit("src0").alias("archive_id"), (10_000_000 + F.col("item_id")).alias("ord"), F.concat(F.lit("new/b"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("link_target"), F.octet_length("text").cast("long").alias("size"), F.lit(1_800_000_000).cast("long").alias("mtime"), F.sha2("text", 256).alias("digest"),
    )
    return newer.unionByName(new)


D_SQL = E_SQL + """,
d as (select archive_id, ord, path, kind, link_target, size, mtime + case ord % 3 when 0 then 60 when 1 then 0 else -60 end as mtime, digest from e where ord % 10 <> 3
  union all select 'src0', 10000000 + item_id, 'new/b' || item_id || '.txt', 'file', null, octet_length(encode(text)), 1800000000, sha256(text) from benchmark)"""


def targets(spark, sf_dir):
    rows = entries(spark, sf_dir).select("archive_id").distinct()
    return rows.select("archive_id", F.explode(F.array(F.lit("fr"), F.lit("en/d1"), F.lit("de/d"))).alias("target"))


T_SQL = "t as (select distinct archive_id, unnest(['fr', 'en/d1', 'de/d']) as target from e)"
UNDER = "(e.path = t.target or starts_with(e.path, t.target || '/'))"


@query(f"with {P_SQL} select archive_id, path, size, packed from l")
def catalog_list(spark, sf_dir):
    return listing(spark, sf_dir).select("archive_id", "path", "size", "packed")


@query(f"with {P_SQL} select archive_id, path, block_no::bigint as block_no, block_from::bigint as block_from, block_to::bigint as block_to from x")
def catalog_extents(spark, sf_dir):
    return pieces(spark, sf_dir).select("archive_id", "path", "block_no", "block_from", "block_to")


@query(f"with {P_SQL} select archive_id, count(*) as files, 0::bigint as directories, sum(size)::bigint as unpacked, sum(packed)::bigint as packed from l group by archive_id")
def catalog_summary(spark, sf_dir):
    return C.summary(listing(spark, sf_dir))


@query(f"with {E_SQL} select coalesce(kind, 'TOTAL') as kind, count(*) as n, sum(size)::bigint as bytes from e group by rollup (kind)")
def catalog_kind_totals(spark, sf_dir):
    return C.kind_totals(entries(spark, sf_dir))


@query(f"with {D_SQL} select archive_id, path, case when e.path is null then 'add' when d.path is null then 'delete' when d.mtime > e.mtime then 'replace' else 'keep' end as action from e full join d using (archive_id, path)")
def catalog_update_actions(spark, sf_dir):
    return C.update_actions(entries(spark, sf_dir), disk(spark, sf_dir))


_UPDATE = f"""with {D_SQL}, a as (select d.* from d left join e using (archive_id, path) where e.path is null or d.mtime > e.mtime),
u as (select * from a union all select * from e where (archive_id, path) not in (select (archive_id, path) from a))"""


@query(_UPDATE + " select archive_id, path, size, mtime from u")
def catalog_update(spark, sf_dir):
    return C.update(entries(spark, sf_dir), disk(spark, sf_dir)).select("archive_id", "path", "size", "mtime")


@query(f"with {D_SQL}, a as (select d.* from d join e using (archive_id, path) where d.mtime > e.mtime) select archive_id, path, size, mtime from a union all select archive_id, path, size, mtime from e where (archive_id, path) not in (select (archive_id, path) from a)")
def catalog_fresh(spark, sf_dir):
    return C.update(entries(spark, sf_dir), disk(spark, sf_dir), fresh_only=True).select("archive_id", "path", "size", "mtime")


@query(_UPDATE + " select archive_id, path, size, mtime from u where (archive_id, path) in (select (archive_id, path) from d)")
def catalog_sync(spark, sf_dir):
    return C.sync(entries(spark, sf_dir), disk(spark, sf_dir)).select("archive_id", "path", "size", "mtime")


@query(f"with {E_SQL}, {T_SQL} select archive_id, path from e where not exists (select 1 from t where t.archive_id = e.archive_id and {UNDER})")
def catalog_delete(spark, sf_dir):
    return C.delete(entries(spark, sf_dir), targets(spark, sf_dir)).select("archive_id", "path")


@query(f"with {E_SQL}, {T_SQL} select archive_id, path from e where exists (select 1 from t where t.archive_id = e.archive_id and {UNDER})")
def catalog_extract_selection(spark, sf_dir):
    return C.select(entries(spark, sf_dir), targets(spark, sf_dir)).select("archive_id", "path")


@query(f"with {E_SQL}, {T_SQL} select archive_id, target from t where not exists (select 1 from e where t.archive_id = e.archive_id and {UNDER})")
def catalog_unmatched_requests(spark, sf_dir):
    return C.unmatched(entries(spark, sf_dir), targets(spark, sf_dir))


@query(f"with {E_SQL} select archive_id, case when path like 'en/d1/%' then 'first/' || substr(path, 7) when path like 'en/%' then 'english' || substr(path, 3) else path end as path from e")
def catalog_move(spark, sf_dir):
    e = entries(spark, sf_dir)
    moves = e.select("archive_id").distinct().select("archive_id", F.explode(F.create_map(F.lit("en"), F.lit("english"), F.lit("en/d1"), F.lit("first"))).alias("src", "dest"))
    return C.move(e, moves).select("archive_id", "path")


_LINKS = f"{E_SQL}, h as (select *, row_number() over w as r, first_value(path) over w as lead from e window w as (partition by archive_id, digest order by ord))"


@query(f"with {_LINKS} select archive_id, path, ord, case when r > 1 then 'hardlink' else kind end as kind, case when r > 1 then lead end as link_target from h")
def catalog_hard_links(spark, sf_dir):
    return C.hard_links(entries(spark, sf_dir))


@query(f"with {E_SQL}, m as (select archive_id, unnest([lang_dir, sub]) as path from (select archive_id, split_part(path, '/', 1) as lang_dir, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as sub from e)) select distinct archive_id, path from m")
def catalog_implied_directories(spark, sf_dir):
    return C.implied_directories(entries(spark, sf_dir))


@query(f"""with {E_SQL}, n as (select archive_id, path from e union select archive_id, split_part(path, '/', 1) from e union select archive_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from e)
select archive_id, parent, count(*) as children, min(name) as first_child, max(name) as last_child from (select archive_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, regexp_extract(path, '[^/]*$') as name from n) group by archive_id, parent""")
def catalog_tree(spark, sf_dir):
    return C.tree(entries(spark, sf_dir))


@query(f"with {E_SQL} select archive_id, path, size from e where (regexp_matches(lower(path), '/f1[^/]*\\.txt$') or regexp_matches(lower(path), '/[^/]*\\.json$')) and contains(lower(regexp_extract(path, '[^/]*$')), '9')")
def catalog_search(spark, sf_dir):
    return C.search(entries(spark, sf_dir), "F1*.txt; *.json", "9", limit=None)


@query(f"""with {E_SQL}, r as (select archive_id, path, lower(regexp_extract(path, '[^/]*$')) as name from e),
s as (select *, case when starts_with(name, 'f77') then 0 when contains(name, 'f77') then 1 when name >= 'f77' then 2 end as rank from r)
select archive_id, arg_min(path, (rank, name, path)) as path, min(rank)::int as rank from s where rank is not null group by archive_id""")
def catalog_type_ahead(spark, sf_dir):
    return C.type_ahead(entries(spark, sf_dir), "f77")


@query(f"""with {E_SQL}, c as (select *, case lower(regexp_extract(path, '[^.]*$')) when 'txt' then 1 when 'json' then 1 when 'py' then 1 when 'zip' then 5 else 4 end as class from e)
select archive_id, path, class::int as class, row_number() over (partition by archive_id order by class, case when class > 0 then lower(regexp_extract(path, '[^.]*$')) end, ord)::int as position from c""")
def catalog_compression_order(spark, sf_dir):
    return C.ordered(entries(spark, sf_dir))


@query(f"with {P_SQL} select archive_id, sum(case when path like 'fr/%' then block_to - block_from else 0 end)::bigint as dead from x group by archive_id")
def catalog_repack_dead_bytes(spark, sf_dir):
    live = pieces(spark, sf_dir).where(~S.same_or_child(F.col("path"), F.lit("fr")))
    return C.dead_bytes(blocks(spark, sf_dir), live)


@query(f"with {E_SQL} select archive_id, path, count(*) as count from (select * from e union all select * from e where ord % 5 = 0) group by archive_id, path having count(*) > 1")
def catalog_duplicate_destinations(spark, sf_dir):
    e = entries(spark, sf_dir)
    return C.duplicates(e.unionByName(e.where("ord % 5 = 0")))


@query(f"""with {E_SQL} select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, regexp_extract(path, '[^/]*$') as name, lower(regexp_extract(path, '[^.]*$')) as ext,
case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', round_even(size / 1024.0, 1)) else printf('%.1f MB', round_even(size / 1048576.0, 1)) end as size_text, strftime(to_timestamp(mtime) at time zone 'UTC', '%Y-%m-%d %H:%M') as modified,
greatest(1, ceil(length(bin(size)) / 7.0))::int as varint, size + 1024 * 1024 as parsed from e""")
def scalar_paths_and_sizes(spark, sf_dir):
    p, n = F.col("path"), F.col("size")
    parsed = n + S.parse_size(F.lit("1M"))
    return entries(spark, sf_dir).select(
        p, S.parent_path(p).alias("parent"), S.base_name(p).alias("name"), S.extension(p).alias("ext"), S.size_text(n).alias("size_text"), S.unix_minute(F.col("mtime")).alias("modified"), S.varint_size(n).alias("varint"), parsed.alias("parsed")
    )


@query("""select p_partkey, case when p_size % 3 = 0 then p_name else '../' || p_name end not like '../%' as safe,
case when length(p_name) <= 12 then p_name else left(p_name, 4) || '...' || right(p_name, 5) end as short,
2 * p_size as zig, -sign(p_size % 5 - 2)::int as version from part""")
def scalar_guards(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("../"), F.col("p_name")))
    version = S.compare_versions(F.lit("v1.2"), F.concat(F.lit("1."), (F.col("p_size") % 5).cast("string")))
    return part.select("p_partkey", S.is_safe_relative(path).alias("safe"), S.shorten_middle(F.col("p_name"), 12).alias("short"), S.zigzag16(F.col("p_size")).alias("zig"), version.alias("version"))
