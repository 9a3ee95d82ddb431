"""Catalog algebra on entries (archive_id, ord, path, kind, size, mtime, digest, link_target) and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import scalars as S
from cairn.operators.running import running_before

KEY = ["archive_id", "path"]
#: Entries of an archive that share a bucket of the running total.
ORD_BUCKET = 65536


def layout(entries: DataFrame, block: int) -> DataFrame:
    """Adds the file's first byte and last + 1 in the solid stream of its archive; directories and links take no room."""
    size = F.when(F.col("kind") == "file", F.col("size")).otherwise(0)
    placed = running_before(entries, ["archive_id"], "ord", size, F.floor(F.col("ord") / ORD_BUCKET), "begin")
    start = F.col("begin")
    return placed.withColumn("end", start + size).withColumn("first_block", F.floor(start / block)).withColumn("block_offset", start % block)


def extents(placed: DataFrame, block: int) -> DataFrame:
    """One row for each file and block it touches; the range join as an equi-join on block numbers."""
    numbers = F.sequence(F.col("first_block"), F.floor((F.col("end") - 1) / block))
    rows = placed.where("kind = 'file' and size > 0").select("archive_id", "path", "begin", "end", F.explode(numbers).alias("block_no"))
    low = F.greatest(F.col("begin"), F.col("block_no") * block)
    high = F.least(F.col("end"), (F.col("block_no") + 1) * block)
    return rows.select("archive_id", "path", "block_no", (low - F.col("block_no") * block).alias("block_from"), (high - F.col("block_no") * block).alias("block_to"))


def packed_sizes(entries: DataFrame, pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of the packed blocks of each entry: round half up, at least 1; 0 for empty files, null for other kinds."""
    share = pieces.join(blocks, ["archive_id", "block_no"]).groupBy(KEY).agg(
        F.sum((F.col("block_to") - F.col("block_from")) * F.col("csize") / F.col("usize")).alias("share")
    )
    packed = F.when(F.col("kind") != "file", None).when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("share") + 0.5)))
    return entries.join(share, KEY, "left").withColumn("packed", packed.cast("long")).drop("share")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select(KEY), KEY, "left_anti").unionByName(new)


def update_actions(old: DataFrame, disk: DataFrame) -> DataFrame:
    """One full join gives each path its action: add, replace (files that are newer), keep or delete (for sync)."""
    a = old.select(*KEY, F.col("mtime").alias("was"))
    b = disk.select(*KEY, F.col("mtime").alias("now"), "kind")
    action = (
        F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").when((F.col("kind") == "file") & (F.col("now") > F.col("was")), "replace").otherwise("keep")
    )
    return a.join(b, KEY, "full").select(*KEY, action.alias("action"))


def update(old: DataFrame, disk: DataFrame, fresh_only: bool = False) -> DataFrame:
    wanted = ["replace"] if fresh_only else ["add", "replace"]
    take = update_actions(old, disk).where(F.col("action").isin(wanted)).select(KEY)
    return upsert(old, disk.join(take, KEY, "left_semi"))


def sync(old: DataFrame, disk: DataFrame) -> DataFrame:
    return update(old, disk).join(disk.select(KEY), KEY, "left_semi")


def _touched(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows at or under a target (archive_id, target): a prefix join as an equi-join on ancestors."""
    up = entries.select(*KEY, F.explode(S.ancestors(F.col("path"))).alias("target"))
    return up.join(targets, ["archive_id", "target"], "left_semi").select(KEY).distinct()


def delete(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Removes targets with their subtrees, and links whose file has gone."""
    kept = entries.join(_touched(entries, targets), KEY, "left_anti")
    alive = kept.select("archive_id", F.col("path").alias("link_target"))
    links = kept.where("kind = 'hardlink'").join(alive, ["archive_id", "link_target"], "left_semi")
    return kept.where("kind <> 'hardlink'").unionByName(links.select(kept.columns))


def select(entries: DataFrame, targets: DataFrame) -> DataFrame:
    return entries.join(_touched(entries, targets), KEY, "left_semi")


def unmatched(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that select nothing."""
    up = entries.select("archive_id", F.explode(S.ancestors(F.col("path"))).alias("target")).distinct()
    return targets.join(up, ["archive_id", "target"], "left_anti")


def move(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Rewrites paths at or under src (archive_id, src, dest), the longest src first, and link targets likewise."""

    def rewrite(rows: DataFrame, column: str) -> DataFrame:
        up = rows.select("archive_id", column, F.explode(S.ancestors(F.col(column))).alias("src")).distinct()
        hit = up.join(moves, ["archive_id", "src"]).groupBy("archive_id", column).agg(F.max_by(F.struct("src", "dest"), F.length("src")).alias("m"))
        new = F.when(F.col("m").isNotNull(), F.concat("m.dest", F.expr(f"substring({column}, length(m.src) + 1)"))).otherwise(F.col(column))
        return rows.join(hit, ["archive_id", column], "left").withColumn(column, new).drop("m")

    return rewrite(rewrite(entries, "path"), "link_target").select(entries.columns)


def _above(rows: DataFrame, column: str = "path") -> DataFrame:
    """(archive_id, column, up): every directory strictly above a path."""
    up = rows.select("archive_id", column, F.explode(S.ancestors(F.col(column))).alias("up"))
    return up.where(F.col("up") != F.col(column))


def _bad(rows: DataFrame, column: str, rule: str) -> DataFrame:
    return rows.select("archive_id", F.col(column).alias("path"), F.lit(rule).alias("rule")).distinct()


def _children_of_files(entries: DataFrame) -> DataFrame:
    flat = entries.where("kind <> 'directory'").select("archive_id", F.col("path").alias("up"))
    return _bad(_above(entries).join(flat, ["archive_id", "up"]), "up", "not a directory but has children")


def map_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(archive_id, path, rule) for rows to add that break the catalog; empty when all may go in."""
    twice = _bad(duplicates(new), "path", "destination given twice")
    kinds = new.join(old.select(*KEY, F.col("kind").alias("was")), KEY).where("(kind = 'directory') <> (was = 'directory')")
    merged = upsert(old.select(*KEY, "kind"), new.select(*KEY, "kind"))
    return twice.unionByName(_bad(kinds, "path", "type change")).unionByName(_children_of_files(merged))


def move_violations(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """(archive_id, path, rule) for moves (archive_id, src, dest) that may not be done; prefix tests are equi-joins on ancestors."""
    m = moves.select("archive_id", "src", "dest")
    twice = lambda c, rule: _bad(m.groupBy("archive_id", c).count().where("count > 1"), c, rule)
    other = m.select("archive_id", F.col("src").alias("up"), F.col("src").alias("other"))
    under = lambda c: m.select("*", F.explode(S.ancestors(F.col(c))).alias("up")).join(other, ["archive_id", "up"])
    by_dest, by_src = under("dest"), under("src")
    have = entries.select("archive_id", F.explode(S.ancestors(F.col("path"))).alias("src")).distinct()
    after = move(entries, m)
    parents = after.select(*KEY, S.parent_path(F.col("path")).alias("up"))
    flat = after.where("kind <> 'directory'").select("archive_id", F.col("path").alias("up"))
    files = after.where("kind = 'file'").select("archive_id", F.col("path").alias("link_target"))
    found = [
        _bad(m.where("src = dest"), "src", "source is destination"),
        twice("src", "source given twice"),
        twice("dest", "destination given twice"),
        _bad(by_dest.where("other = src and src <> dest"), "src", "into its own subtree"),
        _bad(by_src.where("other <> src"), "src", "sources overlap"),
        _bad(by_dest.where("other <> src"), "dest", "destination in a moved subtree"),
        _bad(m.join(have, ["archive_id", "src"], "left_anti"), "src", "no such source"),
        _bad(duplicates(after), "path", "destination exists"),
        _bad(parents.join(flat, ["archive_id", "up"]), "up", "parent is not a directory"),
        _children_of_files(after),
        _bad(after.where("kind = 'hardlink'").join(files, ["archive_id", "link_target"], "left_anti"), "path", "dangling hard link"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def duplicates(entries: DataFrame) -> DataFrame:
    return entries.groupBy(KEY).count().where("count > 1")


def hard_links(entries: DataFrame) -> DataFrame:
    """Files of one content: the first keeps its bytes, the others become links to it."""
    w = Window.partitionBy("archive_id", "digest").orderBy("ord")
    first = F.first("path").over(w)
    again = (F.col("kind") == "file") & (F.row_number().over(w) > 1)
    return entries.select(*KEY, "ord", F.when(again, "hardlink").otherwise(F.col("kind")).alias("kind"), F.when(again, first).alias("link_target"))


def implied_directories(entries: DataFrame) -> DataFrame:
    up = entries.select("archive_id", F.explode(S.ancestors(S.parent_path(F.col("path")))).alias("path")).where("path <> ''").distinct()
    return up.join(entries.select(KEY), KEY, "left_anti")


def tree(entries: DataFrame) -> DataFrame:
    """Children of every directory: files and implied directories, sorted by name."""
    nodes = entries.select(KEY).unionByName(implied_directories(entries))
    return nodes.groupBy("archive_id", S.parent_path(F.col("path")).alias("parent")).agg(F.count(F.lit(1)).alias("children"), F.min(S.base_name(F.col("path"))).alias("first_child"), F.max(S.base_name(F.col("path"))).alias("last_child"))


def summary(listing: DataFrame) -> DataFrame:
    """Files, directories, unpacked and packed bytes; links are left out."""
    is_file = F.col("kind") == "file"
    return listing.groupBy("archive_id").agg(
        F.count_if(is_file).alias("files"), F.count_if(F.col("kind") == "directory").alias("directories"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("unpacked"), F.coalesce(F.sum(F.when(is_file, F.col("packed"))), F.lit(0)).alias("packed"),
    )


def kind_totals(entries: DataFrame) -> DataFrame:
    """Count and bytes by kind with a total line."""
    out = entries.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("TOTAL")))


def search(entries: DataFrame, patterns: str, text: str = "", whole: bool = False, limit: int | None = 100_000) -> DataFrame:
    """Rows whose name fits one of the patterns (split at ; or ,) and holds the text: all of them where limit is None, else the first
    limit ones in order with truncated, which tells of more."""
    name = F.lower(S.base_name(F.col("path")))
    list_ = [p.strip() for p in patterns.replace(",", ";").split(";") if p.strip()]
    fits: Column = F.lit(not list_)
    for p in list_:
        fits = fits | F.rlike(name, S.wildcard_regex(F.lit(p)))
    has = (name == text.lower()) if whole else F.contains(name, F.lit(text.lower()))
    found = entries.where(fits & (has | F.lit(text == ""))).select(*KEY, "size")
    if limit is None:
        return found
    some = found.orderBy(*KEY).limit(limit + 1)
    return some.orderBy(*KEY).limit(limit).crossJoin(F.broadcast(some.agg((F.count(F.lit(1)) > limit).alias("truncated"))))


def of_kinds(entries: DataFrame, files: bool = True, folders: bool = True, archives: bool = True) -> DataFrame:
    """Rows of the wanted kinds: folders, archives (files by their name) and files, to which links count."""
    folder = F.col("kind").isin("dir", "directory")
    archive = (F.col("kind") == "archive") | (F.col("kind") == "file") & F.coalesce(S.archive_type(F.col("path")).isNotNull(), F.lit(False))
    return entries.where(F.when(folder, F.lit(folders)).when(archive, F.lit(archives)).otherwise(F.lit(files)))


def type_ahead(entries: DataFrame, needle: str) -> DataFrame:
    """The best row of each archive: prefix, then substring, then the next name in order."""
    name = F.lower(S.base_name(F.col("path")))
    rank = F.when(F.startswith(name, F.lit(needle)), 0).when(F.contains(name, F.lit(needle)), 1).when(name >= needle, 2)
    ranked = entries.select("archive_id", "path", rank.alias("rank"), name.alias("name")).where("rank is not null")
    return ranked.groupBy("archive_id").agg(F.min(F.struct("rank", "name", "path")).alias("best")).select("archive_id", "best.path", "best.rank")


def ordered(entries: DataFrame) -> DataFrame:
    """Position in compression order: type class, extension, then scan order."""
    cls = S.type_class(F.col("path"), F.col("kind"))
    w = Window.partitionBy("archive_id").orderBy(cls, F.when(cls > 0, S.extension(F.col("path"))), "ord")
    return entries.select(*KEY, cls.alias("class"), F.row_number().over(w).alias("position"))


def dead_bytes(blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """Block bytes that no live entry covers, for each archive: what a repack gives back."""
    live = pieces.groupBy("archive_id").agg(F.sum(F.col("block_to") - F.col("block_from")).alias("live"))
    total = blocks.groupBy("archive_id").agg(F.sum("usize").alias("total"))
    return total.join(live, "archive_id", "left").select("archive_id", (F.col("total") - F.coalesce("live", F.lit(0))).alias("dead"))


def browser_order(entries: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Adds place, the row's place in its archive's table: folders, containers, then files, each by column and then by name.

    Descending turns column and name round, never the rank of the kinds. A null column sorts as 0 or as the empty text. A table that a
    browser shows is one archive's, so the window is by archive.
    """
    rank = F.when(F.col("kind") == "dir", 0).when(S.archive_type(F.col("path")).isNotNull(), 1).otherwise(2)
    text = entries.schema[column].dataType.simpleString() == "string"
    value = F.lower(F.coalesce(column, F.lit(""))) if text else F.coalesce(F.col(column), F.lit(0))
    keys = [value, F.lower("path"), F.col("path")]
    order = [rank.asc(), *[k.desc() if descending else k.asc() for k in keys]]
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("archive_id").orderBy(*order)))


def restore_order(entries: DataFrame) -> DataFrame:
    """archive_id, path, depth of directories; times are set from the greatest depth up, so that writing into a folder comes before."""
    depth = F.size(F.split("path", "/"))
    return entries.where("kind = 'dir'").select("archive_id", "path", depth.alias("depth")).orderBy("archive_id", F.desc("depth"), "path")


def hard_link_targets(entries: DataFrame) -> DataFrame:
    """Each hard link with the file it stands for: ord, size and digest of the target, and dangling where there is none."""
    files = entries.where("kind = 'file'").select("archive_id", F.col("path").alias("link_target"), F.col("ord").alias("file_ord"), F.col("size").alias("file_size"), F.col("digest").alias("file_digest"))
    links = entries.where("kind = 'hardlink'").select(*KEY, "link_target").join(files, ["archive_id", "link_target"], "left")
    return links.select(*KEY, "link_target", "file_ord", "file_size", "file_digest", F.col("file_ord").isNull().alias("dangling"))


def with_parents(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths (archive_id, path) of the selected subtrees with every folder above them, each once."""
    chosen = _touched(entries, targets)
    above = chosen.select("archive_id", F.explode(S.ancestors(F.col("path"))).alias("path"))
    return chosen.unionByName(above).distinct()


def first_scan(items: DataFrame, keys: list[str], root: str) -> DataFrame:
    """One row for each key of overlapping input roots: that of the smallest root."""
    rest = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.min(F.struct(root, *[c for c in rest if c != root])).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
