"""Text listings of archive tools as entries, in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_value_listing(lines: DataFrame) -> DataFrame:
    """Records of "key = value" lines (listing, line_no, line): those after the dashes, a new one at each Path.

    Returns listing, path, size, packed, crc, encrypted, kind. Lines without " = " and those before the first Path count for nothing.
    """
    w = Window.partitionBy("listing").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = F.regexp_replace("line", r"\r+$", "")
    begun = F.max(F.trim(text) == "----------").over(w)
    rows = lines.withColumn("line", text).withColumn("begun", begun).where("begun and contains(line, ' = ')")
    at = F.instr("line", " = ")
    rows = rows.select("listing", "line_no", F.trim(F.expr("left(line, instr(line, ' = ') - 1)")).alias("key"), F.substring("line", at + 3, F.length("line")).alias("value"))
    rows = rows.withColumn("record", F.sum((F.col("key") == "Path").cast("int")).over(w)).where("record > 0")
    get = lambda k: F.max_by("value", F.when(F.col("key") == k, F.col("line_no")))
    r = rows.groupBy("listing", "record").agg(*[get(k).alias(k) for k in ("Path", "Size", "Packed Size", "CRC", "Encrypted", "Folder", "Attributes")])
    folder = (F.coalesce("Folder", F.lit("")) == "+") | F.startswith(F.coalesce("Attributes", F.lit("")), F.lit("D"))
    return r.select(
        "listing", F.translate("Path", "\\", "/").alias("path"), F.coalesce(F.col("Size").try_cast("long"), F.lit(0)).alias("size"), F.col("Packed Size").try_cast("long").alias("packed"),
        F.when(F.col("CRC").rlike("^[0-9A-Fa-f]{1,8}$"), F.conv("CRC", 16, 10).cast("long")).alias("crc"), (F.coalesce("Encrypted", F.lit("-")) == "+").alias("encrypted"),
        F.when(folder, "directory").otherwise("file").alias("kind"),
    )


def verbose_listing(lines: DataFrame) -> DataFrame:
    """Eight fields and a path a line, as tar prints them: path, kind, size, link_target; lines of another shape are left out."""
    shape = r"^\s*(\S+)\s+\S+\s+\S+\s+\S+\s+(\S+)\s+\S+\s+\S+\s+\S+\s+(.*\S)\s*$"
    part = lambda i: F.regexp_extract("line", shape, i)
    rows = lines.where(F.col("line").rlike(shape)).select(*[c for c in lines.columns if c != "line"], part(1).alias("mode"), part(2).alias("n"), part(3).alias("whole"))
    link = F.startswith("mode", F.lit("l"))
    cut = link & F.contains("whole", F.lit(" -> "))
    raw = F.when(cut, F.expr("left(whole, instr(whole, ' -> ') - 1)")).otherwise(F.col("whole"))
    path = F.when(F.length(raw) > 1, F.regexp_replace(raw, "(?<=.)/+$", "")).otherwise(raw)
    kind = F.when(F.startswith("mode", F.lit("d")) | (path != raw), "directory").when(link, "symlink").otherwise("file")
    return rows.select(
        *[c for c in rows.columns if c not in ("mode", "n", "whole")], path.alias("path"), kind.alias("kind"), F.coalesce(F.regexp_extract("n", r"^\d+", 0).try_cast("long"), F.lit(0)).alias("size"),
        F.when(cut, F.expr("substring(whole, instr(whole, ' -> ') + 4)")).alias("link_target"),
    )
