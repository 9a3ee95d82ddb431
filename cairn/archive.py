"""An archive as a folder of Parquet tables with the verbs add, update, sync, delete, move, repack, read, extract and test."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import catalog as C
from cairn.operators import codec as K

ENTRIES = ["path", "ord", "kind", "size", "mtime", "digest", "link_target"]


class Archive:
    """Blocks are stored once for each content (digest) and only ever appended; a version names the block parts it uses.

    Every edit writes a new version beside the old ones and counts from the moment its last table is complete, so that a lost job leaves the
    archive as it was. Contents come as rows (path, data, mtime) of files; kind and link_target are optional.
    """

    def __init__(self, spark: SparkSession, root: str, block: int = 1 << 20, level: int = 6):
        self.spark, self.root, self.block, self.level = spark, root.rstrip("/"), block, level

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = lambda p: system.exists(jvm.org.apache.hadoop.fs.Path(p, "meta/_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in system.listStatus(path) if done(s.getPath()))

    def _meta(self) -> dict:
        v = self._versions()
        if not v:
            return {"version": 0, "parts": [], "comment": None, "locked": False}
        return self.spark.read.parquet(f"{self.root}/versions/{v[-1]}/meta").first().asDict() | {"version": v[-1]}

    def entries(self) -> DataFrame:
        v = self._meta()["version"]
        if not v:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/versions/{v}/entries").withColumn("archive_id", F.lit("a"))

    def blocks(self, parts: list[str] | None = None) -> DataFrame:
        """(digest, block_no, data, codec, usize, csize, crc)"""
        parts = self._meta()["parts"] if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], "digest string, block_no int, data binary, codec string, usize long, csize long, crc long")
        return self.spark.read.parquet(*[f"{self.root}/blocks/{p}" for p in parts])

    def _open(self) -> dict:
        meta = self._meta()
        if meta["locked"]:
            raise PermissionError(f"{self.root} is locked")
        return meta

    def _commit(self, meta: dict, entries: DataFrame, **changes) -> None:
        meta = meta | changes | {"version": meta["version"] + 1}
        to = f"{self.root}/versions/{meta['version']}"
        entries.select(ENTRIES).write.mode("overwrite").parquet(f"{to}/entries")
        row = [(meta["parts"], meta["comment"], meta["locked"])]
        self.spark.createDataFrame(row, "parts array<string>, comment string, locked boolean").coalesce(1).write.mode("overwrite").parquet(f"{to}/meta")

    def _rows(self, content: DataFrame, start: int = 0) -> DataFrame:
        has = set(content.columns)
        kind = F.col("kind") if "kind" in has else F.lit("file")
        is_file = kind == "file"
        data = F.coalesce(F.col("data"), F.lit(b""))
        if (bad := content.where(S.strict_path(F.col("path")).isNull()).select("path").first()) is not None:
            raise ValueError(f"path {bad.path!r}")
        return content.select(
            F.lit("a").alias("archive_id"), S.strict_path(F.col("path")).alias("path"), (F.lit(start) + F.monotonically_increasing_id()).alias("ord"), kind.alias("kind"),
            F.when(is_file, F.octet_length(data)).otherwise(0).cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), F.when(is_file, F.sha2(data, 256)).alias("digest"),
            (F.col("link_target") if "link_target" in has else F.lit(None).cast("string")).alias("link_target"), F.when(is_file, data).alias("data"),
        )

    def _store(self, meta: dict, rows: DataFrame) -> list[str]:
        """Appends the contents that no block part holds yet."""
        have = self.blocks(meta["parts"]).select("digest").distinct()
        fresh = rows.where("kind = 'file'").select("digest", "data").join(have, "digest", "left_anti").dropDuplicates(["digest"])
        part = uuid.uuid4().hex
        K.compress_blocks(K.split_blocks(fresh, "digest", "data", self.block), level=self.level).write.parquet(f"{self.root}/blocks/{part}")
        return [*meta["parts"], part]

    def _next(self, meta: dict) -> int:
        return (self.entries().agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1) if meta["version"] else 0

    def _merge(self, content: DataFrame, how) -> None:
        meta = self._open()
        new = self._rows(content, self._next(meta))
        old = self.entries() if meta["version"] else None
        if old is None:
            old = new.where("false").drop("data")
        merged = how(old.select("archive_id", *ENTRIES), new.select("archive_id", *ENTRIES))
        if (bad := C.map_violations(old, new).first()) is not None:
            raise ValueError(f"{bad.path}: {bad.rule}")
        stored = merged.select("digest").distinct()
        parts = self._store(meta, new.join(stored, "digest", "left_semi"))
        self._commit(meta, merged, parts=parts)

    def add(self, content: DataFrame) -> None:
        self._merge(content, C.upsert)

    def update(self, content: DataFrame, fresh_only: bool = False) -> None:
        """Adds new paths and files that are newer; fresh_only takes newer files alone, and does nothing where no archive is."""
        if fresh_only and not self._versions():
            return
        self._merge(content, lambda old, new: C.update(old, new, fresh_only))

    def sync(self, content: DataFrame) -> None:
        self._merge(content, C.sync)

    def _targets(self, paths: list[str], column: str = "target") -> DataFrame:
        return self.spark.createDataFrame([("a", p) for p in paths], f"archive_id string, {column} string")

    def _wanted(self, paths: list[str]) -> DataFrame:
        targets = self._targets(paths)
        if (lost := C.unmatched(self.entries(), targets).first()) is not None:
            raise KeyError(lost.target)
        return targets

    def delete(self, paths: list[str]) -> None:
        meta = self._open()
        self._commit(meta, C.delete(self.entries(), self._wanted(paths)))

    def move(self, moves: dict[str, str]) -> None:
        meta = self._open()
        rows = self.spark.createDataFrame([("a", s, d) for s, d in moves.items()], "archive_id string, src string, dest string")
        if (bad := C.move_violations(self.entries(), rows).first()) is not None:
            raise ValueError(f"{bad.path}: {bad.rule}")
        self._commit(meta, C.move(self.entries(), rows))

    def repack(self) -> None:
        """Writes the blocks of live contents into one new part; what no entry uses stays behind."""
        meta = self._open()
        live = self.entries().select("digest").where("digest is not null").distinct()
        part = uuid.uuid4().hex
        self.blocks().join(live, "digest", "left_semi").write.parquet(f"{self.root}/blocks/{part}")
        self._commit(meta, self.entries(), parts=[part])

    def comment(self, text: str | None) -> None:
        self._commit(self._open(), self.entries(), comment=text or None)

    def lock(self) -> None:
        self._commit(self._open(), self.entries(), locked=True)

    def list(self) -> DataFrame:
        """Entries with packed: the sum of their blocks' coded bytes, null for other kinds than files."""
        packed = self.blocks().groupBy("digest").agg(F.sum("csize").alias("packed"))
        return self.entries().join(packed, "digest", "left").withColumn("packed", F.when(F.col("kind") == "file", F.coalesce("packed", F.lit(0)))).select(*ENTRIES, "packed")

    def read(self, paths: list[str] | None = None) -> DataFrame:
        """(path, block_no, data, status) of the chosen files; an empty file has one row of no bytes."""
        rows = self.entries() if paths is None else C.select(self.entries(), self._wanted(paths))
        rows = rows.where("kind = 'file'").select("path", "digest", "size")
        full = rows.where("size > 0").join(self.blocks(), "digest").select("path", "block_no", "data", "codec", "usize", "crc")
        return K.decompress_blocks(full).select("path", "block_no", "data", "status").unionByName(
            rows.where("size = 0").select("path", F.lit(0).alias("block_no"), F.lit(b"").alias("data"), F.lit("ok").alias("status"))
        )

    def test(self) -> DataFrame:
        """(path, status) of every file with a damaged or missing block."""
        seen = self.read().groupBy("path").agg(F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("bad"), F.sum(F.octet_length("data")).alias("n"))
        both = self.entries().where("kind = 'file'").select("path", "size").join(seen, "path", "left")
        state = F.coalesce("bad", F.when(F.coalesce("n", F.lit(-1)) != F.col("size"), "missing block"))
        return both.select("path", state.alias("status")).where("status is not null")

    def extract(self, dest: str, paths: list[str] | None = None, overwrite: str = "fail") -> None:
        """Writes files under a folder that all executors see, block by block; overwrite is fail, skip or all. Damage is an error."""
        if overwrite not in ("fail", "skip", "all"):
            raise ValueError(overwrite)
        dest = dest.rstrip("/")

        def write(rows):
            system, root = fs.FileSystem.from_uri(dest) if "://" in dest else (fs.LocalFileSystem(), dest)
            now, out = None, None
            for r in rows:
                if r.status != "ok":
                    raise OSError(f"{r.path}: {r.status}")
                if r.path != now:
                    if out:
                        out.close()
                    now, out, to = r.path, None, f"{root}/{r.path}"
                    if overwrite != "all" and system.get_file_info(to).type != fs.FileType.NotFound:
                        if overwrite == "fail":
                            raise FileExistsError(to)
                        continue
                    system.create_dir(to.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(to)
                if out:
                    out.write(r.data)
            if out:
                out.close()

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.read(paths).repartition(n, "path").sortWithinPartitions("path", "block_no").foreachPartition(write)
