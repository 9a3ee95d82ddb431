"""Archive catalogs and directory trees as Python data sources: zip_catalog, tar_catalog, iso_catalog and fstree.

spark.read.format("zip_catalog").load(folder_or_file). One partition for each archive; of a ZIP only the end and its central directory are
read, of a TAR the headers, of an ISO image the directory records. Paths may name any file system that pyarrow knows.
"""

from __future__ import annotations

import calendar
import os
import struct
import tarfile
import zipfile
from collections import deque
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CATALOG = "archive string, path string, kind string, size long, csize long, mtime long, crc long, method int, encrypted boolean, offset long, link_target string"
TREE = "path string, kind string, size long, mtime long, link_target string"

#: Directory records read from one ISO image at most; more is an error, never a cut listing.
ISO_ENTRIES = 1_000_000


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or the files under a folder with one of the suffixes, sorted."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def zip_rows(archive: str, stream) -> Iterator[tuple]:
    """Records of the central directory in their order; CRC is null where the encryption leaves it out (AE-2)."""
    with zipfile.ZipFile(stream) as z:
        for i in z.infolist():
            mode = i.external_attr >> 16
            link = (mode & 0o170000) == 0o120000
            kind = "directory" if i.is_dir() else "symlink" if link else "file"
            when = calendar.timegm((*i.date_time, 0, 0, 0))
            no_crc = i.compress_type == 99 and _ae2(i.extra)
            target = z.read(i).decode("utf-8", "replace") if link and not i.flag_bits & 1 else None
            yield archive, i.filename.rstrip("/"), kind, i.file_size, i.compress_size, when, None if no_crc else i.CRC, i.compress_type, bool(i.flag_bits & 1), i.header_offset, target


def _ae2(extra: bytes) -> bool:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 0x9901 and size >= 7:
            return struct.unpack_from("<H", extra, at + 4)[0] == 2
        at += 4 + size
    return False


def tar_rows(archive: str, stream) -> Iterator[tuple]:
    """Members of a TAR, plain or compressed, in their order."""
    with tarfile.open(fileobj=stream, mode="r:*") as t:
        for m in t:
            kind = "directory" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isfile() else "other"
            yield archive, m.name.rstrip("/"), kind, m.size if kind == "file" else 0, None, int(m.mtime), None, 0, False, m.offset_data, m.linkname or None


def iso_time(b: bytes) -> int:
    """Seconds of a seven-byte recording time; 0 before 1970 or without month or day."""
    year = 1900 + b[0]
    if year < 1970 or not b[1] or not b[2]:
        return 0
    quarters = b[6] - 256 if b[6] > 127 else b[6]
    return calendar.timegm((year, b[1], b[2], b[3], b[4], b[5], 0, 0, 0)) - quarters * 900


def iso_name(name: str) -> str:
    stem, mark, version = name.rpartition(";")
    return (stem if mark and version.isascii() and version.isdigit() else name).rstrip(".")


def iso_rows(archive: str, stream) -> Iterator[tuple]:
    """Breadth-first walk over the directory records; the Joliet tree where there is one. A directory is read once."""

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)

    root = joliet = None
    sector = 16
    while True:
        d = read(sector * 2048, 2048)
        if len(d) < 2048 or d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] == 1 and root is None:
            root = d
        if d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
        sector += 1
    top = joliet or root
    if top is None:
        raise ValueError(f"{archive}: no volume descriptor")
    block = struct.unpack_from("<H", top, 128)[0]
    where, size = struct.unpack_from("<I4xI", top, 158)
    todo, seen, n = deque([("", where, size)]), {where}, 0
    while todo:
        parent, where, size = todo.popleft()
        data = read(where * block, size)
        at = 0
        while at < len(data):
            length = data[at]
            if not length:
                at = (at // 2048 + 1) * 2048
                continue
            r = data[at : at + length]
            at += length
            raw = r[33 : 33 + r[32]]
            if raw in (b"\0", b"\1"):
                continue
            name = iso_name(raw.decode("utf-16-be" if joliet else "latin-1", "replace"))
            path = f"{parent}/{name}" if parent else name
            extent, bytes_ = struct.unpack_from("<I4xI", r, 2)
            is_dir = bool(r[25] & 2)
            n += 1
            if n > ISO_ENTRIES:
                raise ValueError(f"{archive}: more than {ISO_ENTRIES} entries")
            yield archive, path, "directory" if is_dir else "file", 0 if is_dir else bytes_, None if is_dir else bytes_, iso_time(r[18:25]), None, 0, False, extent * block, None
            if is_dir and extent not in seen:
                seen.add(extent)
                todo.append((path, extent, bytes_))


class _CatalogReader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...], rows):
        self.path, self.suffixes, self.rows = path, suffixes, rows

    def partitions(self):
        return [Part(p) for p in _files(self.path, self.suffixes)]

    def read(self, partition):
        if partition is None or not isinstance(partition, Part):
            return
        with _open(partition.path) as stream:
            yield from self.rows(partition.path, stream)


class _Catalog(DataSource):
    suffixes: tuple[str, ...] = ()
    rows = None

    def schema(self):
        return CATALOG

    def reader(self, schema):
        return _CatalogReader(self.options["path"], self.suffixes, type(self).rows)


class ZipCatalog(_Catalog):
    suffixes = (".zip", ".jar", ".war", ".apk")
    rows = staticmethod(zip_rows)

    @classmethod
    def name(cls):
        return "zip_catalog"


class TarCatalog(_Catalog):
    suffixes = (".tar", ".tar.gz", ".tgz", ".tar.xz", ".txz", ".tar.bz2", ".tbz2")
    rows = staticmethod(tar_rows)

    @classmethod
    def name(cls):
        return "tar_catalog"


class IsoCatalog(_Catalog):
    suffixes = (".iso",)
    rows = staticmethod(iso_rows)

    @classmethod
    def name(cls):
        return "iso_catalog"


class _TreeReader(DataSourceReader):
    """One partition for each child of the folder; links are rows and never followed, special files are left out."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        if not os.path.lexists(self.path):
            raise FileNotFoundError(self.path)
        if os.path.islink(self.path) or not os.path.isdir(self.path):
            return [Part(self.path)]
        return [Part(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path))]

    def read(self, partition):
        base = os.path.dirname(self.path.rstrip("/"))
        todo = [partition.path] if isinstance(partition, Part) else []
        while todo:
            p = todo.pop()
            s = os.lstat(p)
            name = os.path.relpath(p, base).replace(os.sep, "/")
            if os.path.islink(p):
                yield name, "symlink", 0, int(s.st_mtime), os.readlink(p)
            elif os.path.isdir(p):
                yield name, "directory", 0, int(s.st_mtime), None
                todo += [os.path.join(p, n) for n in os.listdir(p)]
            elif os.path.isfile(p):
                yield name, "file", s.st_size, int(s.st_mtime), None


class FsTree(DataSource):
    @classmethod
    def name(cls):
        return "fstree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return _TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ZipCatalog, TarCatalog, IsoCatalog, FsTree):
        spark.dataSource.register(source)
