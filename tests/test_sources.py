"""Archive data sources and listing parsers on small archives made here."""

import io
import os
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.sources import archives, listings


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    archives.register(spark)
    d = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(d / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("dir/", (2020, 1, 2, 3, 4, 6)), "")
        z.writestr(zipfile.ZipInfo("dir/x.txt", (2020, 1, 2, 3, 4, 6)), "hello " * 50)
        z.writestr("empty", "")
    with tarfile.open(d / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("p/q")
        info.size, info.mtime = 5, 77
        t.addfile(info, io.BytesIO(b"12345"))
        link = tarfile.TarInfo("p/l")
        link.type, link.linkname = tarfile.SYMTYPE, "q"
        t.addfile(link)
    (d / "c.iso").write_bytes(iso_image())
    return d


def iso_image():
    def record(name, extent, size, is_dir):
        n = 33 + len(name) + (1 - len(name) % 2)
        r = bytearray(n)
        r[0] = n
        struct.pack_into("<I", r, 2, extent)
        struct.pack_into("<I", r, 10, size)
        r[18:25] = bytes([100, 2, 3, 4, 5, 6, 4])
        r[25] = 2 if is_dir else 0
        r[32] = len(name)
        r[33 : 33 + len(name)] = name
        return bytes(r)

    pvd = bytearray(2048)
    pvd[0], pvd[1:6] = 1, b"CD001"
    struct.pack_into("<H", pvd, 128, 2048)
    pvd[156:190] = record(b"\0", 18, 2048, True)
    end = bytearray(2048)
    end[0], end[1:6] = 255, b"CD001"
    dots = lambda a, b: record(b"\0", a, 2048, True) + record(b"\1", b, 2048, True)
    root = dots(18, 18) + record(b"SUB", 19, 2048, True) + record(b"README.TXT;1", 20, 9, False)
    sub = dots(19, 18) + record(b"F.;2", 21, 3, False) + record(b"LOOP", 18, 2048, True)
    pad = lambda b: bytes(b).ljust(2048, b"\0")
    return bytes(16 * 2048) + pad(pvd) + pad(end) + pad(root) + pad(sub) + pad(b"x" * 9) + pad(b"abc")


def test_zip_catalog(spark, folder):
    rows = {r.path: r for r in spark.read.format("zip_catalog").load(str(folder)).collect()}
    assert {p: (r.kind, r.size) for p, r in rows.items()} == {"dir": ("directory", 0), "dir/x.txt": ("file", 300), "empty": ("file", 0)}
    assert rows["dir/x.txt"].mtime == 1577934246 and rows["dir/x.txt"].csize > 0 and not rows["dir/x.txt"].encrypted


def test_tar_catalog(spark, folder):
    rows = spark.read.format("tar_catalog").load(str(folder)).collect()
    assert [(r.path, r.kind, r.size, r.link_target) for r in rows] == [("p/q", "file", 5, None), ("p/l", "symlink", 0, "q")]
    assert rows[0].mtime == 77


def test_iso_catalog_reads_a_directory_once(spark, folder):
    rows = spark.read.format("iso_catalog").load(f"{folder}/c.iso").collect()
    assert [(r.path, r.kind, r.size) for r in rows] == [("SUB", "directory", 0), ("README.TXT", "file", 9), ("SUB/F", "file", 3), ("SUB/LOOP", "directory", 0)]
    assert rows[1].mtime == 949550706 - 3600  # 2000-02-03 04:05:06, one hour east


def test_fstree(spark, tmp_path, folder):
    os.makedirs(tmp_path / "t" / "a" / "b")
    (tmp_path / "t" / "a" / "f").write_text("xy")
    os.symlink("f", tmp_path / "t" / "a" / "l")
    rows = spark.read.format("fstree").load(str(tmp_path / "t")).collect()
    assert {(r.path, r.kind, r.size, r.link_target) for r in rows} == {("t/a", "directory", 0, None), ("t/a/b", "directory", 0, None), ("t/a/f", "file", 2, None), ("t/a/l", "symlink", 0, "f")}


def test_formats_by_magic(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder)).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), S.archive_format(F.col("content")).alias("f"))
    assert {r.name: r.f for r in files.collect()} == {"a.zip": "zip", "b.tar.gz": None, "c.iso": "iso"}
    wrapped = b"MZ" + b"\0" * 100 + (folder / "a.zip").read_bytes()
    odd = b"MZ" + b"\x05\x04\xb0\x50\x60" * 9
    rows = spark.createDataFrame([(1, wrapped), (2, odd), (3, b""), (4, None)], "i int, c binary").select("i", S.archive_format(F.col("c")).alias("f")).collect()
    assert {r.i: r.f for r in rows} == {1: "zip", 2: None, 3: None, 4: None}


def test_key_value_listing(spark):
    text = ["Path = outer.7z", "----------", "Path = a\\b.txt", "Size = 12", "Packed Size = 7", "CRC = 0000FFFF", "Encrypted = -", "", "Path = a", "Folder = +", "Size = ", "CRC = ", "junk"]
    lines = spark.createDataFrame([("l", i, t + "\r") for i, t in enumerate(text)], "listing string, line_no int, line string")
    rows = {r.path: r for r in listings.key_value_listing(lines).collect()}
    assert set(rows) == {"a/b.txt", "a"}
    assert (rows["a/b.txt"].size, rows["a/b.txt"].packed, rows["a/b.txt"].crc, rows["a/b.txt"].kind) == (12, 7, 65535, "file")
    assert (rows["a"].size, rows["a"].packed, rows["a"].crc, rows["a"].kind) == (0, None, None, "directory")


def test_verbose_listing(spark):
    text = ["-rw-r--r--  0 u g  12 Jan 1 2020 a b.txt", "drwxr-xr-x 0 u g 0 Jan 1 2020 d/", "lrwxrwxrwx 0 u g 0 Jan 1 2020 l -> a b.txt", "short line", "-rw 0 u g x Jan 1 2020 z"]
    rows = listings.verbose_listing(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, line string")).orderBy("i").collect()
    assert [(r.path, r.kind, r.size, r.link_target) for r in rows] == [("a b.txt", "file", 12, None), ("d", "directory", 0, None), ("l", "symlink", 0, "a b.txt"), ("z", "file", 0, None)]
