"""The archive folder's verbs and the published progress stream."""

import pytest
from pyspark.sql import functions as F

from cairn.archive import Archive
from cairn.streaming import progress as P


def content(spark, rows):
    return spark.createDataFrame(rows, "path string, data binary, mtime long")


def plain(a, paths=None):
    out = {}
    for r in a.read(paths).orderBy("path", "block_no").collect():
        assert r.status == "ok"
        out[r.path] = out.get(r.path, b"") + bytes(r.data)
    return out


def test_verbs(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "x"), block=16)
    a.update(content(spark, [("n", b"1", 1)]), fresh_only=True)
    assert a._versions() == []
    a.add(content(spark, [("d/a", b"A" * 40, 10), ("d/b", b"B", 10), ("e", b"", 10), ("copy", b"A" * 40, 10)]))
    assert plain(a) == {"d/a": b"A" * 40, "d/b": b"B", "e": b"", "copy": b"A" * 40}
    assert a.blocks().count() == 4
    a.update(content(spark, [("d/a", b"new", 11), ("d/b", b"old", 10), ("f", b"F", 1)]))
    assert plain(a) == {"d/a": b"new", "d/b": b"B", "e": b"", "copy": b"A" * 40, "f": b"F"}
    a.move({"d": "q/d"})
    assert plain(a, ["q"]) == {"q/d/a": b"new", "q/d/b": b"B"}
    with pytest.raises(KeyError):
        a.delete(["nothing"])
    with pytest.raises(ValueError):
        a.move({"f": "e"})
    with pytest.raises(ValueError):
        a.add(content(spark, [("../up", b"", 1)]))
    a.delete(["copy"])
    before = a.blocks().count()
    a.repack()
    assert a.blocks().count() == before - 3 and a.test().count() == 0
    a.sync(content(spark, [("f", b"F", 1), ("g", b"G", 1)]))
    assert plain(a) == {"f": b"F", "g": b"G"}
    assert {r.path: (r.size, r.packed) for r in a.list().collect()} == {"f": (1, 1), "g": (1, 1)}
    a.extract(str(tmp_path / "out"))
    assert (tmp_path / "out" / "g").read_bytes() == b"G"
    with pytest.raises(Exception, match="FileExistsError"):
        a.extract(str(tmp_path / "out"))
    a.extract(str(tmp_path / "out"), ["g"], overwrite="skip")
    a.comment("hello")
    assert a._meta()["comment"] == "hello"
    a.lock()
    with pytest.raises(PermissionError):
        a.delete(["f"])


def test_damage_is_found(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "y"), block=8)
    a.add(content(spark, [("p", b"0123456789", 1), ("q", b"zz", 1)]))
    part = a._meta()["parts"][0]
    rows = a.blocks().where("block_no = 0").withColumn("data", F.when(F.col("usize") == 2, F.lit(b"zy")).otherwise(F.col("data"))).collect()
    spark.createDataFrame(rows, a.blocks().schema).write.mode("overwrite").parquet(f"{a.root}/blocks/{part}")
    assert {r.path: r.status for r in a.test().collect()} == {"p": "missing block", "q": "bad crc"}


def test_published_stream(spark, tmp_path):
    mb = 1 << 20
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def send(*rows):
        spark.createDataFrame([("o", *r, None) for r in rows], P.EVENT).coalesce(1).write.mode("append").json(source)
        s = spark.readStream.schema(P.EVENT).json(source)
        q = P.published(s, expire=None).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    send((1, "reading", 10 * mb, 1, 0, 0), (2, "reading", 10 * mb, 1, 100, 0), (3, "reading", 10 * mb, 1, mb, 0), (4, "compressing", 10 * mb, 1, 5, 0))
    send((5, "compressing", 10 * mb, 1, 7, 0), (6, "compressing", 10 * mb, 1, 10 * mb, 0), (7, "reading", 3, 1, 1, 0))
    got = [(r.seq, r.stage, r.done_bytes) for r in spark.read.parquet(sink).orderBy("seq").collect()]
    assert got == [(1, "reading", 0), (3, "reading", mb), (4, "compressing", mb), (6, "compressing", 10 * mb), (7, "reading", 1)]
