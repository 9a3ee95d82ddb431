"""Known answers and edge cases of the engine's own operators."""

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import bytes as Y
from cairn.operators import catalog as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_crc_known_answer(spark):
    assert one(spark, F.crc32(F.lit("123456789").cast("binary"))) == 3421780262


def test_sizes_and_versions(spark):
    assert [one(spark, S.size_text(F.lit(n))) for n in (0, 1023, 1024, 1280, 1 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 GB"]
    assert [one(spark, S.parse_size(F.lit(t))) for t in ("12", "3k", "2G", "x")] == [12, 3072, 2 << 30, None]
    assert [one(spark, S.compare_versions(F.lit(a), F.lit(b))) for a, b in (("1.2", "1.2.0"), ("1.2", "1.10"), ("v2", "1.9"), ("x", "1"))] == [0, -1, 1, 0]
    assert [one(spark, S.varint_size(F.lit(n).cast("long"))) for n in (0, 127, 128, 1 << 14)] == [1, 1, 2, 3]
    assert [one(spark, S.radical_inverse(F.lit(n).cast("long"))) for n in (0, 1, 2, 3)] == [0.0, 0.5, 0.25, 0.75]


def test_gf_multiplication(spark):
    def slow(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = (a << 1) ^ (0x11D if a & 0x80 else 0), b >> 1
        return out

    pairs = [(a, b) for a in (0, 1, 2, 3, 29, 128, 255) for b in (0, 1, 7, 142, 255)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", Y.gf_mul(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.c == slow(r.a, r.b) for r in rows)


def test_delete_takes_subtrees_and_dangling_links(spark):
    rows = [("x", "a/b", "file", None), ("x", "ab", "file", None), ("x", "l1", "hardlink", "a/b"), ("x", "l2", "hardlink", "ab")]
    e = spark.createDataFrame(rows, "archive_id string, path string, kind string, link_target string")
    kept = C.delete(e, spark.createDataFrame([("x", "a")], "archive_id string, target string")).collect()
    assert sorted(r.path for r in kept) == ["ab", "l2"]


def test_update_is_strict_and_sync_mirrors(spark):
    kinds = "archive_id string, path string, kind string, mtime long"
    old = spark.createDataFrame([("x", "same", "file", 5), ("x", "older", "file", 5), ("x", "gone", "file", 5), ("x", "dir", "directory", 5)], kinds)
    new = spark.createDataFrame([("x", "same", "file", 5), ("x", "older", "file", 6), ("x", "add", "file", 1), ("x", "dir", "directory", 9)], kinds)
    assert {r.path: r.action for r in C.update_actions(old, new).collect()} == {"same": "keep", "older": "replace", "gone": "delete", "add": "add", "dir": "keep"}
    assert {(r.path, r.mtime) for r in C.sync(old, new).collect()} == {("same", 5), ("older", 6), ("add", 1), ("dir", 5)}


def test_entropy_of_nothing_and_of_two_symbols(spark):
    df = spark.createDataFrame([(1, bytearray(b"abab")), (2, bytearray(b""))], "k int, d binary")
    assert [(r.k, r.bits) for r in Y.entropy(Y.byte_counts(df, "k", "d"), "k").collect()] == [(1, 1.0)]


def test_slots_and_value_codes(spark):
    def slot(d):
        p = d - 1
        if p < 4:
            return p, 0, 0
        n = p.bit_length() - 1
        s = 2 * n + ((p >> (n - 1)) & 1)
        return s, n - 1, p - ((2 + s % 2) << (n - 1))

    ds = [*range(1, 200), 65535, 65536, 65537, (1 << 24) + 5, (1 << 32) - 1]
    d = spark.createDataFrame([(x,) for x in ds], "d long").select("d", S.distance_slot(F.col("d")).alias("s"), S.value_code(F.col("d")).alias("v"))
    d = d.withColumn("back", S.slot_distance(F.col("s.slot"), F.col("s.value")))
    for r in d.collect():
        assert tuple(r.s) == slot(r.d) and r.back == r.d
        n = r.d.bit_length() - 1
        assert tuple(r.v) == ((r.d, 0, 0) if r.d < 16 else (12 + n, n, r.d - (1 << n)))


def test_names_and_parsers(spark):
    classes = [one(spark, S.type_class(F.lit(p))) for p in ("a.md", "A.EXE", "x.wav", "x", "x.bin", "x.ZIP")]
    assert classes == [1, 2, 3, 4, 4, 5]
    assert [one(spark, S.archive_type(F.lit(p))) for p in ("a.tar.gz", "a.TGZ", "a.part1.rar", "a.r07", "a.gz")] == ["TAR archive", "TAR archive", "RAR archive", "RAR archive", None]
    assert [one(spark, S.strict_path(F.lit(p))) for p in ("a\\b", "a//b", "/a", "a/", "a/../b", "a/./b", "C:x", "..x/y", "")] == ["a/b", None, None, None, None, None, None, "..x/y", None]
    assert [one(spark, S.strip_version(F.lit(p))) for p in ("A.TXT;1", "B.;12", "C;x")] == ["A.TXT", "B", "C;x"]
    assert [one(spark, S.octal_number(F.lit(p))) for p in ("0000644\0", " 17 ", "8", "")] == [420, 15, None, None]
    assert [one(spark, S.last_percent(F.lit(p))) for p in ("1% x 42%", "none", "101%")] == [42, None, None]
    assert one(spark, S.attribute_letters(F.lit(0x25))) == "RSA"
    assert [one(spark, S.count_text(F.lit(n), "file", "files")) for n in (1, 12345)] == ["1 file", "12,345 files"]


def test_varints_come_back(spark):
    def plain(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    ns = [0, 1, 127, 128, 300, 16383, 16384, (1 << 56) - 1, 1 << 56, (1 << 63) - 1, -1, None]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", S.varint(F.col("n")).alias("v")).withColumn("back", S.varint_value(F.col("v"))).collect()
    for r in rows:
        assert r.back == r.n and (r.v is None if r.n is None else bytes(r.v) == plain(r.n % (1 << 64)))
    data = [bytearray(b""), bytearray(b"\x80"), bytearray(b"\xff" * 10 + b"\x01"), bytearray(b"\x05\xff\xff"), bytearray(b"\x80\x00"), None]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").select("i", S.varint_value(F.col("d")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {0: None, 1: None, 2: None, 3: 5, 4: 0, 5: None}
