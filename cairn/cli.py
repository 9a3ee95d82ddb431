"""The archive's verbs as commands: python -m cairn VERB ARCHIVE ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.archive import Archive
from cairn.functions import scalars as S
from cairn.sources import archives

OK, FAILED = 0, 1  # exit codes


def tree_content(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, mtime, link_target, data) of a folder or file that all executors see; paths begin with its own name.

    Each file is read where its row is, one file at a time. Links are rows and are never followed.
    """
    archives.register(spark)
    base = folder.removeprefix("file://").rstrip("/").rpartition("/")[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select(["path", "kind"]).to_pylist()):
                data = None
                if row["kind"] == "file":
                    with open(f"{base}/{row['path']}" if base or folder.startswith("/") else row["path"], "rb") as f:
                        data = f.read()
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([data], pa.binary())], names=[*b.schema.names, "data"])

    rows = spark.read.format("fstree").load(folder).select("path", "kind", F.col("mtime").cast("long").alias("mtime"), "link_target")
    return rows.mapInArrow(read, "path string, kind string, mtime long, link_target string, data binary")


def inputs(spark: SparkSession, folders: list[str]) -> DataFrame:
    out = tree_content(spark, folders[0])
    for f in folders[1:]:
        out = out.unionByName(tree_content(spark, f))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=text)
        v.add_argument("archive")
        return v

    for name, text in (
        ("add", "add inputs; a path that is there is replaced"), ("update", "add new paths and newer files"), ("fresh", "take newer files alone"),
        ("sync", "update, and delete what the inputs lack"),
    ):
        v = verb(name, text)
        v.add_argument("inputs", nargs="+")
        v.add_argument("--level", type=int, default=6)
        v.add_argument("--block", default="1M", help="bytes, with K, M or G")
    verb("delete", "delete paths with their subtrees").add_argument("paths", nargs="+")
    v = verb("move", "move a path with its subtree")
    v.add_argument("src")
    v.add_argument("dest")
    verb("repack", "write live blocks anew")
    verb("list", "entries with packed sizes")
    v = verb("extract", "write files under a folder that all executors see")
    v.add_argument("dest")
    v.add_argument("paths", nargs="*")
    v.add_argument("--overwrite", choices=("fail", "skip", "all"), default="fail")
    verb("test", "check every file; exit code 1 when one is damaged")
    verb("comment", "set the comment, or clear it").add_argument("text", nargs="?")
    verb("lock", "refuse every later edit")
    return p


def size_of(spark: SparkSession, text: str) -> int:
    n = spark.range(1).select(S.parse_size(F.lit(text))).first()[0]
    if not n:
        raise ValueError(f"size {text!r}")
    return n


def run(spark: SparkSession, args: list[str], say=print) -> int:
    """Runs one command; 0 when it did its work, 1 when it could not or when test finds damage. Wrong usage exits with 2."""
    a = parser().parse_args(args)
    try:
        return _dispatch(spark, a, say)
    except (OSError, ValueError, KeyError, PySparkException, Py4JJavaError) as e:  # the last: a task of a write failed
        say(f"{a.verb}: {e}")
        return FAILED


def _dispatch(spark: SparkSession, a: argparse.Namespace, say) -> int:
    if a.verb in ("add", "update", "fresh", "sync"):
        box = Archive(spark, a.archive, block=size_of(spark, a.block), level=a.level)
        rows = inputs(spark, a.inputs)
        {"add": box.add, "update": box.update, "fresh": lambda r: box.update(r, fresh_only=True), "sync": box.sync}[a.verb](rows)
        return OK
    box = Archive(spark, a.archive)
    if a.verb == "list":
        shown = box.list().select("path", "kind", "size", S.size_text(F.coalesce("packed", F.lit(0))).alias("packed"), S.unix_minute(F.col("mtime")).alias("time"))
        for r in shown.orderBy("path").toLocalIterator():
            say(f"{r.kind:9} {r.size:>14} {r.packed:>10}  {r.time:16}  {r.path}")
    elif a.verb == "test":
        bad = 0
        for r in box.test().toLocalIterator():
            bad += 1
            say(f"{r.path}: {r.status}")
        return FAILED if bad else OK
    elif a.verb == "extract":
        box.extract(a.dest, a.paths or None, a.overwrite)
    elif a.verb == "delete":
        box.delete(a.paths)
    elif a.verb == "move":
        box.move({a.src: a.dest})
    elif a.verb == "comment":
        box.comment(a.text)
    else:
        getattr(box, a.verb)()
    return OK


def main() -> int:
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])
