"""Files in the shared folder from executors: any store pyarrow can open, local paths memory-mapped."""

from __future__ import annotations

import contextlib


def open_store(uri: str):
    """(file system, path) of a URI such as file:///x, hdfs://..., s3://... ; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The local path of a file: URI, where memory mapping is possible."""
    store, path = open_store(uri)
    return path if store.type_name == "local" else None


@contextlib.contextmanager
def new_file(uri: str):
    """Writes a file that appears under its name only when complete.

    Names carry the task attempt, so a retried or speculative attempt never touches another's file.
    """
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".part") as f:
        yield f
    store.move(path + ".part", path)


def attempt_name() -> str:
    """A file stem of the running task: its partition and an id no other attempt has."""
    import uuid

    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"part-{ctx.partitionId() if ctx else 0:05d}-{uuid.uuid4().hex}"
