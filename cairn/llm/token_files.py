"""Token-id files: flat unsigned integers, 64-bit document offsets, partition bases from prefix sums.

A partition of the corpus, in ascending doc_id order, becomes three files:
  <part>.bin   ids of all documents back to back, little-endian uint16 where the vocabulary allows, else uint32
  <part>.off   n + 1 little-endian uint64: where each document starts, in ids from the start of the file
  <part>.doc   n little-endian int64 doc_ids (null: the smallest int64)
The manifest (a Parquet table) names each part, its place in the order, its document and id counts and
its base, the prefix sum of the ids of the parts before it.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch
from cairn.llm.files import attempt_name, local_path, new_file, open_store

#: Words whose ids a worker remembers, of at most so many characters.
CACHE_WORDS, CACHE_CHARS = 1_200_000, 64
#: Words encoded in one call.
CALL_WORDS = 512
NO_ID = -(1 << 63)
SIGNS = ".,;:!?#*$%&|\""


class WordEncoder:
    """Encodes texts word by word, remembering the ids of words.

    Right for tokenizers that drop white space before any merge, as word-end BPE does: there the ids of a text
    are those of its parts between spaces and line feeds in a row.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: texts that hold the string of a special token are encoded whole, as the library does
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.end = np.uint32(end_id).tobytes()
        self.known: dict[str, bytes] = {"": b""}
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @property
    def width(self) -> int:
        return 2 if self.tok.get_vocab_size() <= 1 << 16 else 4

    def _learn(self, words: list[str]) -> None:
        """Letters-only words go in one text: each ends with its only word-end id, so the ids split there again.

        Every word ends at least one; where the counts agree each word has just one, otherwise words are encoded alone.
        """
        known = self.known
        plain = [w for w in words if w.isalpha()]
        for low in range(0, len(plain), CALL_WORDS):
            part = plain[low : low + CALL_WORDS]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) == len(part):
                data, at = ids.tobytes(), 0
                for w, end in zip(part, (4 * cut).tolist(), strict=True):
                    known[w] = data[at:end]
                    at = end
            else:
                self._alone(part)
        self._alone([w for w in words if not w.isalpha()])

    def _alone(self, words: list[str]) -> None:
        for w in words:
            self.known[w] = self._ids(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian uint32."""
        whole = {i for i, t in enumerate(texts) if t and any(x in t for x in self.special)}
        split = [[] if i in whole else (t or "").replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        known = self.known
        new = set().union(*split) - known.keys()
        #: letters and then signs without an apostrophe or bracket are two tokens of the splitter, whatever surrounds them
        halves = {w: (base, w[len(base) :]) for w in new if (base := w.rstrip(SIGNS)) != w and base.isalpha()}
        self._learn([x for x in {x for w in new for x in halves.get(w, (w,))} if x not in known])
        for w, (base, signs) in halves.items():
            known[w] = known[base] + known[signs]
        out = [b"".join(map(known.__getitem__, words)) + self.end for words in split]
        for i in whole:
            out[i] = self._ids(texts[i]) + self.end
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def _encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder a worker, so its words outlive a task."""
    return WordEncoder(path, end_id)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, root: str) -> DataFrame:
    """Writes docs (doc_id, text, ...) in ascending doc_id order; returns the manifest rows (not yet with bases).

    part int, name string, n_docs long, n_ids long, width int. Null doc_ids come first, a null text is
    empty and has only the end id, repeated rows are all written; an empty table writes no file. Extra columns are ignored,
    whatever their names. A very long text costs memory in proportion to its length, in its own task alone.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = None
        offsets, ids, n = [np.zeros(1, "<u8")], [], 0
        name = attempt_name()
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        enc = _encoder(tokenizer_path, end_id)
        width = enc.width
        with new_file(f"{root}/{name}.bin") as out:
            while batch is not None:
                for low in range(0, batch.num_rows, 256):
                    piece = batch.slice(low, 256)
                    data = enc.encode(piece.column("text").to_pylist())
                    size = np.array([len(x) // 4 for x in data], np.uint64)
                    offsets.append((np.cumsum(size) + np.uint64(n)).astype("<u8"))
                    n += int(size.sum())
                    ids.append(np.array([NO_ID if x is None else x for x in piece.column("doc_id").to_pylist()], "<i8"))
                    out.write(np.frombuffer(b"".join(data), "<u4").astype(f"<u{width}").tobytes())
                batch = next(batches, None)
        for kind, arrays in (("off", offsets), ("doc", ids)):
            with new_file(f"{root}/{name}.{kind}") as out:
                out.write(np.concatenate(arrays).tobytes())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": sum(map(len, ids)), "n_ids": n, "width": width}], schema=_MANIFEST)

    return ordered.mapInArrow(run, "part int, name string, n_docs long, n_ids long, width int")


_MANIFEST = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds base: ids of all parts before. One row per part, so the single-partition window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def map_part(root: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """A file of a part: memory-mapped where the store is a file system, read whole elsewhere."""
    uri = f"{root}/{name}.{kind}"
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype, "r")
    store, far = open_store(uri)
    with store.open_input_file(far) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(manifest: DataFrame, root: str, parts: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest with bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                off = map_part(root, row["name"], "off", "<u8")
                doc = map_part(root, row["name"], "doc", "<i8")
                ids = map_part(root, row["name"], "bin", f"<u{row['width']}")
                for low in range(0, len(doc), 4096):
                    cut = off[low : low + 4097].astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                    keys = np.asarray(doc[low : low + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64(), mask=keys == NO_ID), pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(parts, "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as token files into the shared folder and returns what the files hold, per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    root = f"{scratch.root}/ids"
    parts = scratch.cut(write_token_files(docs, tokenizer_path, end_id, root))
    manifest = scratch.cut(with_bases(parts))
    return read_token_files(manifest, root, max(1, manifest.count()))
