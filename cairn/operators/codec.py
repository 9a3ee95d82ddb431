"""Block codecs, integrity checks and byte filters: one row a block, coded in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates in their order; of equal sizes the earlier one stays.
CODECS = ("store", "zlib", "zstd")
#: No block unpacks to more than this.
MAX_BLOCK = 4 << 30


def split_blocks(content: DataFrame, key: str, data: str, block: int) -> DataFrame:
    """(key, block_no, data): each content cut into blocks of equal size; nothing (null or empty) has no block."""
    size = F.octet_length(data)
    numbers = F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))
    rows = content.where(size > 0).select(key, F.col(data).cast("binary").alias("_data"), F.explode(numbers).alias("block_no"))
    return rows.select(key, "block_no", F.substring("_data", F.col("block_no") * block + 1, F.lit(block)).alias("data"))


def _pack(raw: bytes, level: int) -> tuple[str, bytes]:
    best = ("store", raw)
    for name in CODECS[1:]:
        out = zlib.compress(raw, level) if name == "zlib" else pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)
        if len(out) < len(best[1]):
            best = (name, out)
    return best


def compress_blocks(blocks: DataFrame, data: str = "data", level: int = 6) -> DataFrame:
    """Replaces data by its smallest coding and adds codec, usize, csize and crc (of the plain bytes); null data stay null."""
    at = blocks.columns.index(data)
    names = [*blocks.columns, "codec", "usize", "csize", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, codec, usize, csize, crc = [], [], [], [], []
            for x in batch.column(at):
                raw = x.as_py()
                name, out = (None, None) if raw is None else _pack(raw, level)
                packed.append(out)
                codec.append(name)
                usize.append(None if raw is None else len(raw))
                csize.append(None if raw is None else len(out))
                crc.append(None if raw is None else zlib.crc32(raw))
            columns = [pa.array(packed, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(codec, pa.string()), *[pa.array(v, pa.int64()) for v in (usize, csize, crc)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields), "codec string, usize long, csize long, crc long"])
    return blocks.mapInArrow(run, schema)


def _unpack(codec: str, data: bytes, usize: int) -> bytes:
    if not 0 <= usize <= MAX_BLOCK:
        raise ValueError("size out of bounds")
    if codec == "store":
        return data
    if codec == "zlib":
        d = zlib.decompressobj()
        out = d.decompress(data, usize + 1)
        if not d.eof and len(out) <= usize:
            raise ValueError("truncated")
        return out
    if codec == "zstd":
        return pa.Codec("zstd").decompress(data, decompressed_size=usize, asbytes=True)
    raise ValueError(f"codec {codec}")


def decompress_blocks(blocks: DataFrame, data: str = "data") -> DataFrame:
    """Replaces data by the plain bytes and adds status: ok, bad data, bad size or bad crc. Bad blocks have null data and fail no job."""
    at = {c: blocks.columns.index(c) for c in (data, "codec", "usize", "crc")}
    names = [*blocks.columns, "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, status = [], []
            for row in zip(*(batch.column(at[c]).to_pylist() for c in (data, "codec", "usize", "crc")), strict=True):
                packed, codec, usize, crc = row
                try:
                    raw = _unpack(codec, packed, usize)
                    state = "bad size" if len(raw) != usize else "bad crc" if zlib.crc32(raw) != crc else "ok"
                except (ValueError, TypeError, OSError, zlib.error):
                    raw, state = None, "bad data"
                plain.append(raw if state == "ok" else None)
                status.append(state)
            columns = [pa.array(plain, pa.binary()) if i == at[data] else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(status, pa.string())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields), "status string"])
    return blocks.mapInArrow(run, schema)


def test_blocks(blocks: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Blocks that do not unpack to their stored size and CRC, all of them."""
    return decompress_blocks(blocks, data).where("status <> 'ok'").select(*keys, "status")


test_blocks.__test__ = False


def incompressible(raw: bytes) -> bool:
    """Near-random bytes: 1 MiB or more, 7.92 bits or more in a strided sample, fewer than 0.3 % repeated four-byte words."""
    n = len(raw)
    if n < 1 << 20:
        return False
    b = np.frombuffer(raw, np.uint8)
    want = min(256 << 10, n)
    p = np.bincount(b[:: max(1, n // want)][:want], minlength=256).astype(float)
    p = p[p > 0] / p.sum()
    if -(p * np.log2(p)).sum() < 7.92:
        return False
    count = min(8192, n - 3)
    at = np.arange(0, n - 3, max(1, (n - 4) // count))[:count]
    words = b[at[:, None] + np.arange(4)].astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32)
    return len(words) >= 1024 and (len(words) - len(np.unique(words))) / len(words) < 0.003


def zigzag(w: np.ndarray) -> np.ndarray:
    s = w.astype(np.int16).astype(np.int32)
    return ((s << 1) ^ (s >> 15)).astype(np.uint16)


def unzigzag(w: np.ndarray) -> np.ndarray:
    return (w >> 1) ^ (np.uint16(0) - (w & np.uint16(1)))


def _first(parameter: int) -> tuple[int, int]:
    row = 1 << parameter if parameter else 0
    return row, row + 1


def _residual(w: np.ndarray, parameter: int) -> np.ndarray:
    row, start = _first(parameter)
    out = w.copy()
    if len(w) > start or (not row and len(w) > 1):
        guess = w[start - 1 : -1].copy()
        if row:
            guess += w[start - row : len(w) - row] - w[: len(w) - row - 1]
        out[start:] = w[start:] - guess
    return out


def word16_encode(raw: bytes, parameter: int) -> bytes:
    """16-bit prediction from the left word (0) or from left + up - upper left in rows of 2**parameter words, zigzag, low bytes, high bytes."""
    n = len(raw) // 2
    w = np.frombuffer(raw[: 2 * n], "<u2").astype(np.uint16)
    z = zigzag(_residual(w, parameter))
    return (z & 255).astype(np.uint8).tobytes() + (z >> 8).astype(np.uint8).tobytes() + raw[2 * n :]


def word16_decode(coded: bytes, parameter: int) -> bytes:
    n = len(coded) // 2
    low, high = np.frombuffer(coded[:n], np.uint8), np.frombuffer(coded[n : 2 * n], np.uint8)
    w = unzigzag(low.astype(np.uint16) | high.astype(np.uint16) << np.uint16(8))
    row, start = _first(parameter)
    if not row:
        w = np.cumsum(w, dtype=np.uint16)
    elif n > start:
        #: d[i] = w[i] - w[i - row] obeys d[i] = d[i - 1] + r[i] from the second row on, so a row is one running sum
        for at in range(start, n, row):
            end = min(at + row, n)
            base = w[at - 1 : at] - w[at - 1 - row : at - row]
            w[at:end] = w[at - row : end - row] + np.cumsum(w[at:end], dtype=np.uint16) + base
    return w.astype("<u2").tobytes() + coded[2 * n :]


#: Row widths tried, as powers of two; 0 is the left word.
PARAMETERS = (0, 7, 8, 9, 10, 11)


def _bits(w: np.ndarray) -> float:
    if not len(w):
        return 8.0
    p = (np.bincount(w & 255, minlength=256) + np.bincount(w >> 8, minlength=256)) / (2 * len(w))
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def word16_choice(raw: bytes) -> int | None:
    """The parameter of the smallest residual entropy when it wins half a bit or more over plain words; needs 131,072 words."""
    n = len(raw) // 2
    if n < 128 << 10:
        return None
    w = np.frombuffer(raw[: 2 * n], "<u2").astype(np.uint16)
    best, plain, choice = 8.0, 0.0, None
    for p in PARAMETERS:
        start = _first(p)[1]
        if start >= n:
            continue
        step = max(1, (n - start) // (1 << 20))
        bits = _bits(zigzag(_residual(w, p))[start::step])
        if bits < best:
            best, plain, choice = bits, _bits(w[start::step]), p
    return choice if best + 0.5 < plain else None


def branch_filter(raw: bytes, offset: int, encode: bool = True) -> bytes:
    """Makes the operands of E8 and E9 absolute (or relative again); an operand is never looked at as code."""
    out = bytearray(raw)
    sign, i = (1 if encode else -1), 0
    hits = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xFE) == 0xE8)
    for h in hits.tolist():
        if h < i or h + 4 >= len(out):
            continue
        v = int.from_bytes(out[h + 1 : h + 5], "little") + sign * (offset + h + 5)
        out[h + 1 : h + 5] = (v & 0xFFFFFFFF).to_bytes(4, "little")
        i = h + 5
    return bytes(out)


def screen(content: DataFrame, key: str, data: str) -> DataFrame:
    """key, incompressible and predictor (null: none) of whole contents; null data count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, choice = [], []
            for x in batch.column(1):
                raw = x.as_py() or b""
                dense.append(incompressible(raw))
                choice.append(word16_choice(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dense, pa.bool_()), pa.array(choice, pa.int32())], names=["key", "incompressible", "predictor"])

    kind = content.schema[key].dataType.simpleString()
    rows = content.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"key {kind}, incompressible boolean, predictor int").withColumnRenamed("key", key)
