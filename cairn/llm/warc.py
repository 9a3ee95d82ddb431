"""WARC archives read through an index: offset, length, URL and digest of every record come first."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, small
from cairn.llm.files import attempt_name, new_file, open_store

#: Payloads shorter than this are always written in full.
MIN_REVISIT_BYTES = 0
#: Reads closer than GAP bytes are one read, up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
_DATE = "2024-01-01T00:00:00Z"

_INDEX = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("type", pa.string())]
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response instead."""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        f"WARC-Date: {_DATE}".encode(),
        f"WARC-Target-URI: {_clean(url)}".encode(),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"X-Payload-Length: {size}".encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of one record, from its gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its index entry says")
    return fields, block.partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, scratch: Scratch, root: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html, ...), each a gzip member of its own, and returns the index rows.

    Of rows with equal payloads (same SHA-1 and size, at least min_revisit_bytes long) the one with the smallest page_id is a
    response, the others revisit it. Null html is an empty payload, a null url an empty target.
    A null page_id is written as a response and is never referred to. Rows that repeat the smallest page_id are responses too.
    Extra columns are ignored, whatever their names; an empty table writes no archive. A payload of any length is one record.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = src.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    first = (
        keyed.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes))
        .groupBy("sha", "size")
        .agg(F.min("page_id").alias("lead"), F.max("page_id").alias("last"))
        .where("lead < last")
    )
    ids = keyed.select("page_id", "sha", "size").where("page_id is not null").distinct()
    revisits = scratch.cut(ids.join(first, ["sha", "size"]).where("page_id <> lead").select("page_id", "sha", F.col("lead").alias("refers_to")))
    full = keyed.join(small(revisits, revisits.count()), ["page_id", "sha"], "left").withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    ordered = full.repartitionByRange("page_id").sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        uri, at = f"{root}/{attempt_name()}.warc.gz", 0
        with new_file(uri) as out:
            while batch is not None:
                rows = []
                for r in (row for low in range(0, batch.num_rows, 64) for row in batch.slice(low, 64).to_pylist()):
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"] or b"", digest, r["size"], r["refers_to"]), 6, mtime=0)
                    out.write(data)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    rows.append({"file": uri, "offset": at, "length": len(data), "url": r["url"], "digest": digest, "page_id": r["page_id"], "type": kind})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                batch = next((b for b in batches if b.num_rows), None)

    return ordered.mapInArrow(run, "file string, offset long, length long, url string, digest string, page_id long, type string")


def coalesce_ranges(rows: list[dict]) -> list[list[dict]]:
    """Groups index rows sorted by file and offset into single reads."""
    out: list[list[dict]] = []
    for r in rows:
        if out and (last := out[-1][-1])["file"] == r["file"]:
            end = last["offset"] + last["length"]
            if r["offset"] - end <= GAP and r["offset"] + r["length"] - out[-1][0]["offset"] <= READ:
                out[-1].append(r)
                continue
        out.append([r])
    return out


def read_warc(index: DataFrame) -> DataFrame:
    """The records that index rows select (any subset): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Ranges are sorted and coalesced, so a selection costs few reads. A response whose payload does not match its digest raises.
    payload is null for revisits.
    """
    spread = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in coalesce_ranges(b.to_pylist()):
                store, path = open_store(group[0]["file"])
                start = group[0]["offset"]
                with store.open_input_file(path) as f:
                    data = f.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                rows = []
                for r in group:
                    fields, payload = parse(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
                    rows.append(
                        {
                            "page_id": number(fields["warc-record-id"]),
                            "payload_bytes": int(fields["x-payload-length"]),
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": number(fields.get("warc-refers-to", "")),
                            "url": fields["warc-target-uri"],
                            "payload": payload if kind == "response" else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return spread.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and their index into the shared folder, then reads every record back through the index."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.cut(write_warc(pages, scratch, f"{scratch.root}/archives"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
