"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts longer than this many characters are split at safe boundaries before encoding.
LONG_TEXT = 100_000
#: In such a text, runs of one kind of character of at least this length are encoded apart from the pattern.
LONG_RUN = 10_000

_encodings: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once per worker."""
    import tiktoken

    if (ranks_path, pattern) not in _encodings:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path, pattern]


def safe_pieces(text: str, size: int = LONG_TEXT) -> list[str]:
    """Cuts a text before single spaces that stand between two other non-space characters.

    No match of the pattern covers such a place: a run of white space cannot end there, since the
    character before is none, and letters, digits and signs take a space only as their first character.
    A text without such places stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at != -1 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


@functools.cache
def _long_runs(least: int):
    """Runs of one kind of character, of at least so many: white space, letters with their marks apart, numbers, or other signs."""
    import regex

    return regex.compile(rf"\s{{{least},}}+|\p{{L}}{{{least},}}+|\p{{N}}{{{least},}}+|[^\s\p{{L}}\p{{N}}]{{{least},}}+")


def long_run_pieces(text: str, least: int = LONG_RUN) -> list[tuple[str, bool]]:
    """Parts of a text in order; True marks a long run that is one match of the pattern, which its regular expression would overflow on.

    A run of white space before other text is one match without its last character; that one goes with a following word if it is a
    single space, and is a match of its own otherwise. Other runs are one match, with a space before them if there is one. Letters
    after an apostrophe lose those of a contraction, unless a space or sign before it has taken the apostrophe.
    """
    out, at = [], 0
    for m in _long_runs(least).finditer(text):
        start, end = m.span()
        if _space(text[start]):
            end -= end < len(text)
        elif start > at:
            before = text[start - 1]
            if before == " ":
                start -= 1
            elif _space(before):
                out.append((text[at : start - 1], False))
                at = start - 1
            elif before == "'" and (start - 1 == at or not _takes_apostrophe(text[start - 2])):
                start += next((len(x) for x in ("re", "ve", "ll", "s", "t", "m", "d") if text.startswith(x, start)), 0)
        out += [(text[at:start], False), (text[start:end], True)]
        at = end
    return [(t, alone) for t, alone in [*out, (text[at:], False)] if t]


def _space(c: str) -> bool:
    import regex

    return regex.fullmatch(r"\s", c) is not None


def _takes_apostrophe(before: str) -> bool:
    """Whether an apostrophe after this character is part of a match that began before it."""
    import regex

    return before == " " or regex.fullmatch(r"[^\s\p{L}\p{N}]", before) is not None


def encode(enc, text: str) -> list[int]:
    """Ids as of encode_ordinary, for texts of any length and runs of any length."""
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, alone in long_run_pieces(text):
        if alone:
            out += enc._encode_single_piece(part)
        else:
            for piece in safe_pieces(part):
                out += enc.encode_ordinary(piece)
    return out


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs (doc_id, text, ...), and the columns named in keep.

    A null text encodes as the empty one: no ids. Repeated rows and null doc_ids are kept; extra columns not named in keep are ignored, whatever
    their names. Texts of any length, and runs of one kind of character of any length, encode as by the pattern. An empty table gives an empty result.
    """
    named = [c for c in dict.fromkeys(keep) if c != "doc_id"]
    src = docs.select(*dict.fromkeys(["doc_id", "text", *named]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = pa.array([encode(enc, x.as_py() or "") for x in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, *[b.column(c) for c in named]], names=["doc_id", "ids", *named])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ["doc_id", *named]}
    extra = "".join(f", `{c}` {kinds[c]}" for c in named)
    return src.mapInArrow(run, f"doc_id {kinds['doc_id']}, ids array<int>{extra}")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary): the raw bytes of ids; no text decoding, so any id sequence has a result. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            data = pa.array([enc.decode_bytes(x.as_py() or []) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), data], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, decoding and digests in one pass over the texts.

    Nulls, repeated rows, extra columns, long texts and empty tables as in bpe_encode.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, digest, decoded = [], [], []
            for x in b.column("text"):
                ids = encode(enc, x.as_py() or "")
                n.append(len(ids))
                digest.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()))
                decoded.append(sha(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
