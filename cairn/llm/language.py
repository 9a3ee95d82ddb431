"""Language ID as multilingual mixture inference.

Each language has byte n-gram probabilities learned from labelled documents. A document is a mixture:
expectation-maximisation estimates its language proportions from the likelihoods of its n-grams, and a
language joins the document's set only while the log-likelihood grows by more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import quote

#: Documents a language is learned from, about (those with the smallest hash of doc_id).
SAMPLE_DOCS = 2000
ORDER, BUCKETS = 3, 1 << 16
EM_STEPS, SMOOTH = 8, 0.5
#: Log-likelihood a further language must add, times log(1 + n-grams).
PENALTY = 4.0
#: Shares below this after the first EM are not tried.
LEAST_SHARE = 0.05
#: N-grams handled at a time.
CHUNK = 200_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the byte n-grams of the lower-cased text; everything in ASCII but letters reads as a space."""
    raw = _FOLD[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace"), np.uint8)]
    if len(raw) < ORDER:
        return np.zeros(0, np.int64)
    n = len(raw) - ORDER + 1
    code, blank = np.zeros(n, np.uint32), np.ones(n, bool)
    for k in range(ORDER):
        part = raw[k : k + n]
        code |= part.astype(np.uint32) << np.uint32(8 * k)
        blank &= part == 32
    return ((code[~blank] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # buckets x languages

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """For each text the language, its share, and the whole selected set with shares."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(ngrams(t) if has_letter(t) else np.zeros(0, np.int64))
            size += len(group[-1])
            if size >= CHUNK:
                out += self._mixtures(group)
                group, size = [], 0
        return out + (self._mixtures(group) if group else [])

    def _mixtures(self, grams: list[np.ndarray]) -> list:
        found = [("und", 0.0, [])] * len(grams)
        real = [i for i, g in enumerate(grams) if len(g)]
        if not real or not self.names:
            return found
        owner = np.repeat(np.arange(len(real)), [len(grams[i]) for i in real])
        key, count = np.unique(owner * BUCKETS + np.concatenate([grams[i] for i in real]), return_counts=True)
        doc, log = key // BUCKETS, self.log_p[key % BUCKETS]
        starts = np.searchsorted(doc, np.arange(len(real)))
        total = np.add.reduceat(count, starts).astype(np.float64)
        single = np.add.reduceat(log * count[:, None], starts, axis=0)
        one = single.argmax(axis=1)
        share = np.zeros((len(real), len(self.names)))
        share[np.arange(len(real)), one] = 1.0
        best = single[np.arange(len(real)), one]
        if len(self.names) > 1:
            top = log.max(axis=1)
            like = np.exp(log - top[:, None])
            base = np.add.reduceat(top * count, starts)
            full = np.full((len(real), len(self.names)), 1 / len(self.names))
            full, _ = _em(like, count, doc, starts, total, full)
            order = np.argsort(-full, axis=1, kind="stable")
            open_ = np.flatnonzero(np.take_along_axis(full, order[:, 1:2], 1)[:, 0] >= LEAST_SHARE)
            for k in range(2, len(self.names) + 1):
                open_ = open_[full[open_, order[open_, k - 1]] >= LEAST_SHARE]
                if not len(open_):
                    break
                mask = np.zeros((len(open_), len(self.names)))
                np.put_along_axis(mask, order[open_, :k], 1 / k, axis=1)
                place = np.full(len(real), -1)
                place[open_] = np.arange(len(open_))
                rows = np.flatnonzero(place[doc] >= 0)
                d = place[doc[rows]]
                s, ll = _em(like[rows], count[rows], d, np.searchsorted(d, np.arange(len(open_))), total[open_], mask)
                ll += base[open_]
                better = ll - best[open_] > PENALTY * np.log1p(total[open_])
                share[open_[better]], best[open_[better]] = s[better], ll[better]
                open_ = open_[better]
        for j, i in enumerate(real):
            lead = int(share[j].argmax())
            chosen = [(self.names[x], float(share[j, x])) for x in np.flatnonzero(share[j] > 0)]
            found[i] = (self.names[lead], float(min(1.0, share[j, lead])), chosen)
        return found


def _em(like, count, doc, starts, total, share):
    """Shares after EM_STEPS and the log-likelihood relative to the best language of each n-gram."""
    for _ in range(EM_STEPS):
        mixed = np.maximum(np.einsum("ij,ij->i", like, share[doc]), 1e-300)
        share = share * np.add.reduceat(like * (count / mixed)[:, None], starts, axis=0) / total[:, None]
    mixed = np.maximum(np.einsum("ij,ij->i", like, share[doc]), 1e-300)
    return share, np.add.reduceat(np.log(mixed) * count, starts)


def learn(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Languages:
    """Learns from train (doc_id, text, lang): about sample_docs documents of each language, all where there are fewer."""
    train = train.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, sample_docs / r["count"]) for r in train.groupBy("lang").count().collect()}
    names = sorted(share)
    if not names:
        return Languages([], np.zeros((BUCKETS, 0)))
    fraction = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < fraction * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(ngrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"]
            )

    counts = picked.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = np.full((BUCKETS, len(names)), SMOOTH)
    at = {k: i for i, k in enumerate(names)}
    for r in counts.collect():  # at most BUCKETS rows a language
        sums[r.bucket, at[r.lang]] += r.n
    return Languages(names, np.log(sums / sums.sum(axis=0)))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row of docs (doc_id, text, lang, ...), and with keep a struct row of the columns it names.

    Learns from rows that are not held out; predicts from the text alone. lang_pred is the language with
    the largest share (ties: the first by name), score that share, languages the selected set with shares.
    A null text, one without a letter, or an empty training set: und, 0, empty. Null doc_ids are not held
    out and not learned from; repeated rows keep their rows; extra columns are ignored or in row, whatever their names. Very long
    texts are read whole. An empty table gives an empty result.
    """
    known = learn(docs.where(~held_out(F.col("doc_id"))))
    model = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.value.infer(b.column("text").to_pylist())
            sets = pa.array([x[2] for x in got], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), sets, *([b.column("row")] if keep else [])],
                names=schema.fieldNames(),
            )

    row = [F.struct(*[F.col(quote(c)) for c in keep]).alias("row")] if keep else []
    src = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *row)
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())]
    kinds += [("languages", T.MapType(T.StringType(), T.DoubleType())), *([("row", src.schema["row"].dataType)] if keep else [])]
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds])
    return src.mapInArrow(run, schema)
