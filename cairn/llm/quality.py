"""Quality rules: plain counts first, then a hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.ngram_jaccard import _SPACE, _mix, word_hashes

#: Labelled rows the classifier is fitted on at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 3000
#: Buckets: the lower half for words and word pairs, the upper half for n-grams of CHARS code points.
BUCKETS, CHARS = 1 << 16, 4
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_QUALITY = 10, 20, 0.5
#: Of the sample, one in so many rows calibrates.
CALIBRATE = 5
STEPS, RATE, L2, SCALE = 120, 0.3, 1e-5, 24.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; words are the hashes of its words.

    Windows are compared by 64-bit hashes.
    """
    raw = np.frombuffer(data, np.uint8)
    chars = len(raw) - int(((raw & 0xC0) == 0x80).sum()) - int(_SPACE[raw].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) >= 5:
        n = len(words) - 4
        h = np.zeros(n, np.uint64)
        for k in range(5):
            h = _mix(h + words[k : k + n])
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        again = (count > 1)[inverse].astype(np.int32)
        cover = np.zeros(len(words) + 1, np.int32)
        cover[:n] += again
        cover[5 : 5 + n] -= again
        repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeat


def buckets(data: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, word pair and character n-gram (code points) of a text."""
    half = np.uint64(BUCKETS // 2)
    pairs = _mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    w = (np.concatenate([words, pairs]) % half).astype(np.int32)
    raw = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(raw) < CHARS:
        return w, w[:0]
    n = len(raw) - CHARS + 1
    code = raw[:n].copy()
    for k in range(1, CHARS):
        code *= np.uint32(0x01000193)
        code += raw[k : n + k]
    return w, ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32) % (BUCKETS // 2) + BUCKETS // 2


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, data: bytes, words: np.ndarray) -> float:
        w, c = buckets(data, words)
        z = self.bias + SCALE * sum(float(self.weights[x].mean()) for x in (w, c) if len(x))
        return float(_sigmoid(np.float64(self.slope * z + self.shift)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss_gradient(x: np.ndarray, row, col, val, y, use) -> np.ndarray:
    """Gradient of the mean log loss over the rows in use and of L2 / 2 times the squared weights; the last of x is the bias."""
    error = np.where(use, _sigmoid(np.bincount(row, val * x[col].astype(np.float32), len(y)) + x[-1]) - y, 0) / use.sum()
    g = np.bincount(col, val * error[row].astype(np.float32), len(x)) + L2 * x
    g[-1] = error.sum()
    return g


def platt_fit(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Slope and shift of the calibrated log odds, fitted to Platt's smoothed targets."""
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))

    def grad(p):
        e = (_sigmoid(p[0] * z + p[1]) - target) / len(t)
        return np.array([(e * z).sum(), e.sum()])

    return _descend(grad, np.array([1.0, 0.0]), 500, 0.02)


def _descend(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam on a full-batch gradient."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, quality, idx, val: sparse features of the labelled sample, at most rows label rows."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, val = [], []
            for x in b.column("data"):
                data = x.as_py()
                at, value = [], []
                for part in buckets(data, word_hashes(data)):
                    if len(part):
                        i, n = np.unique(part, return_counts=True)
                        at.append(i.astype(np.uint16))
                        value.append((n / len(part)).astype(np.float16))
                idx.append(np.concatenate([*at, np.zeros(0, np.uint16)]).tobytes())
                val.append(np.concatenate([*value, np.zeros(0, np.float16)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["doc_id", "quality", "idx", "val"]
            )

    #: one text a label, whatever the number of rows with its doc_id
    joined = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min("data").alias("data"))
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, idx binary, val binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits and calibrates on at most rows labelled documents. Without labels of both kinds the model is constant."""
    got = sorted(_sample(docs, labels, rows).collect(), key=lambda r: (r.doc_id, bytes(r.idx)))
    y = np.array([r.quality for r in got], np.float64)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 40.0 if not len(y) or y[0] else -40.0)
    idx = [np.frombuffer(r.idx, np.uint16) for r in got]
    col = np.concatenate(idx)
    val = np.concatenate([np.frombuffer(r.val, np.float16) for r in got]).astype(np.float32) * np.float32(SCALE)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in idx])
    held = np.arange(len(got)) % CALIBRATE == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    use = ~held

    x = _descend(lambda x: loss_gradient(x, row, col, val, y, use), np.zeros(BUCKETS + 1), STEPS, RATE)
    slope = np.array([1.0, 0.0])
    if held.any():
        z = np.bincount(row, val * x[col].astype(np.float32), len(got)) + x[-1]
        slope = platt_fit(z[held], y[held])
    return Model(x[:-1].astype(np.float32), float(x[-1]), float(slope[0]), float(slope[1]))


def quality_rules(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept of every row of docs.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows.
    kept: not base_failed and the calibrated probability of good quality is at least min_quality.
    Null and empty texts have zero counts and fail. Null doc_ids and repeated rows keep their rows; extra columns are ignored,
    whatever their names. Without labels of both kinds (an empty table too) the classifier is constant. Very long texts are read whole; an empty docs gives an
    empty result. Of rows that repeat a labelled doc_id the smallest text is learned from.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            rows = []
            for x in b.column("data"):
                data = x.as_py() or b""
                words = word_hashes(data)
                counts = base_counts(data, words)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                p = m.probability(data, words)
                rows.append((*counts, failed, p, not failed and p >= min_quality))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=_NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean",
    )


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
