"""N-gram Jaccard join by vertical partitioning.

The global order of the n-gram hashes is cut into vertical fragments. Each fragment counts in how many sets its n-grams occur;
n-grams of one set can overlap with nothing and go no further. The others are ordered rarest first, and two linked
sets of n n-grams share one of the first n - ceil(t n) + 1 of each; sets that share such an n-gram form classes.
The sets of a class meet fragment by fragment: each fragment counts, on its own, the partial overlaps of the pairs of a block
of sets, and these are summed per pair over the fragments before a pair is held against the threshold. Only a spanning forest of the links
leaves a block. N-grams that are very common in many batches are last in the order whatever their count, so they need no counting,
and their occurrences are dealt over many tasks by a salt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch, connected_components, skew_left_join, small

#: N-grams that a vertical fragment of the counting step holds on average.
COUNTED = 1 << 20
#: Leading bytes of a hash that stand for an n-gram: counts, prefixes and overlaps are exact up to collisions of 48-bit hashes.
PREFIX = 6
#: Sets in a block of a class; a larger class is compared with its first set by blocks, then the rest block by block.
BLOCK_SETS = 120
#: N-grams of a block of sets in a vertical fragment, about; columns of a fragment that are counted at a time.
FRAGMENT_GRAMS, COLUMNS = 1 << 17, 4096
#: Vertical fragments that the overlaps of a block are counted in, at least (a power of two).
CUTS = 4
#: An n-gram in one of so many rows of a batch, and at least in HEAVY_ROWS, is heavy there; one that is heavy in a batch of HOT_BATCHES is hot.
HEAVY_SHARE, HEAVY_ROWS, HOT_BATCHES = 64, 16, 20
#: Hot n-grams that are sent to all tasks at most (those of the most batches); the others are counted like any.
HOT_GRAMS = 100_000
#: An n-gram in the global order is one long: its count, at most this (which also stands for hot ones), then its 48 bits.
MOST_DF = (1 << 15) - 1
#: Copies from which a class is joined as a hot key.
HOT_COPIES = 1000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_MULT = _rng.integers(1 << 61, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        inverse = pow(_R, -1, 1 << 64)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _R, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def word_hashes(data: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word of lower-cased data; long texts are cut at white space into pieces."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            up, down = _power_tables(len(raw) + 1)
            run = np.concatenate([[np.uint64(0)], np.cumsum(np.where(word, _BYTE[raw] * up[: len(raw)], np.uint64(0)))])
            out.append(_mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles of a text; fewer words count as one shingle."""
    words = word_hashes((data or b"").lower())
    if not len(words):
        return words
    w = min(width, len(words))
    h = np.full(len(words) - w + 1, np.uint64(w), np.uint64)
    for k in range(w):
        h = h * _MULT[63] + words[k : len(words) - w + 1 + k] * _MULT[k % 63]
    return np.unique(_mix(h))


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    return tuple(int(_mix(h * m).sum().view(np.int64)) for m in (_MULT[5], _MULT[7])) if len(h) else (0, 0)


def heads(h: np.ndarray) -> np.ndarray:
    """The leading bytes of sorted hashes, distinct, as longs."""
    return np.unique((h >> np.uint64(64 - 8 * PREFIX)).view(np.int64))


def heavy(grams: list[np.ndarray], least: int) -> np.ndarray:
    """N-grams that at least so many of the sets hold; a first count over hash buckets leaves few to sort."""
    g = np.concatenate([*grams, np.zeros(0, np.int64)])
    bucket = g & ((1 << 20) - 1)
    g = g[np.bincount(bucket, minlength=1 << 20)[bucket] >= least] if len(g) else g
    value, count = np.unique(g, return_counts=True)
    return value[count >= least]


def _features(width: int, heavy_rows: int):
    """A row per document; the first row of a batch names the batch's heavy n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingles(x.as_py(), width) for x in b.column("data")]
            one, two = zip(*map(fingerprint, sets), strict=True)
            grams = [heads(h) for h in sets]
            each = dict(zip(one, grams, strict=True)).values()  # copies count once
            common = [heavy([*each], max(heavy_rows, b.num_rows // HEAVY_SHARE)).tolist(), *[None] * (len(sets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(h) for h in sets], [len(g) for g in grams], one, two)), pa.array(common, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "n_heads", "fp1", "fp2", "heavy"],
            )

    return run


def _cut(width: int, bits: int, hot):
    """For each batch and vertical fragment one row: the sets, how many n-grams each holds there, and these, set by set. Hot n-grams go to a salt instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                sets: dict[int, np.ndarray] = {}
                for x in whole.column("data").slice(low, 2048):
                    h = shingles(x.as_py(), width)
                    sets.setdefault(fingerprint(h)[0], h)  # copies count once
                names = np.array(list(sets), np.int64)
                grams = [heads(h) for h in sets.values()]
                g = np.concatenate([*grams, np.zeros(0, np.int64)])
                owner = np.repeat(np.arange(len(grams), dtype=np.uint16), [len(x) for x in grams])
                v = g >> (8 * PREFIX - bits)
                if len(known) and len(g):
                    salt = (1 << bits) + int(_mix(names[:1].view(np.uint64))[0] >> np.uint64(64 - bits))
                    v[known[np.searchsorted(known, g).clip(max=len(known) - 1)] == g] = salt
                order = np.lexsort((g, owner, v))
                g, owner, v = g[order], owner[order], v[order]
                edge = np.flatnonzero(np.diff(v, prepend=-1))
                head = np.ascontiguousarray(g).view(np.uint8).reshape(-1, 8)[:, :PREFIX]
                rows = list(zip(v[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(g)], strict=True)) if len(g) else []
                if rows:
                    held = [np.unique(owner[a:z], return_counts=True) for _, a, z in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _, _ in rows], pa.int64()),
                            pa.array([names[o].tobytes() for o, _ in held], pa.binary()),
                            pa.array([_short(n) for _, n in held], pa.binary()),
                            pa.array([head[a:z].tobytes() for _, a, z in rows], pa.binary()),
                        ],
                        names=["v", "sets", "held", "grams"],
                    )

    return run


def _short(n: np.ndarray) -> bytes:
    """Whole numbers in one, two or four bytes each, whichever holds all."""
    return n.astype("<u1" if n.max() < 1 << 8 else "<u2" if n.max() < 1 << 16 else "<u4").tobytes()


def _owners(sets: bytes, held: bytes) -> np.ndarray:
    """The set of each n-gram of a row of _cut."""
    names = np.frombuffer(sets, np.int64)
    return np.repeat(names, np.frombuffer(held, f"<u{len(held) // len(names)}"))


def _count(bits: int):
    """The n-grams of a vertical fragment that several sets hold, with their places in the global order: a row per bucket of sets."""

    def run(t: pa.Table) -> pa.Table:
        grams, names = [], []
        for sets, held, head in zip(*(t.column(c).to_pylist() for c in ("sets", "held", "grams")), strict=True):
            wide = np.zeros((len(head) // PREFIX, 8), np.uint8)
            wide[:, :PREFIX] = np.frombuffer(head, np.uint8).reshape(-1, PREFIX)
            grams.append(wide.view(np.int64).ravel())
            names.append(_owners(sets, held))
        g, s = np.concatenate(grams), np.concatenate(names)
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])  # equal sets of other batches count once
        g, s = g[first], s[first]
        if t.column("v")[0].as_py() >> bits:
            df = np.full(len(g), MOST_DF)
        else:
            size = np.diff(np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)))
            df = np.repeat(size, size)
            g, s, df = g[df > 1], s[df > 1], df[df > 1]
        place, bucket = (np.minimum(df, MOST_DF) << (8 * PREFIX)) | g, _bucket(s, bits)
        order = np.argsort(bucket, kind="stable")
        place, s, bucket = place[order], s[order], bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(s)], strict=True)) if len(s) else []
        return pa.table(
            {
                "bucket": pa.array(bucket[edge], pa.int64()),
                "sets": pa.array([s[a:z].tobytes() for a, z in spans], pa.binary()),
                "places": pa.array([place[a:z].tobytes() for a, z in spans], pa.binary()),
            }
        )

    return run


def _bucket(names: np.ndarray, bits: int) -> np.ndarray:
    return (names.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def _gather(t: pa.Table, reps: pa.Table) -> pa.Table:
    """The sets of a bucket that share n-grams, each with its n-grams from all fragments in the global order."""
    name, place = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in t.column(c).to_pylist())]) for c in ("sets", "places"))
    if not len(name):
        return _KNOWN.empty_table()
    order = np.lexsort((place, name))
    name, place = name[order], place[order]
    other = np.append(True, name[1:] != name[:-1])
    keep = other | np.append(True, place[1:] != place[:-1])  # a hot n-gram comes from every batch that holds a copy of the set
    name, place, other = name[keep], place[keep], other[keep]
    edge = np.flatnonzero(other)
    grams = pa.ListArray.from_arrays(pa.array([*edge, len(name)], pa.int32()), pa.array(place, pa.int64()))
    reps = reps.sort_by("fp1")
    row = np.searchsorted(reps.column("fp1").to_numpy(), name[edge])
    return pa.table([*(reps.column(c).take(pa.array(row)).combine_chunks() for c in _KNOWN.names[:-1]), grams], schema=_KNOWN)


_KNOWN = pa.schema([("fp1", pa.int64()), ("n_shingles", pa.int64()), ("n_heads", pa.int64()), ("id", pa.int64()), ("grams", pa.list_(pa.int64()))])


def partial_overlaps(owner: np.ndarray, grams: np.ndarray, sets: int) -> np.ndarray:
    """Overlap of every pair of sets in one vertical fragment; owner and grams say which set holds which n-gram."""
    order, column = np.unique(grams, return_inverse=True)
    total = np.zeros((sets, sets), np.float32 if len(order) < 1 << 24 else np.float64)
    by = np.argsort(column, kind="stable")
    column, row = column[by], owner[by]
    for low in range(0, len(order), COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((sets, min(COLUMNS, len(order) - low)), np.float32)
        x[row[a:z], column[a:z] - low] = 1
        total += x @ x.T
    return total


_GROUP = ["class_id", "bi", "bj"]


def _triangle(both: np.ndarray) -> bytes:
    """The overlaps of a block's pairs, row by row above the diagonal, in two bytes each where they fit."""
    flat = np.rint(both[np.triu_indices(len(both), 1)])
    return flat.astype("<u2" if flat.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _square(data: bytes, n: int) -> np.ndarray:
    pairs = n * (n - 1) // 2
    out = np.zeros((n, n), np.int64)
    out[np.triu_indices(n, 1)] = np.frombuffer(data, "<u2" if len(data) == 2 * pairs else "<u4")
    return out + out.T


def _partial(t: pa.Table) -> pa.Table:
    """Of a block of sets in one vertical fragment: its sets, their sizes and the partial overlap of every pair, as one row."""
    part = t.column("part").combine_chunks()
    grams = part.flatten().to_numpy(zero_copy_only=False)
    sets, at, owner = np.unique(t.column("fp1").to_numpy(), return_index=True, return_inverse=True)
    both = partial_overlaps(np.repeat(owner, np.diff(part.offsets.to_numpy())), grams, len(sets))
    data = {"sets": sets.tobytes(), "ids": t.column("id").to_numpy()[at].tobytes(), "sizes": t.column("n").to_numpy()[at].tobytes(), "overlaps": _triangle(both)}
    return pa.table({**{c: t.column(c).slice(0, 1) for c in _GROUP}, **{k: pa.array([v], pa.binary()) for k, v in data.items()}})


def _links(percent: int):
    """Sums the partial overlaps of a block's fragments per pair; a spanning forest of the pairs that link."""

    def run(t: pa.Table) -> pa.Table:
        parts = [
            (*(np.frombuffer(x, np.int64) for x in (s, i, n)), _square(o, len(s) // 8))
            for s, i, n, o in zip(*(t.column(c).to_pylist() for c in ("sets", "ids", "sizes", "overlaps")), strict=True)
        ]
        sets, first = np.unique(np.concatenate([x[0] for x in parts]), return_index=True)
        ids, n = (np.concatenate([x[k] for x in parts])[first] for k in (1, 2))
        both = np.zeros((len(sets), len(sets)), np.int64)
        for s, _, _, o in parts:
            at = np.searchsorted(sets, s)
            both[np.ix_(at, at)] += o
        order = np.argsort(ids, kind="stable")
        ids, n, both = ids[order], n[order], both[np.ix_(order, order)]
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, True)
        label = np.arange(len(ids))
        while True:
            new = np.where(linked, label[None, :], len(ids)).min(axis=1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        away = ids != ids[label]
        return pa.table({"src": pa.array(ids[away], pa.int64()), "dst": pa.array(ids[label[away]], pa.int64())})

    return run


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts every set into its vertical fragments: cuts equal ranges of the n-gram hashes."""
    for b in batches:
        grams = b.column("grams")
        place = grams.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(b.num_rows), np.diff(grams.offsets.to_numpy()))
        cut = ((place & ((1 << 8 * PREFIX) - 1)) * b.column("cuts").to_numpy()[owner]) >> (8 * PREFIX)
        order = np.lexsort((cut, owner))
        place, owner, cut = place[order], owner[order], cut[order]
        edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (cut[1:] != cut[:-1]))[: len(cut)])
        part = pa.ListArray.from_arrays(pa.array([*edge, len(cut)], pa.int32()), pa.array(place, pa.int64()))
        rows = pa.array(owner[edge])
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in _SET), pa.array(cut[edge], pa.int64()), part], names=[*_SET, "cut", "part"])


_SET = [*_GROUP, "fp1", "id", "n"]


def _block_links(known: DataFrame, dealt: DataFrame, n_dealt: int, percent: int) -> DataFrame:
    """Links inside blocks. dealt says which set (fp1, id, n) is in which block (class_id, bi, bj) and how many fragments it has (cuts)."""
    rows = known.select("fp1", "grams").join(small(dealt, n_dealt), "fp1").select(*_SET, "cuts", "grams")
    rows = rows.mapInArrow(_fragments, "class_id long, bi int, bj int, fp1 long, id long, n long, cut long, part array<long>")
    partial = rows.groupBy(*_GROUP, "cut").applyInArrow(_partial, "class_id long, bi int, bj int, sets binary, ids binary, sizes binary, overlaps binary")
    return partial.groupBy(*_GROUP).applyInArrow(_links(percent), "src long, dst long")


def _class_links(known: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(src, dst): a spanning forest of the links of every class; members are (fp1, id, n, class_id, sets, grams).

    A small class is one block. Of a large one every block meets the class's first set; sets linked with it there are one component
    already, and only the rest meets the whole class, block by block.
    """

    def cuts(grams):
        return F.greatest(F.lit(CUTS), F.pow(2, F.ceil(F.log2(F.greatest(grams / FRAGMENT_GRAMS, F.lit(1))))).cast("long"))

    def own(count):
        return F.pmod(F.xxhash64("id"), count).cast("int")

    base = ["fp1", "id", "n"]
    large, blocks = F.col("sets") > BLOCK_SETS, F.ceil(F.col("sets") / BLOCK_SETS).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    where = F.when(~large, F.array(F.lit(0))).when(F.col("id") == F.col("class_id"), every).otherwise(F.array(own(blocks)))
    first = members.select(*base, "class_id", F.when(large, -1).otherwise(0).alias("bi"), F.explode(where).alias("bj"), cuts(F.col("grams") / blocks).alias("cuts"))
    first = scratch.cut(first)
    links = scratch.cut(_block_links(known, first, first.count(), percent))
    wide = scratch.cut(members.where(large))
    n_wide = wide.count()
    if not n_wide:
        return links
    near = links.select(F.col("src").alias("id"), F.col("dst").alias("class_id")).distinct().withColumn("done", F.lit(True))
    wide = wide.join(near, ["id", "class_id"], "left").withColumn("done", F.coalesce("done", F.col("id") == F.col("class_id")))
    wide = scratch.cut(wide)
    split = wide.groupBy("class_id").agg(F.sum(F.when(~F.col("done"), 1)).alias("rest"), F.sum(F.when(F.col("done"), 1)).alias("known")).where("rest > 0")
    split = split.select("class_id", F.ceil(F.col("rest") / BLOCK_SETS).cast("int").alias("gu"), F.ceil(F.col("known") / BLOCK_SETS).cast("int").alias("gr"))
    left = wide.join(split, "class_id")
    mine = F.when(F.col("done"), F.col("gu") + own(F.col("gr"))).otherwise(own(F.col("gu")))
    other = F.when(F.col("done"), F.sequence(F.lit(0), F.col("gu") - 1)).otherwise(F.sequence(F.lit(0), F.col("gu") + F.col("gr") - 1))
    left = left.withColumn("mine", mine).withColumn("other", F.explode(other))
    second = left.select(*base, "class_id", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), cuts(2 * F.col("grams") / blocks).alias("cuts"))
    second = scratch.cut(second)
    return links.union(scratch.cut(_block_links(known, second, second.count(), percent)))


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text, ...).

    Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a set holds the
    distinct width-word shingles of the whole text. Sets link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable by links.
    Nulls and empty texts: n_shingles 0, component_id is the row's own doc_id (null for a null doc_id).
    Rows with a null doc_id are counted but not linked: their component_id is null. Repeated rows give
    one row each; classes of equal sets whose smallest doc_id is the same are one node. Extra columns
    are ignored, whatever their names; an empty table gives an empty result. Whole texts are read however long; sets are
    compared by 48-bit hashes of their n-grams.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    features = scratch.cut(text.mapInArrow(_features(width, HEAVY_ROWS), "doc_id long, n_shingles long, n_heads long, fp1 long, fp2 long, heavy array<long>"))
    real = features.where("doc_id is not null and n_shingles > 0")
    batches = features.where("heavy is not null")
    least = max(2, math.ceil(batches.count() / HOT_BATCHES))
    hot = batches.select(F.explode("heavy").alias("g")).groupBy("g").count().where(F.col("count") >= least).orderBy(F.desc("count"), "g").limit(HOT_GRAMS)
    hot = spark.sparkContext.broadcast(np.array(sorted(r.g for r in hot.collect()), np.int64))
    bits = max(CUTS.bit_length() - 1, math.ceil(math.log2(max(1, (real.agg(F.sum("n_shingles")).first()[0] or 0) / COUNTED))))
    cut = text.where("doc_id is not null and data is not null").mapInArrow(_cut(width, bits, hot), "v long, sets binary, held binary, grams binary")
    common = cut.groupBy("v").applyInArrow(_count(bits), "bucket long, sets binary, places binary")
    #: equal sets are one class; partial aggregation collapses a hot group of copies before the shuffle
    reps = scratch.cut(real.groupBy("fp1", "fp2", "n_shingles", "n_heads").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    #: the sets meet their sizes in the same shuffle
    sizes = reps.select(F.shiftrightunsigned("fp1", 64 - bits).alias("bucket"), "fp1", "n_shingles", "n_heads", "id")
    known = common.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_gather, "fp1 long, n_shingles long, n_heads long, id long, grams array<long>")
    known = scratch.cut(known)
    n = F.col("n_shingles")
    #: of the first n - ceil(t n) + 1 n-grams in the order, n_heads - size(grams) are held by no other set
    take = n - F.ceil(n * percent / 100) + 1 - (F.col("n_heads") - F.size("grams"))
    keys = known.where(take > 0).select("id", F.explode(F.slice("grams", F.lit(1), take.cast("int"))).alias("key"))
    keys = scratch.cut(keys)
    leaders = scratch.cut(keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = skew_left_join(keys, leaders, ["key"], F.col("n") >= HOT_COPIES, ["id"]).where("id <> leader")
    classes = scratch.cut(connected_components(shared.select(F.col("id").alias("src"), F.col("leader").alias("dst")), scratch))
    count = classes.count()
    members = reps.select("fp1", "id", n.alias("n")).join(small(classes, count).withColumnRenamed("component", "class_id"), "id")
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    members = scratch.cut(members.join(sizes, "class_id"))
    links = scratch.cut(_class_links(known, members, percent, scratch))
    scratch.free(known)
    scratch.free(keys)
    found = scratch.cut(connected_components(links, scratch))
    reached = small(found, found.count())
    ids = reps.withColumnRenamed("id", "rep").join(reached.withColumnRenamed("id", "rep"), "rep", "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component"), "copies"
    )
    #: a class of one set that links with nothing needs no row: its component is its own doc_id
    ids = scratch.cut(ids.join(reps.select("fp1", "fp2", "n_shingles", "id"), ["fp1", "fp2", "n_shingles"]).where("copies > 1 or component <> id").drop("id"))
    out = skew_left_join(features, ids, ["fp1", "fp2", "n_shingles"], F.col("copies") >= HOT_COPIES, ["doc_id"])
    out = out.withColumn("component", F.coalesce("component", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
