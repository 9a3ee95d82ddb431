"""Content queries over documents against brute force, with nulls, empty, long and repetitive texts."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from cairn import registry


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé€\U0001f600 \n") for _ in range(rng.randint(1, 300)))
    return [(1, None), (2, ""), (3, "a"), (4, "abcabcabcabc"), (5, "x" * 70_000), (6, "abcd" + "".join(chr(200 + i % 5000) for i in range(66_000)) + "abcd"), (None, "no id, no id"), *[(i, word()) for i in range(10, 40)]]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: [tuple(r) for r in registry.QUERIES[name](spark, folder).collect()]


def test_histogram_and_entropy(run, rows):
    raw = {i: (t or "").encode() for i, t in rows}
    assert sorted(run("document_byte_histogram"), key=repr) == sorted(((i, b, n) for i, t in raw.items() for b, n in collections.Counter(t).items()), key=repr)
    for order in (0, 1):
        got = {i: (bits, n) for i, bits, n in run(f"document_byte_entropy_order{order}")}
        assert set(got) == {i for i, t in raw.items() if t}
        for i, (bits, n) in got.items():
            t = raw[i]
            prev = [0, *t[:-1]] if order else [0] * len(t)
            pairs, m = collections.Counter(zip(prev, t)), collections.Counter(prev)
            assert n == len(t) and abs(bits - sum(-k * math.log2(k / m[p]) for (p, _), k in pairs.items()) / n) < 2e-6


def test_digest_and_crc(run, rows):
    want = {i: (None, None) if t is None else (hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for i, t in rows}
    assert {i: x for i, *x in run("document_content_digest")} == {i: list(x) for i, x in want.items()}
    got = dict(run("document_content_crc32"))
    assert set(got) == set(want) and all(t is None or int(got[i], 16) == zlib.crc32(t.encode()) for i, t in rows)


def test_matches_and_lanes(run, rows):
    want = []
    for i, t in rows:
        last = {}
        for k in range(len(t or "") - 3):
            g = t[k : k + 4]
            if g in last and k - last[g] <= 65536:
                want.append((i, k, k - last[g]))
            last[g] = k
    assert sorted(run("document_nearest_match"), key=repr) == sorted(want, key=repr)
    lanes = [(i, k + 1, p >> 5) for i, t in rows if t for k, p in enumerate([0, *t.encode()[:-1]])]
    assert sorted(run("document_literal_lanes"), key=repr) == sorted(lanes, key=repr)


def test_clusters(run, rows):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t in rows:
        for p, b in zip([0, *(t or "").encode()], (t or "").encode()):
            count[p][b] += 1
            total[p] += 1
    seeds = sorted(total, key=lambda c: (-total[c], c))[:16]
    cost = lambda c, s: round(sum(n * (math.log2(total[s] + 256) - math.log2(count[s][b] + 1)) for b, n in count[c].items()), 6)
    assert dict(run("document_context_clusters")) == {c: min(range(len(seeds)), key=lambda k: (cost(c, seeds[k]), k)) for c in total}


def test_repair(run, rows):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        n = (len(raw) + 3) // 4
        want += [(i, k, hashlib.sha256(raw[k * n : (k + 1) * n].ljust(n, b"\0")).hexdigest()) for k in range(4)] if raw else []
    assert sorted(run("document_parity_repair"), key=repr) == sorted(want, key=repr)
