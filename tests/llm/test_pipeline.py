"""The pipeline's stages against brute force, with nulls, repeated rows and empty tables."""

import hashlib
import itertools
import random

import public_tokenizers

import corpus_pipeline
from cairn.llm import bpe

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "xx", len(t or "")) for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def near_groups(rows):
    """One row of each group, by the smallest (doc_id, null last); rows without words stay."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    best = {}
    for k, g in enumerate(group):
        key = (rows[k][0] is None, rows[k][0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, k)
    return sorted((rows[k] for _, k in best.values()), key=repr)


def near_rows():
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    a, b, c = text(), text(), text()
    return a, b, c, a + " more", b + " more"


def test_near_duplicates_of_unique_ids(spark):
    a, b, c, a2, b2 = near_rows()
    rows = [(1, a), (2, b), (3, a2), (4, c), (5, b2), (6, a), (7, ""), (8, " ")]
    assert rows_of(corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "")) == near_groups(rows)


def test_near_duplicates_by_row(spark):
    a, b, c, a2, b2 = near_rows()
    rows = [(1, a), (5, a2), (5, c), (6, b), (6, b), (None, b2), (None, c + " x"), (7, None), (7, None), (8, "")]
    want = near_groups(rows)
    assert (5, c) in want and (6, b) in want and len(want) == 6
    assert rows_of(corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "")) == want
    alone = [(None, a), (None, a), (None, a2 + " y")]
    assert len(rows_of(corpus_pipeline.near_duplicate_stage(spark, table(spark, alone), ""))) == 1


ALPHABETS = {"one": "abcdef", "two": "mnopqr", "three": "uvwxyz"}


def language_rows(rng):
    make = lambda kind, n: " ".join("".join(rng.choice(ALPHABETS[kind]) for _ in range(5)) for _ in range(n))
    rows = [(i, make(kind, 40), kind) for i, kind in zip(range(240), itertools.cycle(ALPHABETS))]
    mixed = make("one", 80) + " " + make("two", 70) + " " + make("three", 50)
    return [*rows, (900, mixed, "one"), (901, None, "one"), (902, "12 -- 3", "two"), (903, "", "two"), (None, make("two", 40), None), (3, rows[3][1], rows[3][2])]


def test_language_stage_keeps_multilingual_documents(spark):
    rows = language_rows(random.Random(4))
    docs = spark.createDataFrame([(i, t, lang, len(t or "")) for i, t, lang in rows], SCHEMA)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(i, t, "two" if i is None else lang) for i, t, lang in rows if i not in (901, 902, 903)]
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.language_stage(spark, docs.limit(0), "").count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def lines_left(rows):
    """Texts without repeated lines, in order of doc_id (null first); equal rows are one; emptied documents go."""
    seen, out = [], {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        keep, lines = [], [] if t is None else t.split("\n")
        for x in lines:
            gone = x in seen if len(x) < 20 else any(len(y) >= 20 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in seen)
            if not x.strip() or not gone:
                keep.append(x)
            seen.append(x)
        if len(keep) == len(lines) or "".join(keep).strip():
            out[i, t] = None if t is None else "\n".join(keep)
    return [(i, out[i, t]) for i, t in rows if (i, t) in out]


def digests(rows):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ITEM = "mnopq rmnop qrmno pqrmn opqrm nopqr mmnno ppqqr rrmmn"


def corpus():
    rng = random.Random(9)
    word = lambda kind: "".join(rng.choice(ALPHABETS[kind]) for _ in range(5))
    line = lambda kind: " ".join(word(kind) for _ in range(8))
    common = {k: line(k) for k in ALPHABETS}
    rows = []
    for i, kind in zip(range(90), itertools.cycle(ALPHABETS)):
        rows.append((i, "\n".join([line(kind) for _ in range(4)] + ([common[kind], "abc", ""] if i % 4 == 0 else [])), kind))
    text = rows[10][1]
    rows += [(200, common["one"] + "\nabc", "one"), (201, common["one"][:-1], "one"), (202, f"{line('two')} {ITEM} {line('two')}", "two"), (203, None, "two"), (204, "", "one"), (205, "12 -", "one")]
    rows += [(206, text, "two"), (207, text.replace("\n", " ") + " " + word("two"), "two"), (5, rows[5][1], rows[5][2]), (None, line("two") + "\n" + line("two"), "two")]
    return rows


def clean(rows):
    return [(i, t) for i, t in rows if ITEM not in (t or "")]


def test_each_stage_and_run(spark, tmp_path):
    full = corpus()
    rows = [(i, t) for i, t, _ in full]
    docs = spark.createDataFrame([(i, t, k, len(t or "")) for i, t, k in full], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    lines = corpus_pipeline.line_stage(spark, docs, folder)
    assert lines.columns == docs.columns and rows_of(lines) == sorted(lines_left(rows), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    assert rows_of(corpus_pipeline.benchmark_stage(spark, docs, folder)) == sorted(clean(rows), key=repr)
    assert sorted((tuple(r) for r in corpus_pipeline.token_stage(spark, docs, folder).collect()), key=repr) == digests(rows)
    known = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    want = digests(clean(near_groups(lines_left(known))))
    got = corpus_pipeline.run(spark, folder)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
