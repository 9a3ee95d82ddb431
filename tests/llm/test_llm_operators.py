"""The training-data operators against brute force, with nulls, empty texts, ties, repeats and extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, common, decontaminate, language, line_dedup, ngram_jaccard, quality, queries, token_files, url_filter, warc

WORDS = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
DOCS = "doc_id long, text string, lang string, n_lines string, component string"


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def near_copies(seed=3, n=60):
    rng, rows = random.Random(seed), []
    bases = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, rows[0][1].upper()), (503, rows[0][1].upper()), (None, rows[1][1])]


@pytest.mark.parametrize("width,percent,blocks", [(3, 90, False), (5, 80, False), (3, 90, True), (2, 60, True)])
def test_ngram_join(spark, monkeypatch, width, percent, blocks):
    """With blocks: classes of many blocks, many fragments, small batches with hot n-grams."""
    rows = near_copies(n=150 if blocks else 60)
    if blocks:
        for name, value in (("BLOCK_SETS", 5), ("HEAVY_ROWS", 2), ("COUNTED", 64), ("FRAGMENT_GRAMS", 16), ("HOT_COPIES", 2)):
            monkeypatch.setattr(ngram_jaccard, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = {i: grams(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = ngram_jaccard.ngram_jaccard_components(frame(spark, rows), width, percent).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    assert all(r.component_id == (None if r.doc_id is None else root[r.doc_id]) for r in got)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id is not None)


def test_ngram_join_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, a), (7, b), (8, a + " x"), (9, b + " y"), (5, "x y z"), (None, a)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_jaccard.ngram_jaccard_components(frame(spark, rows), 3, 90).collect())
    assert got == [(0, 48, 0), (5, 1, 5), (7, 48, 7), (7, 48, 7), (8, 49, 7), (9, 49, 7)]


def test_partial_overlaps_sum_to_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(9)]
    owner, grams = np.repeat(np.arange(9), [len(x) for x in sets]), np.concatenate(sets)
    parts = [ngram_jaccard.partial_overlaps(owner[grams % 3 == k], grams[grams % 3 == k], 9) for k in range(3)]
    assert (sum(parts) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_owners_of_cut_rows_come_back():
    names = np.array([7, -3, 1 << 60], np.int64)
    for counts in ([1, 2, 255], [256, 1, 3], [1, 70_000, 2]):
        held = ngram_jaccard._short(np.array(counts))
        assert (ngram_jaccard._owners(names.tobytes(), held) == np.repeat(names, counts)).all()
    assert [len(ngram_jaccard._short(np.array([1, n]))) for n in (255, 256, 65_535, 65_536)] == [2, 4, 4, 8]


def test_ngram_join_of_nothing(spark):
    assert ngram_jaccard.ngram_jaccard_components(frame(spark, [])).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_edit_distance(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 8))), "".join(rng.choice("abé") for _ in range(rng.randint(0, 8)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), 2).alias("near"))
    assert all(r.near == (distance(r.a, r.b) <= 2) for r in df.collect())


def test_line_dedup(spark):
    rng = random.Random(5)
    base, rows = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(18, 30))) for _ in range(30)], []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = "z"
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, base[0])]
    seen, want = [], {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        keep = []
        for x in [] if t is None else t.split("\n"):
            if len(x) < 20 or not any(distance(x, y) <= 2 for y in seen):
                keep.append(x)
            if len(x) >= 20:
                seen.append(x)
        want[d] = None if t is None else "\n".join(keep)
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_short_repeats(spark, tmp_path):
    rng = random.Random(8)
    short = ["Les.", "Of, edti.", "é", "  ", "", "\t", "Les", " Les."]
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(18, 24))) for _ in range(12)]
    rows = [(d, "\n".join(rng.choice(short + base) for _ in range(rng.randint(1, 6)))) for d in range(40)]
    rows += [(100, None), (101, ""), (None, "Les.\nLes.")]
    seen, want = [], {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        keep = []
        for x in [] if t is None else t.split("\n"):
            gone = x in seen if len(x) < 20 else any(len(y) >= 20 and distance(x, y) <= 2 for y in seen)
            if not x.strip() or not gone:
                keep.append(x)
            seen.append(x)
        want[d] = None if t is None else "\n".join(keep)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want


def edited(rng, line, n):
    """The line after n random edits of one character."""
    x = list(line)
    for _ in range(n):
        at = rng.randint(0, len(x))
        x[at : at + rng.choice([0, 1])] = rng.choice([[], ["é"], ["z"], ["𝄞"]])
    return "".join(x)


def coarse(name, threshold, min_chars):
    groups = line_dedup.coarse_groups(F.length(name), threshold, min_chars)
    return F.flatten(F.transform(groups, lambda g: line_dedup.coarse_keys(F.col(name), F.length(name), g, threshold)))


def test_near_lines_share_a_coarse_key(spark):
    rng = random.Random(13)
    for threshold, min_chars in itertools.product([0, 1, 2, 3, 20], [0, 5, 20]):
        rows = []
        while len(rows) < 300:
            a = "".join(rng.choice("abcdefghijklmno é") for _ in range(rng.choice([20, 31, 32, 33, 47, 48, 50, rng.randint(0, 80)])))
            b = edited(rng, a, rng.randint(0, threshold))
            if min(len(a), len(b)) >= min_chars:
                rows.append((a, b))
        df = spark.createDataFrame(rows, "a string, b string")
        df = df.select("a", "b", F.arrays_overlap(coarse("a", threshold, min_chars), coarse("b", threshold, min_chars)).alias("share"))
        assert all(r.share for r in df.collect()), (threshold, min_chars)


def test_line_dedup_makes_few_rows_of_lines_without_partners(spark):
    rng, lines = random.Random(14), 2000
    text = ["\n".join("".join(rng.choice("abcdefghij ") for _ in range(rng.randint(60, 300))) for _ in range(10)) for _ in range(lines // 10)]
    docs = frame(spark, list(enumerate(text)))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert line_dedup.dedup_lines(docs, short_repeats=True).where("n_dropped > 0").count() == 0
    made = []
    for k in range(before, store.executionsCount()):
        run = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() == "Generate" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    assert lines <= max(made) <= 6 * lines


@pytest.mark.parametrize("blocks", [common.BROADCAST_BLOCKS, 1])
def test_marked_ids(spark, monkeypatch, blocks):
    monkeypatch.setattr(common, "BROADCAST_BLOCKS", blocks)
    rng, scratch = random.Random(15), common.Scratch(spark, "test-marked")
    ids = [p * 2**33 + k for p in (0, 1, 7, 2**29 - 1) for k in [*range(200), 4095, 4096, *rng.sample(range(200, 20000), 100)]]
    some = {i for i in ids if rng.random() < 0.4 or i % 4096 == 63}
    df, chosen = spark.createDataFrame([(i, str(i)) for i in ids], "id long, line string"), spark.createDataFrame([(i,) for i in some], "id long")
    for few in (chosen, chosen.limit(0)):
        got = common.marked(df, few, "found", scratch)
        assert got.columns == ["id", "line", "found"]
        assert {(r.id, r.line, r.found) for r in got.collect()} == {(i, str(i), few is chosen and i in some) for i in ids}


def test_line_dedup_leaves_texts_of_lines_where_they_are(spark, monkeypatch):
    """However many lines may have a partner: their ids go to the lines, not the lines to their ids."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    cut, shuffled = common.Scratch.cut, []

    def seen(self, df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffled.append("letters" in df.columns and "SortMergeJoin" in plan)
        return cut(self, df)

    monkeypatch.setattr(common.Scratch, "cut", seen)
    rng = random.Random(16)
    lines = ["".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(40)]
    docs = frame(spark, [(i, x) for i, x in enumerate(lines)] + [(100 + i, "z" + x) for i, x in enumerate(lines)])
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert line_dedup.dedup_lines(docs).where("n_dropped = 1").count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert shuffled and not any(shuffled)


def test_quality_counts_and_model(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(rng.choice(WORDS).upper() + "###" for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])] + [(900, None), (901, "a b c\na b c\n\n a"), (902, "x " * 40)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120) if i % 3] + [(None, 1, 0), (901, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows), labels).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert tuple(got[i])[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
    assert all(got[i].kept == (i < 60) for i in range(120))
    assert not got[900].kept and not got[902].kept
    assert quality.quality_rules(frame(spark, rows[:3]), labels.limit(0)).where("kept").count() == 3


def test_language(spark):
    rng = random.Random(4)
    make = lambda kind: " ".join("".join(rng.choice(kind) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "one" if i % 2 else "two") for i in range(200)]
    rows += [(900, None, "one"), (901, "12 -- 3", "two"), (902, make("abcde") + " " + make("vwxyz") + " " + make("vwxyz"), None), (None, make("abcde"), "one")]
    got = {r.doc_id: r for r in language.language_id(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("one" if i % 2 else "two") and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert (got[900].lang_pred, got[901].lang_pred, got[None].lang_pred) == ("und", "und", "one")
    assert got[902].lang_pred == "two" and set(got[902].languages) == {"one", "two"} and abs(got[902].score - 2 / 3) < 0.1
    assert {r.lang_pred for r in language.language_id(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_decontamination(spark):
    docs = [
        (1, "Intro. If Tom has 12 apples and buys 5 kg of pears from Anna, how many does Tom have now in total?"),
        (2, "If Bob has 99 apples and buys 7 lb of pears from Eve, how many does Bob have now in total? Then more."),
        (3, "If Bob has 99 apples and buys 7 lb of pears from Eve, how many does Kim have now in total? Then more."),
        (4, None), (5, ""), (6, "unrelated text with 5 kg of something that is not there at all ok fine"), (None, "if  bob, walked!"),
    ]
    items = spark.createDataFrame([(7, "If Sam has 3 apples and buys 8 kg of pears from Lena, how many does Sam have now in total?"), (8, None), (9, ""), (10, "If bob walked")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(spark, docs), items).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [], 5: [], 6: [], None: [10]}


def test_decontamination_word_for_word(spark):
    numbers = "Solve 3 5 8 13 21 34 55 89 144 233"
    title = "The Old Man And The Sea By Ernest Hemingway Part One"
    mixed = "Count how many of the red apples are left: 3 5 8 13 21 34 55 89 144 233 377 610 987"
    items = [(1, numbers), (2, "Who wrote the play Hamlet?"), (3, title), (4, "12 34 56"), (5, mixed), (6, ""), (7, "...")]
    docs = [
        (1, f"First, a page. {numbers}, and then more text of no importance at all."),
        (2, "A quiz for all of us here today: who wrote the play Hamlet? Nobody knew it."),
        (3, f"I have read it: {title.upper()} and liked it very much indeed."),
        (4, "Solve 4 6 9 14 22 35 56 90 145 234, and then more text of no importance at all."),
        (5, "A quiz for all of us here today: who wrote the play Macbeth? Nobody knew it."),
        (6, "They are 12, 34 and 56"), (7, "12 34 56"), (8, "7 8 9"), (9, "Who wrote the play Hamlet?"), (10, "Who wrote the play"), (11, None), (12, ""),
        (13, "Count how many of the red apples are left: 4 6 9 14 22 35 56 90 145 234 378 611 988"),
        (14, "See 5 8 13 21 34 55 89 144 233 377 610 987 there."),
        (None, "By hand: 12 34 56, then the rest of a longer text with words."),
    ]
    want = {1: [1], 2: [2], 3: [3], 7: [4], 9: [2], 13: [5], 14: [1, 5], None: [4]}
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: want.get(k, []) for k, _ in docs}


def test_role_repair_is_least(spark):
    rng = random.Random(2)
    for _ in range(150):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 5))]
        cost = lambda path: sum((chat.STATES[x] != r) * chat.RELABEL + chat.link(p, x)[0] for r, x, p in zip(roles, path, (0, *path[:-1]), strict=True)) + chat.END[path[-1]]
        assert abs(min(map(cost, itertools.product((1, 2, 3), repeat=len(roles)))) - chat.repair(roles)[0]) < 1e-9


def test_long_conversations_span_partitions(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), f"t{t}") for t in range(400)] + [(2, 0, "human", None), (None, 1, None, "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "piece").collect()
    for conv in (1, 2, None):
        mine = [r for r in got if r.conv_id == conv]
        roles = [chat.canonical(r[2]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert abs(sum(r.cost for r in mine) - chat.repair(roles)[0]) < 1e-9
        opened = [r.role for r in mine if r.action != "merge"]
        assert all(chat.STATES.index(b) in chat.LEGAL[chat.STATES.index(a)] for a, b in zip(["", *opened], opened)) and opened[-1] == "assistant"


def test_warc(spark):
    pages = [(1, "http://a/\r\nx", "é" * 10), (2, None, "é" * 10), (3, "u", None), (4, "u", ""), (5, "v", "z"), (None, "w", "z")]
    got = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {1: None, 2: 1, 3: None, 4: 3, 5: None, None: None}
    assert {k: r.refers_to for k, r in got.items()} == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got.values())
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.payload_digest(data))


def test_urls(spark):
    urls = ["http://www.Example.com/en/1", "http://b.example.com/en/1", "http://x.net/es/", "no scheme", None, "http://com", "https://best-casino.org/", "http://casinos.org/", "http://free.org/win?x", "http://free.org/free"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow"]
    assert [r.rule for r in got][:4] == ["www.example.com/en/", "example.com/en/", "net/es/", None]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(5, "It's Σας ΟΔΟΣ.\nx  y"), (2, None), (9, ""), (3, "<|startoftext|> a\tb\r\nc"), (3, "again " * 300), (None, "null id")]
    got = token_files.token_file_round_trip(frame(spark, rows), path).orderBy("start").collect()
    at = 0
    for r in got:
        fits = [t for i, t in rows if i == r.doc_id and (ids := [*tok.encode(t or "", add_special_tokens=False).ids, 2]) and (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.n_tokens, r.ids_crc32)]
        assert fits and r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, 2, 3, 3, 5, 9]


def test_bpe(spark):
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(ranks, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rng = random.Random(7)
    long = "".join(rng.choice(["a", " ", "  ", "\n", "don't", "é", "12", "!", " x"]) for _ in range(60_000))
    assert [i for p in bpe.safe_pieces(long, 1000) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(long)
    rows = [(1, "hello <|endoftext|> wörld\n\n x"), (2, None), (3, "")]
    for r in bpe.bpe_digest(frame(spark, rows), ranks, P.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), ranks, P.PATTERN, keep=("lang",)), ranks, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {k: v or "" for k, v in rows}
