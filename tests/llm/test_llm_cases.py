"""Brute-force versions of what SQL cannot express, and the hard cases of every operator: clashing columns, long texts, repeats, empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, chat, common, decontaminate, language, line_dedup, ngram_jaccard, quality, token_files, url_filter, warc

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ITEMS = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")


def over_documents(spark, items):
    """Every operator on documents, by name; each takes docs and gives rows that only depend on doc_id, text and lang."""
    return {
        "op1": lambda d: ngram_jaccard.ngram_jaccard_components(d, 3, 90),
        "op2": lambda d: quality.quality_rules(d, labels(spark)),
        "op3": lambda d: line_dedup.dedup_lines(d, short_repeats=True).select("doc_id", "text", "n_lines", "n_dropped"),
        "op6": lambda d: decontaminate.decontaminate(d, items).select("doc_id", "contaminated", "item_ids"),
        "op8": lambda d: token_files.token_file_round_trip(d, WORDS).select("doc_id", "n_tokens", "ids_crc32"),
        "op9": lambda d: language.language_id(d).select("doc_id", "held_out", "lang_pred"),
        "op10": lambda d: bpe.bpe_digest(d, RANKS, P.PATTERN),
    }


CLASHES = ["row", "_row", "_items", "items", "_dropped", "dropped", "n", "id", "key", "v", "fp1", "part", "data", "heavy", "class_id", "score", "held_out", "lang_pred", "languages", "quality", "kept", "component", "component_id", "n_tokens", "start", "name", "none", "h1", "place", "line", "at", "_hot", "a.b"]


def small_rows():
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "5", "km", "Anna"]) for _ in range(9))
    rows = [(i, "\n".join(line() for _ in range(3)), "en") for i in range(20)]
    return [*rows, (3, rows[3][1], "en"), (3, rows[4][1], "en"), (None, rows[5][1], None), (None, None, "en"), (30, "", "en"), (31, " \n\t", None)]


def as_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("op", ["op1", "op2", "op3", "op6", "op8", "op9", "op10"])
def test_clashing_columns_repeats_and_empty_tables(spark, op):
    items = spark.createDataFrame([(1, "alpha beta gamma delta 5 km"), (None, "beta gamma")], ITEMS)
    run = over_documents(spark, items)[op]
    docs = spark.createDataFrame(small_rows(), "doc_id long, text string, lang string")
    wide = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
    assert as_rows(run(wide)) == as_rows(run(docs))
    assert run(docs).count() == docs.count()
    assert run(wide.limit(0)).collect() == []


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame(small_rows(), "doc_id long, text string, lang string").select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
    empty = spark.createDataFrame([], ITEMS)
    for out in (line_dedup.dedup_lines(docs), decontaminate.decontaminate(docs, empty)):
        assert set(docs.columns) <= set(out.columns)
        got = out.select(*[F.col(common.quote(c)) for c in CLASHES]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"x{i}" for i in range(len(CLASHES)))]


def test_pages_and_chats_with_clashes_and_empty_tables(spark):
    extra = [F.lit("x").alias(c) for c in ("sha", "size", "lead", "payload", "refers_to", "file", "offset", "part", "m", "rule", "host", "path", "verdict", "enter", "leave", "c", "p")]
    pages = spark.createDataFrame([(1, "http://a.org/x", "p"), (2, None, "p"), (2, None, "p"), (None, "u", None), (5, "http://b.net/es/1", "")], "page_id long, url string, html string")
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", None), (1, 1, "user", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    for run, table in ((warc.warc_round_trip, pages), (url_filter.url_filter, pages), (chat.format_chats, chats)):
        assert as_rows(run(table.select("*", *extra))) == as_rows(run(table))
        assert run(table.limit(0)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "en"), (2, text + " end", "en"), (3, "x" * 300_000, "en"), (4, " " * 1_500_000, None), (5, "short text", "en")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(9, " ".join(words[70_000:70_040]))], ITEMS)
    run = {k: {r.doc_id: r for r in f(docs).collect()} for k, f in over_documents(spark, items).items()}
    n = len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert (run["op1"][1].n_shingles, run["op1"][2].component_id, run["op1"][3].component_id) == (n, 1, 3)
    assert (run["op2"][1].n_words, run["op2"][4].n_words) == (len(words), 0)
    assert run["op3"][1].text == text and run["op3"][3].n_dropped == 0
    assert [run["op6"][i].contaminated for i in range(1, 6)] == [True, True, False, False, False]
    assert run["op8"][4].n_tokens == 1 and run["op9"][4].lang_pred == "und"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert all(run["op10"][i].decoded_sha256 == digest(t) for i, t in ((1, text), (3, "x" * 300_000), (4, " " * 1_500_000)))


def test_long_runs_encode_as_the_pattern_does():
    enc, rng = bpe.encoding(RANKS, P.PATTERN), random.Random(1)
    signs = [" ", "\n", "\t", "a", "é", "1", "!", "'", "'s", "'ll", "don't", "s", "r", "e", "  ", "　", "́", "\x1c", "\x85", "​", "᠎"]
    for _ in range(20_000):
        t = "".join(rng.choice(signs) * rng.choice([1, 1, 2, 5, 9]) for _ in range(rng.randint(1, 12)))
        got = [enc._encode_single_piece(x) if alone else enc.encode_ordinary(x) for x, alone in bpe.long_run_pieces(t, 4)]
        assert sum(got, []) == enc.encode_ordinary(t), t
    for run in (" ", "\n", "\t", " \n", "a", "!", "7", "é"):
        for form in ("{}", "x{}", "{}y", "x y{} z"):
            text = form.format(run * (150_000 // len(run)))
            assert bpe.encode(enc, text) == enc.encode_ordinary(text)
            text = form.format(run * (5_000_000 // len(run)) if run.isspace() else run * 400_000)
            assert enc.decode(bpe.encode(enc, text)) == text


def test_special_strings_encode_as_the_library_does(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "It's", "don't", "x" * 70, ".,", " ", "  ", "\n", "é́", "A", "'ll", "12", "☃!"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    enc = token_files.WordEncoder(WORDS, 2)
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t
    assert all(len(w) <= token_files.CACHE_CHARS for w in enc.known)


def template(text):
    """plain and template words, with placeholders by kind."""
    marks = {"name": "\ue001", "number": "\ue002", "unit": "\ue003"}
    t = regex.sub(r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}[\p{L}\p{M}]*", marks["name"], text)
    t = regex.sub(r"\d+(?:[.,:/]\d+)*", marks["number"], t)
    t = regex.sub(rf"({marks['number']}\s?)(?:{'|'.join(decontaminate.UNITS)})(?![\p{{L}}\p{{N}}])", lambda m: m[1] + marks["unit"], t, flags=regex.I)
    split = lambda x: regex.sub(r"[^\p{L}\p{N}\p{M}\ue001-\ue003\s]+", "", x).split()
    return split(text), split(t.lower())


def items_found(doc, items, size, least):
    plain, words = template(doc)
    out = []
    for item, text in items:
        own, mine = template(text)
        if not mine:
            continue
        whole = len(mine) < size
        windows = [(0, len(mine))] if whole else [(a, size) for a in range(len(mine) - size + 1)]
        slot = lambda w: any(m in w for m in "\ue001\ue002\ue003")
        mostly = [2 * sum(map(slot, mine[a : a + n])) > n for a, n in windows]
        same, held = set(), set()
        for (a, n), much in zip(windows, mostly, strict=True):
            if much or whole:
                exact = [w.lower() for w in own[a : a + n]]
                if any([w.lower() for w in plain[b : b + n]] == exact for b in range(len(plain) - n + 1)):
                    held.add(a)
            if not much:
                for b in [0] if whole and len(words) == n else [] if whole else range(len(words) - n + 1):
                    if words[b : b + n] == mine[a : a + n] and consistent(own, mine, plain, words, b - a, windows, mostly, slot):
                        same.add(a)
        held |= same
        shares = [len(held) / len(windows)] + ([len(same) / (len(windows) - sum(mostly))] if sum(mostly) < len(windows) else [])
        if max(shares) >= least:
            out.append(item)
    return out


def consistent(own, mine, plain, words, shift, windows, mostly, slot):
    """Whether all template windows that match at this shift map each slot value to one value."""
    values = {}
    for (a, n), much in zip(windows, mostly, strict=True):
        if much or a + shift < 0 or words[a + shift : a + shift + n] != mine[a : a + n] or (n < 8 and len(words) != n):
            continue
        for k in range(a, a + n):
            if slot(mine[k]):
                values.setdefault(own[k].lower(), set()).add(plain[k + shift].lower())
    return all(len(v) == 1 for v in values.values())


def test_decontamination_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["how", "many", "red", "apples", "does", "have", "in", "total", "Tom", "Anna", "Bob", "5", "7", "12,5", "km", "kg", "now,", "left?"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 8, 9, 12, 16])))) for i in range(14)] + [(90, ""), (91, "...")]
    docs = []
    for d in range(120):
        body = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if body:
                body[rng.randrange(len(body))] = word()
        docs.append((d, " ".join([*(word() for _ in range(rng.choice([0, 0, 2, 5]))), *body, *(word() for _ in range(rng.choice([0, 0, 3])))])))
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    want = {d: items_found(t, items, decontaminate.WINDOW, decontaminate.MIN_SHARE) for d, t in docs}
    assert {r.doc_id: r.item_ids for r in got} == want
    assert 20 < sum(map(bool, want.values())) < 120


def mixture(log_p, grams, chosen):
    """Shares and log-likelihood after EM from even shares of the chosen languages, one n-gram at a time."""
    share = [1 / len(chosen) if k in chosen else 0.0 for k in range(log_p.shape[1])]
    for _ in range(language.EM_STEPS):
        new = [0.0] * len(share)
        for g in grams:
            parts = [s * np.exp(log_p[g, k]) for k, s in enumerate(share)]
            for k, x in enumerate(parts):
                new[k] += x / sum(parts) / len(grams)
        share = new
    return share, sum(np.log(sum(s * np.exp(log_p[g, k]) for k, s in enumerate(share))) for g in grams)


def test_mixtures_by_brute_force():
    rng = random.Random(3)
    kinds = {"a": "abcdef", "b": "defghi", "c": "mnopqr"}
    make = lambda kind, n: " ".join("".join(rng.choice(kinds[kind]) for _ in range(4)) for _ in range(n))
    sums = np.full((language.BUCKETS, 3), language.SMOOTH)
    for k, kind in enumerate(kinds):
        np.add.at(sums[:, k], language.ngrams(make(kind, 3000)), 1)
    model = language.Languages(list(kinds), np.log(sums / sums.sum(axis=0)))
    texts = [" ".join(make(kind, rng.choice([0, 3, 10, 30])) for kind in kinds) for _ in range(25)] + [make("a", 20), "", "1 2", "zzzz"]
    sizes = set()
    for text, (lead, score, chosen) in zip(texts, model.infer(texts), strict=True):
        grams = language.ngrams(text)
        if not language.has_letter(text):
            assert (lead, score, chosen) == ("und", 0.0, [])
            continue
        alone = model.log_p[grams].sum(axis=0)
        share, best = [float(k == alone.argmax()) for k in range(3)], alone.max()
        full, _ = mixture(model.log_p, grams, range(3))
        order = sorted(range(3), key=lambda k: -full[k])
        for k in (2, 3):
            if full[order[k - 1]] < language.LEAST_SHARE:
                break
            s, ll = mixture(model.log_p, grams, order[:k])
            if ll - best <= language.PENALTY * np.log1p(len(grams)):
                break
            share, best = s, ll
        assert lead == list(kinds)[int(np.argmax(share))] and abs(score - max(share)) < 1e-6
        assert {x: round(v, 5) for x, v in chosen} == {list(kinds)[k]: round(v, 5) for k, v in enumerate(share) if v > 0}
        sizes.add(len(chosen))
    assert sizes == {1, 2, 3}


def test_gradient_and_calibration():
    rng = np.random.default_rng(4)
    n, size = 12, 20
    idx = [rng.choice(size - 1, 6, replace=False) for _ in range(n)]
    row, col = np.repeat(np.arange(n), 6), np.concatenate(idx)
    val, y, use = rng.random(len(col)).astype(np.float32), rng.integers(0, 2, n).astype(float), np.arange(n) % 4 != 0

    def loss(x):
        z = np.array([sum(val[k] * x[col[k]] for k in range(len(col)) if row[k] == i) + x[-1] for i in range(n)])
        return np.mean((np.log1p(np.exp(z)) - y * z)[use]) + quality.L2 / 2 * (x[:-1] ** 2).sum()

    x = rng.normal(size=size)
    steps = np.eye(size) * 1e-5
    near = np.array([(loss(x + s) - loss(x - s)) / 2e-5 for s in steps])
    assert np.abs(near - quality.loss_gradient(x, row, col, val, y, use)).max() < 1e-4
    z = rng.normal(size=200) * 2
    t = (rng.random(200) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    cost = lambda a, b: np.mean(np.log1p(np.exp(a * z + b)) - target * (a * z + b))
    least = min(cost(a, b) for a in np.arange(0, 2, 0.05) for b in np.arange(-2, 1, 0.05))
    assert cost(*quality.platt_fit(z, t)) <= least + 1e-3


def test_character_ngrams_are_of_code_points():
    _, chars = quality.buckets("жёлтый".encode(), quality.word_hashes("жёлтый".encode()))
    assert len(chars) == 3
    _, again = quality.buckets("xжёлт".encode(), quality.word_hashes(b"x"))
    assert again[1] == chars[0]


def chats_of_least_cost(turns):
    """All rendered texts of least cost, by trying every label of every turn."""
    best, texts = None, set()
    for path in itertools.product((1, 2, 3), repeat=len(turns)):
        cost, shown, state = 0.0, "", 0
        for (role, text), r in zip(turns, path, strict=True):
            c, how, between = chat.link(state, r)
            cost += c + (chat.RELABEL if chat.STATES[r] != chat.canonical(role) else 0.0)
            for e in between:
                shown += ("" if state == 0 else "<|end|>\n") + f"<|{chat.STATES[e]}|>\n"
                state = e
            shown += "\n" + text if how == "merge" else ("" if state == 0 else "<|end|>\n") + f"<|{chat.STATES[r]}|>\n{text}"
            state = r
        cost += float(chat.END[state])
        for e in {2: [3], 1: [2, 3]}.get(state, []):
            shown += f"<|end|>\n<|{chat.STATES[e]}|>\n"
        if best is None or cost < best - 1e-9:
            best, texts = cost, set()
        if cost < best + 1e-9:
            texts.add(shown + "<|end|>\n")
    return texts


def test_rendered_chats_by_brute_force(spark):
    rng = random.Random(8)
    chats = {c: [(rng.choice(["user", "assistant", "system", "Human", "tool", None]), f"t{c}.{t}") for t in range(rng.randint(1, 5))] for c in range(40)}
    rows = [(c, t, role, text) for c, turns in chats.items() for t, (role, text) in enumerate(turns)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "piece").collect()
    for c, turns in chats.items():
        assert "".join(r.rendered for r in got if r.conv_id == c) in chats_of_least_cost(turns)


def test_urls_by_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice([*url_filter.STRICT, *url_filter.SOFT, "com", "net", "example", "www", "en", "es", "Casino", "xwin", "é", ""])
    urls = [rng.choice(["http://", "", "https://a."]) + "".join(part() + rng.choice(["/", ".", "-", "?", "#", ":", "1"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        url = urls[r.page_id]
        rest = url.partition("://")[2] if "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        found = lambda terms: sum(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", url, re.I | re.A) is not None for t in terms)
        want = max(fits)[1:] if fits else (None, "block" if found(url_filter.STRICT) or found(url_filter.SOFT) >= 2 else "allow")
        assert (r.host, r.path if "://" in url else "", r.rule, r.verdict) == (host, path, *want), url


def test_scratch_is_swept(spark):
    scratch = common.Scratch(spark, "swept")
    back = scratch.cut(spark.range(5))
    assert back.count() == 5 and common.sweep(spark) >= 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_stages_keep_extra_columns(spark, tmp_path):
    extra = [F.lit(f"x{i}").alias(c) for i, c in enumerate([*CLASHES, "n_lines", "n_dropped", "contaminated"])]
    docs = spark.createDataFrame([(i, t, g, len(t or "")) for i, t, g in small_rows()], "doc_id long, text string, lang string, n_chars long").select("*", *extra)
    spark.createDataFrame([(1, "alpha beta")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert [tuple(r) for r in got.select(*[common.quote(c.columns[0]) for c in [spark.range(1).select(e) for e in extra]]).distinct().collect()] == [tuple(f"x{i}" for i in range(len(extra)))]
