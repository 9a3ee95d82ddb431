"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other values keeps its template.
Windows of template words are joined by hash with those of the benchmark; where windows line up, the
values in the slots must map consistently, one benchmark value to one value of the document. Windows that are
mostly slots, and items shorter than a window, are found word for word in the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, fresh, quote, small

#: Words in a window.
WINDOW = 8
#: Share of an item's windows that a document must hold.
MIN_SHARE = 0.3
#: Placeholders of private use, so no text word equals one.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours?", "days?", "weeks?", "months?", "years?", "meters?", "kilometers?", "miles?", "dollars?", "euros?", "cents?", "percent")


def _split(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}\\p{{M}}{NAME}-{UNIT}\\s]+", ""))
    return F.split(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+")


def plain_words(text: Column) -> Column:
    """Words without punctuation, place for place those of template_words."""
    return _split(text)


def template_words(text: Column) -> Column:
    """Lower-cased words without punctuation, with placeholders.

    A name is a capitalised word after another word in the sentence; a number may hold separators; a unit follows a number.
    """
    t = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}[\p{L}\p{M}]*", NAME)
    t = F.regexp_replace(t, r"\d+(?:[.,:/]\d+)*", NUMBER)
    t = F.regexp_replace(t, f"({NUMBER}\\s?)(?i:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}")
    return _split(F.lower(t))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_keys(hashes: Column, window: int) -> Column:
    """Hash of every window of words, from the hashes of the words; fewer words are one window, no word none."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    return F.when(n >= window, many).when((n > 1) | (F.get(hashes, F.lit(0)) != F.xxhash64(F.lit(""))), F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))


def exact_keys(hashes: Column, sizes: list[int]) -> Column:
    """Hash of every run of words of each size, apart from those of window_keys; none where the words are fewer."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - n + 1, F.lit(1)))
        return F.when(F.size(hashes) >= n, F.transform(starts, lambda i: _exact_key(F.slice(hashes, i, n)))).otherwise(F.array().cast("array<long>"))

    return F.concat(*map(runs, sizes))


def _exact_key(hashes: Column) -> Column:
    return F.xxhash64(F.lit("exact"), F.size(hashes), hashes)


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}-{UNIT}]")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """(row key, item_id, share) for every document row and item that share enough consistent windows.

    The row key is a struct of doc_id and a hash of the text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.where("text is not null and item_id is not null").select("item_id", template_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("p"))
    items = items.select("item_id", "t", "p", F.posexplode(window_keys(word_hashes(F.col("t")), window)).alias("at", "key"))
    words, own = F.slice("t", F.col("at") + 1, window), F.slice("p", F.col("at") + 1, window)
    items = items.withColumn("slots", F.size(F.filter(words, _is_slot)))
    mostly = 2 * F.col("slots") > F.size(words)
    items = scratch.cut(items.select("item_id", "at", "key", "slots", own.alias("own"), F.transform(words, _is_slot).alias("mask"), mostly.alias("mostly"), (F.size("t") < window).alias("brief")))
    #: a window of slots says nothing as a template, and a brief item none of longer texts: these are sought word for word
    exact = scratch.cut(items.where("mostly or brief").select("item_id", "at", _exact_key(F.transform("own", lambda w: F.xxhash64(F.lower(w)))).alias("key"), F.size("own").alias("n")))
    sizes = sorted(r.n for r in exact.select("n").distinct().collect())
    every = items.groupBy("item_id").agg(F.countDistinct("at").alias("n_all"))
    items = items.where("not mostly")
    size = items.count() + exact.count()
    row = F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("row")
    rows = docs.where("text is not null").select(row, template_words(F.col("text")).alias("t"), *([F.transform(plain_words(F.col("text")), F.lower).alias("p")] if sizes else []))
    #: binds the hashes of the words once for all windows of a text
    keys = F.flatten(F.transform(F.array(word_hashes(F.col("t"))), lambda h: window_keys(h, window)))
    if sizes:
        #: after the windows of the template, so that those keep their places
        keys = F.concat(keys, F.flatten(F.transform(F.array(word_hashes(F.col("p"))), lambda h: exact_keys(h, sizes))))
    seen = rows.select("row", F.posexplode(keys).alias("pos", "key"))
    sought = items.select("key", "item_id", "at", "slots", F.lit(False).alias("exact"))
    sought = sought.union(exact.select("key", "item_id", "at", F.lit(0), F.lit(True)))
    found = scratch.cut(seen.join(small(sought, size), "key").select("row", "pos", "item_id", "at", "slots", "key", "exact"))
    hits = found.where("not exact")
    shift = (F.col("pos") - F.col("at")).alias("shift")
    #: only windows with slots are read again for their values
    slotted = hits.where("slots > 0").select("row", "pos", "item_id", "at", shift)
    wanted = scratch.cut(slotted.select("row").distinct())
    need = wanted.count()
    bad = None
    if need:
        values = docs.where("text is not null").select(row, plain_words(F.col("text")).alias("p")).join(small(wanted, need), "row")
        pairs = slotted.join(values, "row").join(small(items.select("item_id", "at", "own", "mask"), size), ["item_id", "at"])
        slot = F.arrays_zip(F.col("own").alias("own"), F.slice("p", F.col("pos") + 1, window).alias("its"), F.col("mask").alias("mask"))
        pairs = pairs.select("row", "item_id", "shift", F.explode(slot).alias("s")).where("s.mask")
        clash = pairs.groupBy("row", "item_id", "shift", F.lower("s.own").alias("value")).agg(F.min(F.lower("s.its")).alias("a"), F.max(F.lower("s.its")).alias("b"))
        bad = clash.where("a <> b").select("row", "item_id", "shift").distinct()
    aligned = hits.select("row", "item_id", "at", shift)
    if bad is not None:
        aligned = aligned.join(bad, ["row", "item_id", "shift"], "left_anti")
    total = items.groupBy("item_id").agg(F.countDistinct("at").alias("n_template"))
    total = every.join(total, "item_id", "left")
    if sizes:
        aligned = aligned.select("row", "item_id", "at", F.lit(False).alias("exact")).union(found.where("exact").select("row", "item_id", "at", "exact"))
    else:
        aligned = aligned.withColumn("exact", F.lit(False))
    held = aligned.groupBy("row", "item_id").agg(F.countDistinct("at").alias("n_held"), F.countDistinct(F.when(~F.col("exact"), F.col("at"))).alias("n_same"))
    #: of the windows that count as templates, or of all
    share = F.greatest(F.col("n_same") / F.col("n_template"), F.col("n_held") / F.col("n_all"))
    return held.join(small(total, size), "item_id").where(share >= min_share).select("row", "item_id", share.alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """docs (doc_id, text, ...) with every column, and contaminated boolean, item_ids (sorted array of the items found).

    An item is found where at least min_share of its windows of template words occur in the text, with slot values that
    map consistently at each alignment. Windows of which more than half the words are slots count where the text holds them word for word, but
    for case and punctuation; the share is the larger of that of the other windows and that of all. An item of fewer words
    than a window is found in a text that is the same template as a whole, or that holds it word for word.
    Null texts, empty texts and items, and an empty benchmark: not contaminated; items of a null item_id are not sought. Repeated rows and null
    doc_ids keep their rows. Columns of docs named contaminated or item_ids are replaced, others stay whatever their names. Very long texts
    are read whole. An empty docs gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate-out")
    found = contaminated_pairs(docs, benchmark, window, min_share).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    found = scratch.cut(found)
    keep = [F.col(quote(c)) for c in docs.columns if c not in ("contaminated", "item_ids")]
    row, items = fresh(docs, "row"), fresh(docs, "_items")
    found = found.withColumnsRenamed({"row": row, "_items": items})
    both = docs.select(*keep, F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias(row)).join(small(found, found.count()), row, "left")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return both.select(*keep, F.col(items).isNotNull().alias("contaminated"), F.coalesce(items, F.array().cast(f"array<{kind}>")).alias("item_ids"))
