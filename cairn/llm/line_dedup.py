"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line of l characters is cut into threshold + 1 even segments; a line within the threshold keeps one of
them, so each line publishes its segments under (length, segment number) and probes the substrings of
lengths and places where a partner's segment can lie. Shared keys give candidates; counts of
frequent letters prune them, and a banded bit-parallel edit distance verifies the rest. Before that, fewer and
coarser keys leave out the lines that can have no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import Scratch, fresh, marked, quote, skew_left_join

#: Largest edit distance (code points) between a line and an earlier one that drops it.
THRESHOLD = 2
#: Lines of fewer code points take no part in the edit join.
MIN_CHARS = 20
#: Occurrences from which a line is joined as a hot key.
HOT_LINE = 1000
#: Code points by which lengths are grouped for the coarse keys; the choice changes the cost, never the result.
LENGTHS = 16
#: Letters whose counts prune candidates before verification; the choice changes the cost, never the result.
LETTERS = "etaonisrhldcumfpgwbvk"


def _segment(length: Column, i: int, n: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 0) of n even ones; the last ones take the remainder."""
    size = F.floor(length / n).cast("int")
    short = n - length % n
    return 1 + i * size + F.greatest(F.lit(0), F.lit(i) - short), size + F.when(F.lit(i) >= short, 1).otherwise(0)


def segment_keys(line: Column, length: Column, threshold: int) -> Column:
    """The keys under which a line is indexed."""
    n = threshold + 1
    out = []
    for i in range(n):
        start, size = _segment(length, i, n)
        out.append(F.xxhash64(F.lit(i), length, line.substr(start, size)))
    return F.array(*out)


def probe_keys(line: Column, length: Column, threshold: int) -> Column:
    """The keys that lines of the same or a smaller length within the threshold may be indexed under.

    Segment i keeps its place up to i edits on its left and threshold - i on its right, which bounds the shift from both ends.
    """
    n = threshold + 1
    out = []
    for delta in range(threshold + 1):
        other = length - delta
        for i in range(n):
            start, size = _segment(other, i, n)
            low = max(-i, delta - (threshold - i))
            high = min(i, delta + (threshold - i))
            out += [F.xxhash64(F.lit(i), other, line.substr(start + shift, size)) for shift in range(low, high + 1)]
    return F.array(*out)


def coarse_groups(length: Column, threshold: int, min_chars: int) -> Column:
    """The groups of lengths, each named by its smallest length, of a line and of its shortest partner."""
    width = max(LENGTHS, threshold + 1)
    own, less = (F.greatest(F.lit(min_chars), n - n % width) for n in (length, length - threshold))
    return F.when(own == less, F.array(own)).otherwise(F.array(own, less))


def coarse_keys(line: Column, length: Column, group: Column, threshold: int) -> Column:
    """Keys of which two lines within the threshold share one in a group that both have, by the same rule for both.

    The group sets the size of threshold + 1 blocks, the first ones counted from the line's start and the others from its end. One block stays
    whole with i edits before and at most threshold - i after it, which bounds its shift; it is read at as many more
    places, and is as much longer, so that whichever line has it further left, both read the same part.
    """
    shifts = [min(i, threshold - i) for i in range(threshold + 1)]
    size = F.greatest(F.lit(0), F.floor((group - sum(shifts)) / (threshold + 1)).cast("int"))
    out = []
    for i, more in enumerate(shifts):
        if 2 * i <= threshold:
            start = i * size + (1 + sum(shifts[:i]))
        else:
            start = length - (threshold + 1 - i) * size + (1 - sum(shifts[i:]))
        out += [F.xxhash64(F.lit(i), group, line.substr(start + shift, size)) for shift in range(more + 1)]
    return F.array(*out)


def letter_counts(line: Column) -> Column:
    """Counts of frequent letters modulo 8, three bits each, in one long."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))) % 8
        out = out + n * F.lit(1 << (3 * k)).cast("long")
    return out


def letter_distance(a: Column, b: Column) -> Column:
    """A lower bound of the difference of two letter counts; an edit changes it by two at most."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        gap = (F.shiftright(a, 3 * k) - F.shiftright(b, 3 * k)).bitwiseAND(F.lit(7))
        total = total + F.least(gap, 8 - gap)
    return total


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most threshold.

    Banded and bit-parallel: after i characters of a, bit d + threshold of mask e says that a[:i] and b[:i + d] are within e edits. One
    character moves all diagonals of the band at once.
    """
    width = 2 * threshold + 1

    def matches(p, c, i):
        bits = [F.when(F.get(p, i + F.lit(k - threshold)) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    full = (1 << width) - 1

    def step(s, m):
        new = []
        for e in range(threshold + 1):
            r = s[f"r{e}"].bitwiseAND(m)
            if e:
                old = s[f"r{e - 1}"]
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full))
            new.append(r)
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)])

    start = F.struct(*[F.lit(sum(1 << (d + threshold) for d in range(e + 1))).alias(f"r{e}") for e in range(threshold + 1)])
    #: the characters of b are bound as a lambda variable, or each step would split b again
    masks = F.transform(F.array(_characters(b)), lambda p: F.transform(_characters(a), lambda c, i: matches(p, c, i)))[0]
    end = F.aggregate(masks, start, step)[f"r{threshold}"]
    gap = F.length(b) - F.length(a)
    return (F.abs(gap) <= threshold) & (end.bitwiseAND(_bit(gap, threshold)) != 0)


def _characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _bit(gap: Column, threshold: int) -> Column:
    """The bit of the diagonal that ends both strings."""
    out = F.lit(0)
    for d in range(-threshold, threshold + 1):
        out = F.when(gap == d, F.lit(1 << (d + threshold))).otherwise(out)
    return out


def _occurrences(docs: DataFrame, min_chars: int, short_repeats: bool) -> DataFrame:
    """One row per line of at least min_chars characters, with short_repeats also per shorter line that is not blank.

    A row has the line's text, hashes and place; a place is (doc_id, hash of the text, line number).
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    long = F.length("line") >= min_chars
    lines = lines.where(long | F.col("line").rlike(r"\S") if short_repeats else long)
    return lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("doc_id", "text_hash", "line_no").alias("place"), "line"
    )


def near_lines(lines: DataFrame, threshold: int, min_chars: int, scratch: Scratch) -> DataFrame:
    """id of every distinct line (id, line, place), of at least min_chars characters each, that is within threshold edits of another with an earlier place."""
    n = F.col("n_line")
    own, seek = segment_keys(F.col("line"), n, threshold), probe_keys(F.col("line"), n, threshold)
    #: the length and the keys are columns of their own, so that each is computed once and not for every key
    measured = lines.select("id", "line", F.length("line").alias("n_line"))
    #: first the lines that share a coarse key with another, in one shuffle of keys and ids; the rest is for these few
    by_key = Window.partitionBy("key")
    rows = measured.select("*", F.explode(coarse_groups(n, threshold, min_chars)).alias("group"))
    rows = rows.select("id", coarse_keys(F.col("line"), n, F.col("group"), threshold).alias("keys")).select("id", F.explode("keys").alias("key"))
    rows = rows.withColumn("low", F.min("id").over(by_key)).withColumn("high", F.max("id").over(by_key)).where("low < high")
    some = scratch.cut(rows.select("id").distinct())
    keyed = marked(measured, some, "found", scratch).where("found")
    keyed = scratch.cut(keyed.select("id", letter_counts(F.col("line")).alias("letters"), own.alias("own"), seek.alias("seek")))
    index = keyed.select(F.explode("own").alias("key"), F.col("id").alias("a"), F.col("letters").alias("sa"))
    probe = keyed.select(F.explode(F.array_distinct("seek")).alias("key"), F.col("id").alias("b"), F.col("letters").alias("sb"))
    close = letter_distance(F.col("sa"), F.col("sb")) <= 2 * threshold
    pairs = index.join(probe, (index.key == probe.key) & (F.col("a") != F.col("b")) & close)
    pairs = scratch.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.free(keyed)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = scratch.cut(marked(lines.select("id", "line", "place"), ids, "found", scratch).where("found").drop("found"))
    a = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("place").alias("pa"))
    b = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("place").alias("pb"))
    near = pairs.join(a, "a").join(b, "b").where(within_edits(F.col("la"), F.col("lb"), threshold))
    return near.select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """doc_id, text_hash, dropped: for each text that loses lines, the numbers (from 0) of those lines."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    seen = _occurrences(docs.where("text is not null"), min_chars, short_repeats)
    #: a hot line collapses in the partial aggregation
    lines = seen.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    lines = scratch.cut(lines.withColumn("id", F.monotonically_increasing_id()))
    near = scratch.cut(near_lines(lines.where(F.length("line") >= min_chars), threshold, min_chars, scratch))
    found = marked(lines.select("id", "h1", "h2", "place", "n"), near, "near", scratch).where("near or n > 1")
    found = scratch.cut(found.select("h1", "h2", F.col("place").alias("first"), "near", "n"))
    scratch.free(lines)
    here = skew_left_join(seen.select("h1", "h2", "place"), found, ["h1", "h2"], F.col("n") >= HOT_LINE, ["place"])
    gone = here.where(F.col("near") | (F.col("first") != F.col("place")))
    return gone.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash")).agg(F.sort_array(F.collect_set("place.line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with every column, text without its dropped lines, and n_lines, n_dropped.

    Lines are the parts of the text between line feeds. A line of at least min_chars code points is dropped when an earlier line of
    the corpus, in order of (doc_id, line number), is the same or within threshold edits. With short_repeats, a shorter line that is
    not blank is dropped when an earlier line is the same, without it shorter lines stay. The earliest of a group stays, so every content is kept once. Null texts stay null with 0 lines; null doc_ids come first in the order; rows
    that repeat doc_id and text are judged as one and all keep its first lines. Extra columns stay as they are, those named n_lines or
    n_dropped are replaced. An empty table gives an empty result. Very long lines cost time in proportion to their length.
    """
    row, dropped = fresh(docs, "_row"), fresh(docs, "_dropped")
    gone = dropped_lines(docs.select("doc_id", "text"), threshold, min_chars, short_repeats)
    gone = gone.select(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).alias(row), F.col("dropped").alias(dropped))
    both = docs.withColumn(row, F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))).join(gone, row, "left")
    lines = F.split("text", "\n")
    #: the lines are bound as a lambda variable, or each kept line would split the text again
    rest = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(dropped)), lambda i: F.get(x, i))
    kept = F.transform(F.array(lines), lambda x: F.array_join(rest(x), "\n"))[0]
    return both.select(
        *[F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(quote(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )
