"""Scalar functions on columns: paths, texts, numbers. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_safe_relative(path: Column) -> Column:
    """Non-empty, not rooted, no parent step."""
    return (path != "") & ~path.rlike("^(/|[A-Za-z]:)") & ~F.array_contains(F.split(path, "/"), "..")


def browse_path(path: Column) -> Column:
    """Backslashes become slashes, outer slashes go."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def same_or_child(path: Column, parent: Column) -> Column:
    return (path == parent) | F.startswith(path, F.concat(parent, F.lit("/")))


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def wildcard_regex(pattern: Column) -> Column:
    """A case-blind regular expression for * and ?."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def size_text(n: Column) -> Column:
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**power), 1))
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, shown(1, "KB")).when(n < 1024**3, shown(2, "MB")).otherwise(shown(3, "GB"))
    )


def parse_size(text: Column) -> Column:
    """Bytes of a number with an optional K, M or G; null when it is none."""
    unit = F.upper(F.regexp_extract(text, r"^\d+([KMGkmg]?)$", 1))
    n = F.regexp_extract(text, r"^(\d+)[KMGkmg]?$", 1)
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(n != "", n.try_cast("bigint") * scale)


def crc_text(crc: Column) -> Column:
    return F.coalesce(F.lpad(F.hex(crc), 8, "0"), F.lit(""))


def ratio_text(packed: Column, unpacked: Column) -> Column:
    return F.when(unpacked > 0, F.format_string("%.1f%%", 100.0 * packed / unpacked)).otherwise("n/a")


def shorten_middle(text: Column, most: int) -> Column:
    """Keeps (most - 3) / 2 characters of the head and the rest of the tail."""
    if most <= 3:
        return text.substr(1, most)
    head = (most - 3) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(most - 3 - head))))


def unix_minute(seconds: Column) -> Column:
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")).otherwise("")


def filetime_seconds(ticks: Column) -> Column:
    """Seconds since 1970 of 100 ns ticks since 1601."""
    #: whole numbers throughout: a double loses the last ticks
    return ((ticks - F.pmod(ticks, F.lit(10_000_000))) / F.lit(10_000_000).cast("decimal(20,0)")).cast("long") - F.lit(11_644_473_600)


def seconds_filetime(seconds: Column) -> Column:
    return (seconds + F.lit(11_644_473_600)) * F.lit(10_000_000)


def join_path(parent: Column, child: Column) -> Column:
    """parent/child; an empty or null side adds no separator."""
    return F.concat_ws("/", F.when(parent != "", parent), F.when(child != "", child))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def civil_day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date; null where there is no such date."""
    return F.unix_date(F.try_make_date(year, month, day)) if hasattr(F, "try_make_date") else F.unix_date(F.make_date(year, month, day))


#: The largest unsigned 64-bit number.
MOST_U64 = "18446744073709551615"


def saturated_add(a: Column, b: Column) -> Column:
    """Sum of unsigned 64-bit numbers (decimals), at most the largest one."""
    wide = a.cast("decimal(20,0)").cast("decimal(38,0)") + b.cast("decimal(20,0)").cast("decimal(38,0)")
    return F.least(wide, F.lit(MOST_U64).cast("decimal(38,0)")).cast("decimal(20,0)")


def bit_width(n: Column) -> Column:
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def varint_size(n: Column) -> Column:
    """Bytes of a little-endian base-128 integer."""
    return F.greatest(F.lit(1), F.ceil(bit_width(n) / 7).cast("int"))


def varint(n: Column) -> Column:
    """The bytes of a whole number (as 64 unsigned bits), seven bits each, lowest first; all but the last have the top bit set."""
    n = n.cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftrightunsigned", n, i * 7))
    used = F.filter(parts, lambda x, i: (i == 0) | ((x != 0) & (i < 10)))
    octets = F.transform(used, lambda x, i: x.bitwiseAND(F.lit(127)) + F.when(i < F.size(used) - 1, 128).otherwise(0))
    return F.when(n.isNotNull(), F.unhex(F.array_join(F.transform(octets, lambda b: F.lpad(F.hex(b), 2, "0")), "")))


def varint_value(data: Column) -> Column:
    """The number that data begins with; null for data that end before it does and for more than ten bytes. Bits past the 64th are lost."""
    text = F.hex(F.substring(data, 1, 10))
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(text) / 2).cast("int"))), lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    last = F.array_position(F.transform(octets, lambda b: b < 128), True).cast("int")
    bits = F.transform(F.slice(octets, 1, last), lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), 7 * i))
    return F.when((F.length(text) > 0) & (last > 0), F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)))


def zigzag16(w: Column) -> Column:
    """Unsigned image of a signed 16-bit number."""
    v = F.pmod(w + 32768, F.lit(65536)) - 32768
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def _times32(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 for 32-bit x, in halves so that no product passes 2^48."""
    mask = F.lit((1 << 32) - 1)
    return (((x * (factor >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536) + x * (factor & 0xFFFF)).bitwiseAND(mask)


def avalanche32(x: Column) -> Column:
    """Mixes a 32-bit number, given as a long: two shifts and multiplications and a last shift."""
    # Each shift with the factor after it.
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = _times32(x.bitwiseXOR(F.shiftright(x, shift)), factor)
    return x.bitwiseXOR(F.shiftright(x, 16))


def gram_slot(x: Column, bits: int = 20) -> Column:
    """Slot of four bytes (a 32-bit number, given as a long) in a table of 2^bits."""
    return F.shiftright(_times32(x, 2654435761), 32 - bits)


def radical_inverse(i: Column) -> Column:
    """Van der Corput point in base 2."""
    bits = F.bin(i)
    return F.conv(F.reverse(bits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(bits))


# Extensions of the type classes 1, 2, 3 and 5.
TEXT = "txt md csv tsv json xml html htm css js ts cpp c hpp h py log".split()
EXECUTABLE = "exe dll sys ocx cpl scr com efi".split()
RAW_MEDIA = "wav bmp dib tiff".split()
COMPRESSED = "7z zip rar gz xz bz2 zst jpg jpeg png gif webp mp3 aac flac mp4 mkv avi pdf docx xlsx pptx epub msi".split()


def type_class(path: Column, kind: Column | None = None) -> Column:
    """0 directory or link, 1 text, 2 executable, 3 raw media, 4 anything else, 5 compressed already."""
    ext = extension(path)
    of_file = F.when(ext.isin(TEXT), 1).when(ext.isin(EXECUTABLE), 2).when(ext.isin(RAW_MEDIA), 3).when(ext.isin(COMPRESSED), 5).otherwise(4)
    return of_file if kind is None else F.when(kind.isin("directory", "symlink"), 0).otherwise(of_file)


def type_text(path: Column, kind: Column) -> Column:
    ext = F.upper(extension(path))
    return F.when(kind == "directory", "File folder").when(ext == "", "File").otherwise(F.concat(ext, F.lit(" file")))


def archive_type(path: Column) -> Column:
    """Label of an archive by its name; null for other files."""
    name, ext = F.lower(base_name(path)), extension(path)
    return (
        F.when(ext == "zip", "ZIP archive").when(ext == "jar", "JAR archive").when(ext == "war", "WAR archive").when(ext == "apk", "APK archive")
        .when(ext == "7z", "7z archive").when(ext.rlike("^(rar|r[0-9]{2})$"), "RAR archive").when(name.rlike(r"\.(tar(\.(gz|xz|bz2|zst))?|t(gz|xz|bz2|zst))$"), "TAR archive")
        .when(ext == "iso", "ISO image").when(ext == "cab", "CAB archive")
    )


def archive_format(content: Column) -> Column:
    """Format by magic bytes (zip, 7z, rar, tar, iso, cab); null when none fits. A wrapped ZIP is found by the end record in its last 65,557 bytes."""
    at = lambda offset, magic: F.hex(F.substring(content, offset + 1, len(magic) // 2)) == magic
    tail = F.hex(F.substring(content, -65557, 65557))
    wrapped = at(0, "4D5A") & tail.rlike("^(..)*?504B0506")
    return (
        F.when(at(0, "504B0304") | at(0, "504B0506") | at(0, "504B0708") | wrapped, "zip").when(at(0, "377ABCAF271C"), "7z")
        .when(at(0, "526172211A0700") | at(0, "526172211A070100"), "rar").when(at(257, "7573746172"), "tar").when(at(0x8001, "4344303031"), "iso").when(at(0, "4D534346"), "cab")
    )


def strict_path(path: Column) -> Column:
    """The path with slashes; null when it is rooted, empty, has an empty, . or .. step, a drive colon or a NUL."""
    p = F.translate(path, "\\", "/")
    return F.when((p != "") & ~p.rlike(r"(^|/)(\.{0,2})(/|$)") & ~p.rlike("^[A-Za-z]:") & ~F.contains(p, F.lit("\0")), p)


def strip_version(name: Column) -> Column:
    """An ISO file name without ;number and trailing dots."""
    return F.regexp_replace(F.regexp_replace(name, ";[0-9]+$", ""), r"\.+$", "")


def hex_number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(text, 16, 10).cast("long"))


def octal_number(text: Column) -> Column:
    t = F.regexp_replace(text, r"^[ \x00]+|[ \x00]+$", "")
    return F.when(t.rlike("^[0-7]{1,20}$"), F.conv(t, 8, 10).cast("long"))


def last_percent(text: Column) -> Column:
    """The last number before a % sign, when it is 100 or less."""
    n = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d{1,9})%"), 1), F.lit(-1)).try_cast("int")
    return F.when(n <= 100, n)


def count_text(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def attribute_letters(bits: Column) -> Column:
    """Letters of a file attribute mask: read-only, hidden, system, archive, reparse point, offline, recall."""
    marks = [(0x1, "R"), (0x2, "H"), (0x4, "S"), (0x20, "A"), (0x400, "L"), (0x1000, "O"), (0x400000, "C")]
    return F.concat(*[F.when(bits.bitwiseAND(F.lit(m)) != 0, c).otherwise("") for m, c in marks])


def distance_slot(distance: Column) -> Column:
    """(slot, bits, value) of a match distance: four direct slots, then two for each power of two with the rest as footer."""
    p = distance - 1
    width = bit_width(p) - 1
    top = F.floor(p / F.pow(F.lit(2.0), width - 1)).cast("long") % 2
    slot = F.when(p < 4, p).otherwise(2 * width + top).cast("long")
    bits = F.when(p < 4, 0).otherwise(width - 1)
    base = ((2 + slot % 2) * F.pow(F.lit(2.0), bits)).cast("long")
    return F.struct(slot.alias("slot"), bits.cast("int").alias("bits"), F.when(p < 4, 0).otherwise(p - base).cast("long").alias("value"))


def slot_distance(slot: Column, value: Column) -> Column:
    base = ((2 + slot % 2) * F.pow(F.lit(2.0), F.floor(slot / 2) - 1)).cast("long")
    return F.when(slot < 4, slot + 1).otherwise(base + value + 1).cast("long")


def value_code(n: Column) -> Column:
    """(code, bits, extra): 0 to 15 direct, then one code for each power of two."""
    width = bit_width(n) - 1
    big = n >= 16
    return F.struct(
        F.when(big, 12 + width).otherwise(n).cast("int").alias("code"), F.when(big, width).otherwise(0).cast("int").alias("bits"),
        F.when(big, n - F.pow(F.lit(2.0), width).cast("long")).otherwise(0).cast("long").alias("extra"),
    )


def version_parts(text: Column) -> Column:
    """Four numbers of a dotted version; null when it is none."""
    ok = text.rlike(r"^v?\d{1,6}(\.\d{1,6}){0,3}$")
    parts = F.transform(F.split(F.regexp_replace(text, "^v", ""), r"\."), lambda x: x.try_cast("int"))
    return F.when(ok, F.slice(F.concat(parts, F.array_repeat(F.lit(0), 3)), 1, 4))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; an invalid version compares equal."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x.isNull() | y.isNull() | (x == y), 0).when(x < y, -1).otherwise(1)
