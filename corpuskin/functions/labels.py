"""Small scalar functions: names of codes, sizes, tokens of descriptions, set similarity, dimension agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that reports give to kinds of data units and to compression codes.
UNIT_KINDS = ("tile", "strip", "metadata", "associated")
COMPRESSIONS = {
    1: "uncompressed",
    5: "LZW",
    6: "JPEG (old-style)",
    7: "JPEG",
    8: "deflate",
    32773: "PackBits",
    33003: "JPEG 2000",
    33005: "JPEG 2000",
}


def identity(*columns: str | Column) -> Column:
    """128 bits of some columns, to join on instead of them."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns, F.lit(2)).alias("b"))


def kind_label(kind: Column) -> Column:
    out = F.when(kind == 0, UNIT_KINDS[0])
    for code, name in enumerate(UNIT_KINDS[1:], 1):
        out = out.when(kind == code, name)
    return out


def compression_label(code: Column) -> Column:
    """The scheme's name, or ``unknown``, and its code; null for null."""
    names = F.create_map(*[x for n, name in COMPRESSIONS.items() for x in (F.lit(n), F.lit(name))])
    return F.concat(F.coalesce(names[code.cast("int")], F.lit("unknown")), F.lit(" ("), code.cast("string"), F.lit(")"))


def format_size(size: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB with one decimal from KiB on, halves to even."""
    decimal = lambda bits: F.format_string("%.1f", F.bround(size / F.lit(float(1 << bits)), 1))
    out = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B")))
    for unit, bits in (("KiB", 10), ("MiB", 20)):
        out = out.when(size < 1 << (bits + 10), F.concat(decimal(bits), F.lit(f" {unit}")))
    return out.otherwise(F.concat(decimal(30), F.lit(" GiB")))


def description_tokens(text: Column) -> Column:
    """Sorted distinct tokens of a description: of each ``|``, ``;`` or line-separated part, the words before ``=``.

    Words lose all but letters and digits and are lower-cased; those under 2 bytes and plain numbers are left out.
    """
    parts = F.split(text, r"[|;\n\r]")
    keys = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    words = F.flatten(F.transform(keys, lambda k: F.split(k, r"(?U)\s+")))
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", "")))
    kept = F.filter(plain, lambda t: (F.octet_length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def preamble(text: Column) -> Column:
    """What stands before the first ``|``, trimmed; null if that is empty."""
    head = F.regexp_replace(F.substring_index(text, "|", 1), r"(?U)^\s+|\s+$", "")
    return F.when(head != "", head)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def dimension_match(a: Column, b: Column, most: float = 1.25) -> Column:
    """1 if both are 0 or the larger is at most ``most`` times the smaller, else 0."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == 0, 1.0).when(low == 0, 0.0).when(high / low <= most, 1.0).otherwise(0.0)
