"""The coarse fingerprint of a data unit: FNV-1a over its kind, length, compression (if it has one) and sampled bytes.

Two forms of the same value. :func:`coarse_fingerprint` cuts the at most 192 sampled bytes out in the JVM and folds them
in numpy, a step for each byte over all rows of an Arrow batch. :func:`coarse_fingerprint_sql` is a Catalyst expression
only; its fold is interpreted byte by byte, some 50 times slower. There, the 64-bit state is kept in two 32-bit halves,
since products of whole states overflow a LONG: the prime is 2^40 + 435.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of each sampled window.
WINDOW = 64
_HIGH, _LOW = 3421674724, 2216829733  # the offset basis 14695981039346656037
_MASK = (1 << 32) - 1


def _little_endian(value: Column, size: int) -> Column:
    return F.array(*[F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("long") for i in range(size)])


def _bytes(payload: Column, start: Column | int, size: Column | int) -> Column:
    """array<long> of ``size`` bytes from ``start`` (from 0)."""
    window = F.hex(F.substring(payload, start + F.lit(1), F.lit(size) if isinstance(size, int) else size))
    n = F.length(window) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(window, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def sampled_bytes(payload: Column, length: Column) -> Column:
    """The first 64 bytes; 64 from the middle if there are over 128; the last 64 if there are over 64."""
    n = length.cast("int")
    none = F.array().cast("array<bigint>")
    head = _bytes(payload, F.lit(0), WINDOW)
    middle = F.when(n > 2 * WINDOW, _bytes(payload, F.floor(n / 2).cast("int"), WINDOW)).otherwise(none)
    tail = F.when(n > WINDOW, _bytes(payload, n - WINDOW, WINDOW)).otherwise(none)
    return F.concat(head, middle, tail)


def coarse_fingerprint_sql(kind: Column, length: Column, compression: Column, payload: Column) -> Column:
    """16 lowercase hexadecimal digits, whose order is that of the unsigned values. ``payload`` holds all of the unit's bytes."""
    head = F.concat(F.array(kind.cast("long")), _little_endian(length, 8))
    marked = F.when(compression.isNotNull(), F.concat(head, _little_endian(compression, 2))).otherwise(head)
    start = F.struct(F.lit(_HIGH).cast("long").alias("hi"), F.lit(_LOW).cast("long").alias("lo"))

    def step(a: Column, x: Column) -> Column:
        low = a["lo"].bitwiseXOR(x)
        product = low * F.lit(435)
        high = a["hi"] * F.lit(435) + F.shiftleft(low, 8) + F.shiftrightunsigned(product, 32)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), product.bitwiseAND(F.lit(_MASK)).alias("lo"))

    def text(a: Column) -> Column:
        return F.concat(*[F.lpad(F.lower(F.hex(a[k])), 8, "0") for k in ("hi", "lo")])

    return F.aggregate(F.concat(marked, sampled_bytes(payload, length)), start, step, text)


#: Fixed values of FNV-1a with 64 bits.
OFFSET_BASIS, PRIME = 14695981039346656037, 1099511628211


def fold(heads: list[bytes]) -> np.ndarray:
    """FNV-1a of byte strings, all at once: a step for each byte of the longest."""
    sizes = np.array([len(h) for h in heads], np.int64)
    width = int(sizes.max()) if len(heads) else 0
    table = np.frombuffer(b"".join(h.ljust(width, b"\0") for h in heads), np.uint8).reshape(len(heads), width)
    state = np.full(len(heads), OFFSET_BASIS, np.uint64)
    for i in range(width):
        on = sizes > i
        new = (state ^ table[:, i]) * np.uint64(PRIME)
        state = np.where(on, new, state)
    return state


@F.pandas_udf(StringType())
def _folded(kind: pd.Series, length: pd.Series, compression: pd.Series, sampled: pd.Series) -> pd.Series:
    heads = [
        bytes([int(k)]) + int(n).to_bytes(8, "little") + (b"" if pd.isna(c) else int(c).to_bytes(2, "little")) + bytes(s)
        for k, n, c, s in zip(kind, length, compression, sampled, strict=True)
    ]
    return pd.Series([f"{x:016x}" for x in fold(heads).tolist()], dtype=object)


def coarse_fingerprint(kind: Column, length: Column, compression: Column, payload: Column) -> Column:
    """16 lowercase hexadecimal digits, whose order is that of the unsigned values; null for a null payload.

    ``payload`` holds all of the unit's bytes; no more than the sampled ones leave the JVM.
    """
    n = length.cast("int")
    empty = F.lit(b"").cast("binary")
    middle = F.when(n > 2 * WINDOW, F.substring(payload, F.floor(n / 2).cast("int") + 1, F.lit(WINDOW))).otherwise(empty)
    tail = F.when(n > WINDOW, F.substring(payload, n - WINDOW + 1, F.lit(WINDOW))).otherwise(empty)
    sampled = F.concat(F.substring(payload, F.lit(1), F.lit(WINDOW)), middle, tail)
    whole = kind.isNotNull() & length.isNotNull() & payload.isNotNull()
    return F.when(whole, _folded(F.coalesce(kind, F.lit(0)).cast("int"), F.coalesce(length, F.lit(0)).cast("long"), compression.cast("int"), F.coalesce(sampled, empty)))
