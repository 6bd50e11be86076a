"""Expressions over strings, bytes and times; all of them run inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; independent of the session's zone for the latter."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` AS timestamp_ntz))")


def entropy(col: Column | str, digits: int = 4) -> Column:
    """Shannon entropy in bits over the UTF-8 bytes of a string or binary; empty or null: 0.

    Bytes are sorted once; runs of equal ones are counted from the places where a new one
    begins, in n log n steps.
    """
    col = F.col(col) if isinstance(col, str) else col
    data = F.coalesce(col.cast("binary"), F.lit(b""))
    pairs = F.array_sort(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1))
    n = F.octet_length(data)
    # A lambda variable holds the sorted bytes, so that they are made once.
    ends = F.transform(F.array(pairs), lambda p: F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == F.size(p)) | (F.get(p, i) != F.get(p, i - 1))))[0]
    counted = F.transform(F.array(ends), lambda e: F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0))))[0]
    total = F.aggregate(counted, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))
    return F.when(n > 0, F.bround(total, digits)).otherwise(F.lit(0.0))


def u8(payload: str, at: int) -> Column:
    """The byte at an offset from 0; null beyond the end."""
    part = F.substring(payload, at + 1, 1)
    return F.when(F.length(payload) > at, F.conv(F.hex(part), 16, 10).cast("int"))


def u16(payload: str, at: int) -> Column:
    """The big-endian number of two bytes; null beyond the end."""
    return F.when(F.length(payload) > at + 1, F.conv(F.hex(F.substring(payload, at + 1, 2)), 16, 10).cast("int"))


def percent_rank(col: str, *keys: str) -> Column:
    """Rank from above 0 to 1 in which ties share their average rank."""
    from pyspark.sql import Window

    part = Window.partitionBy(*keys)
    return (F.rank().over(part.orderBy(col)) + (F.count("*").over(part.partitionBy(*keys, col)) - 1) / 2) / F.count("*").over(part)
