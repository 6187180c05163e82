"""Pixel and hash arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_groups(content: Column, digits: int = 2) -> Column:
    """The hex digits of bytes in groups, in one pass: bytes of 2, pixels of 8."""
    return F.regexp_extract_all(F.hex(content), F.lit(f"[0-9A-F]{{{digits}}}"), F.lit(0))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """BT.601 in integers, rounded."""
    return F.floor((299 * r.cast("long") + 587 * g + 114 * b + 500) / 1000).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def adjacent_bits(values: Column, count: int) -> Column:
    """A bit for each of the first `count` neighbours, set where the left one is smaller; the first pair is bit 0."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseOR(F.when(F.get(values, i) < F.get(values, i + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def mask_pixel(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A team-colour mask's pixel: clear where alpha is 0, else grey of the luminance."""
    grey = luminance(r, g, b)
    return F.when(a == 0, F.struct(*(F.lit(0).cast("long").alias(c) for c in "rgba"))).otherwise(F.struct(grey.alias("r"), grey.alias("g"), grey.alias("b"), a.cast("long").alias("a")))
