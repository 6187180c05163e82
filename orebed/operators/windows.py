"""Next offsets, ordinals, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_greater(offset: str, *partition: str) -> Column:
    """The least strictly greater offset in the partition (equal offsets share it), null at the end. For whole-number offsets.

    In descending order the greater offsets come first, so the frame only grows and each row adds to it once; the same frame in
    ascending order is made anew for each row.
    """
    return F.min(offset).over(Window.partitionBy(*partition).orderBy(F.desc(offset)).rangeBetween(Window.unboundedPreceding, -1))


def next_offsets(offsets: DataFrame, partition: str, offset: str, bits: int = 20) -> DataFrame:
    """offsets (distinct) with next, the next greater offset in the partition, for partitions of any size.

    Offsets are sorted within ranges of 2^bits; the last of a range takes the first of the next range that has any. Of 32-bit
    offsets a partition has 4096 ranges at most, and only a row for each of them meets in one task.
    """
    ranged = offsets.withColumn("_range", F.shiftright(F.col(offset).cast("long"), bits))
    inside = ranged.withColumn("_next", F.lead(offset).over(Window.partitionBy(partition, "_range").orderBy(offset)))
    firsts = ranged.groupBy(partition, "_range").agg(F.min(offset).alias("_first"))
    after = firsts.select(partition, "_range", F.lead("_first").over(Window.partitionBy(partition).orderBy("_range")).alias("_after"))
    return inside.join(after, [partition, "_range"]).select(*offsets.columns, F.coalesce("_next", "_after").alias("next"))


def inferred_size(offset: str, *partition: str, limit: int = 50_000_000) -> Column:
    """The gap to the next greater offset, if it is below the limit."""
    gap = next_greater(offset, *partition) - F.col(offset)
    return F.when(gap < limit, gap)


def frame_ends(frames: DataFrame, key: str = "file", index: str = "frame_idx", offset: str = "offset", length: str = "length") -> DataFrame:
    """frames with end: the offset of the first frame, in index order, that comes later and lies further on; else the file's length."""
    later = frames.select(F.col(key).alias("_k"), F.col(index).alias("_i"), F.col(offset).alias("_o"))
    joined = frames.join(later, (F.col(key) == F.col("_k")) & (F.col("_i") > F.col(index)) & (F.col("_o") > F.col(offset)), "left")
    return joined.groupBy(*frames.columns).agg(F.min_by("_o", "_i").alias("_end")).select(*frames.columns, F.coalesce("_end", length).alias("end"))


def line_ends(line: str, offset: str, frame_end: str, *partition: str) -> Column:
    """The next line's offset if it lies further on and within the frame, else the frame's end."""
    following = F.lead(offset).over(Window.partitionBy(*partition).orderBy(line))
    return F.when((following > F.col(offset)) & (following <= F.col(frame_end)), following).otherwise(F.col(frame_end))


def ordinal(*order: str | Column, partition: Sequence[str] = ()) -> Column:
    """0, 1, 2 ... in that order. Without a partition all rows meet in one task: for small sets (distinct 16-bit ids) only."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1


def atlas_cells(ids: DataFrame, id: str, columns: int = 17) -> DataFrame:
    """id, atlas_index, col, row: distinct ids in ascending order dealt to a grid."""
    numbered = ids.select(id).distinct().withColumn("atlas_index", ordinal(id))
    return numbered.select(id, "atlas_index", (F.col("atlas_index") % columns).alias("col"), F.floor(F.col("atlas_index") / columns).cast("int").alias("row"))


def adjacent_less(value: str, x: str, *partition: str) -> Column:
    return F.col(value) < F.lead(value).over(Window.partitionBy(*partition).orderBy(x))


def first_then_filter(df: DataFrame, order: str, n: int, condition: Column) -> DataFrame:
    """The limit comes first: of the first n rows those that meet the condition."""
    return df.orderBy(order).limit(n).where(condition)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new has not."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def prefer_live(live: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of live, and fallback rows for other keys, with source."""
    return upsert(fallback.withColumn("source", F.lit("fallback")), live.withColumn("source", F.lit("live")), key)


def merged(missing: Column, referenced: Column) -> Column:
    """Both lists, without repeats."""
    return F.array_union(missing, referenced)
