"""Files as rows: listings, point reads, fallbacks, fixed lists, installations."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions.predicates import located, slashed
from orebed.operators import lookups, windows
from orebed.operators.aggregates import fully_found

MAX_FILE = 512 * 1024 * 1024


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below a path. What isn't selected isn't read. Spark leaves empty files out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def relative(listing: DataFrame, root: str) -> DataFrame:
    """listing with its paths below root, with slashes."""
    return listing.withColumn("path", F.regexp_replace(slashed(F.col("path")), "^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/")) + "/+", ""))


def content_of(listing: DataFrame, path: str, limit: int = MAX_FILE) -> DataFrame:
    """The content of one file; an error if it is larger than the limit, tested before content is read."""
    guard = F.when(F.col("length") > limit, F.raise_error(F.concat(F.lit("too large: "), "path"))).otherwise(F.col("content"))
    return listing.where(F.col("path") == path).select("path", guard.alias("content"))


def generated(spark: SparkSession, count: int, prefix: str = "", limit: int | None = None) -> DataFrame:
    """id and path of numbered containers; the limit comes before any filter."""
    ids = spark.range(count if limit is None else min(count, limit))
    return ids.select("id", F.concat(F.lit(prefix), F.format_string("anim/main_%03d.anim", "id")).alias("path"))


def present(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """The wanted rows (column path) that the listing has, with its columns."""
    return wanted.join(listing, "path")


def fixed(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """source and output of a fixed list."""
    return spark.createDataFrame(list(pairs), "path string, output string")


def requested(paths: DataFrame, live: DataFrame, fallback: DataFrame, locale: str | None = None) -> DataFrame:
    """paths with content and source: live, else a fallback whose key equals the path or ends in it, else none of both.

    Fallbacks match whole keys or their ends at a slash; every such end of a fallback's key is a row, so the lookup is an equi-join.
    """
    key = lambda c: F.lower(F.replace(c, F.lit("/"), F.lit("\\")))
    wanted = paths.select(located(F.col("path"), locale).alias("path") if locale else "path").distinct().withColumn("_key", key(F.col("path")))
    parts = F.split(key(F.col("path")), r"\\")
    ends = fallback.select("path", "content", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "\\"))).alias("_key"))
    first = lookups.top_by(ends, "_key", "path").select("_key", F.col("content").alias("_fallback"))
    there = live.select(key(F.col("path")).alias("_key"), F.col("content").alias("_live")).where(F.length("_live") > 0)
    joined = wanted.join(lookups.top_by(there, "_key", "_live"), "_key", "left").join(first, "_key", "left")
    return joined.select("path", F.coalesce("_live", "_fallback").alias("content"), F.when(F.col("_live").isNotNull(), "live").when(F.col("_fallback").isNotNull(), "fallback").alias("source"))


def all_or_error(extracted: DataFrame, required: bool = False) -> tuple[int, int]:
    """(found, missing); an error if nothing was found, or anything is missing that is required."""
    return fully_found(extracted.select(F.col("source").isNotNull().alias("found")), "found", required)


def searched(listing: DataFrame, *needles: str) -> DataFrame:
    """Rows whose path holds every needle in any case."""
    out = listing
    for n in needles:
        out = out.where(F.contains(F.lower("path"), F.lit(n.lower())))
    return out


def dds_start(content: Column) -> Column:
    """Where the mark of a DDS file begins within the first 64 places, from 0, or null."""
    head = F.hex(F.substring(content, 1, 67))
    at = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.substring(head, 2 * i + 1, F.lit(8)) == "44445320", i)), lambda i: i.isNotNull()))
    return at


def overview(listing: DataFrame, n: int = 10) -> tuple[int, list[str]]:
    """How many files there are, and the first n paths."""
    return listing.count(), [r[0] for r in windows.head(listing.select("path"), n, "path").collect()]


@dataclass(frozen=True)
class Layout:
    """What tells an installation's kind: marker files by version, and the archives that the older kind needs."""

    newer_markers: tuple[str, ...] = ()
    older_markers: tuple[str, ...] = ()
    older_archives: tuple[str, ...] = ()


def installations(listing: DataFrame, layout: Layout) -> DataFrame:
    """root, kind (Indexed, Packed or Mixed), version (Newer, Older or Unknown), valid: one row for each root that is either kind.

    listing: root and path (below the root, with slashes).
    """
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    within = path.rlike("^Data/data/[^/]+$")
    any_of = lambda names: F.bool_or(path.isin(*names) | F.exists(F.array(*map(F.lit, names)), lambda n: path.startswith(F.concat(n, F.lit("/"))))) if names else F.bool_or(F.lit(False))
    facts = listing.groupBy("root").agg(
        F.bool_or(within & name.endswith(".idx")).alias("idx"), F.bool_or(within & name.startswith("data.")).alias("data"),
        F.bool_or(within & name.startswith("data.") & ~name.endswith(".idx")).alias("blobs"), F.bool_or(path.rlike("(?i)^Data/[^/]+\\.mpq$")).alias("packed"),
        any_of(layout.newer_markers + ("Data/data",)).alias("newer"), any_of(layout.older_markers + layout.older_archives).alias("older"),
        F.count_distinct(F.when(path.isin(*layout.older_archives), path)).alias("archives") if layout.older_archives else F.lit(0).alias("archives"),
    )
    indexed = F.col("idx") & F.col("data")
    kind = F.when(indexed & F.col("packed"), "Mixed").when(indexed, "Indexed").when(F.col("packed"), "Packed")
    older = F.when(F.col("older"), "Older").otherwise("Unknown")
    version = F.when(F.col("kind") == "Indexed", "Newer").when(F.col("kind") == "Packed", older).otherwise(F.when(F.col("newer"), "Newer").otherwise(older))
    valid = F.when(F.col("kind") == "Packed", F.col("archives") == len(layout.older_archives)).otherwise(F.col("idx") & F.col("blobs"))
    return facts.withColumn("kind", kind).where("kind is not null").select("root", "kind", version.alias("version"), valid.alias("valid"))


def best_installation(found: DataFrame) -> DataFrame:
    """The first valid one of the newer version, else the first valid one."""
    return found.where("valid").orderBy(F.when(F.col("version") == "Newer", 0).otherwise(1), "root").limit(1)


def located_root(override: str | None, candidates: Sequence[str], environment: str | None = None) -> str:
    """An override as it is, else the environment's path or the first candidate that has a Data folder. On the driver."""
    if override:
        return override
    for path in [*([os.environ[environment]] if environment and environment in os.environ else []), *candidates]:
        if os.path.isdir(os.path.join(path, "Data")):
            return path
    raise FileNotFoundError("no installation was found")
