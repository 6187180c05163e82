"""Join-shaped lookups: names, ordered candidates, keywords, chains, baselines, back-references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keyword targets become part of the expression: so many at most.
MAX_TARGETS = 10_000
#: Where a layer is looked for if the header doesn't name it.
LAYERS = ("diffuse", "teamcolor", "normal", "specular", "emissive", "ao")


def named(df: DataFrame, names: DataFrame, id: str, name: str, numbered: Column) -> DataFrame:
    """df with name: from names (id, name) if the id is there, else the numbered one. Spark broadcasts names if they are few."""
    return df.join(names.select(id, F.col(name).alias("_name")), id, "left").withColumn(name, F.coalesce("_name", numbered)).drop("_name")


def first_candidate(targets: DataFrame, listing: DataFrame, target: str, candidates: str, path: str, variants: Sequence = (lambda p: p,), usable: Column | None = None) -> DataFrame:
    """target, path, pos, variant: for each target its first candidate, in order and then by variant, that the listing has.

    candidates: an array column. variants: functions of the candidate's path. usable: a condition on the listing (not empty).
    """
    tried = targets.select(target, F.posexplode(candidates).alias("pos", "_candidate"))
    tried = tried.select(target, "pos", F.posexplode(F.array(*(v(F.col("_candidate")) for v in variants))).alias("variant", path))
    there = (listing if usable is None else listing.where(usable)).select(path).distinct()
    best = tried.join(there, path).groupBy(target).agg(F.min(F.struct("pos", "variant", path)).alias("best"))
    return best.select(target, f"best.{path}", "best.pos", "best.variant")


def keywords(stem: str, size: int = 4) -> list[str]:
    """The parts of a stem, each cut to so many bytes."""
    return [part.encode()[:size].decode(errors="ignore") for part in stem.lower().split("_") if part]


def first_with_keywords(listing: DataFrame, targets: dict[str, Sequence[str]], path: Column, order: str, value: str) -> DataFrame:
    """target, value: the first listed row, in order, whose path holds all of a target's keywords. One pass; targets are literals."""
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    low = F.lower(path)
    asked = F.array(*(F.struct(F.lit(t).alias("target"), F.array(*map(F.lit, words)).alias("words")) for t, words in targets.items()))
    hits = listing.select(F.col(order), F.col(value), F.explode(F.filter(asked, lambda t: F.forall(t["words"], lambda w: F.contains(low, w)))).alias("_t"))
    return hits.groupBy(F.col("_t.target").alias("target")).agg(F.min_by(value, order).alias(value))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key), key, "left_anti")


def split_id(id: Column) -> tuple[Column, Column]:
    """A tile id's group and its place in the group."""
    return F.shiftright(id, 4), id.bitwiseAND(F.lit(15))


def baseline_status(candidates: DataFrame, baseline: DataFrame, key: str, status: Column) -> DataFrame:
    """Every row of baseline's side (left) with status; both sides' columns stand in the status expression."""
    return candidates.join(baseline, key, "left").withColumn("status", status)


def back_referenced(rows: DataFrame, order: str, ref: str, values: Sequence[str]) -> DataFrame:
    """rows with values taken from the row that ref names, if that comes earlier; one hop. Other references give null."""
    there = rows.select(F.col(order).alias("_ref"), *(F.col(v).alias(f"_{v}") for v in values))
    joined = rows.join(there, (F.col(ref) == F.col("_ref")) & (F.col(ref) < F.col(order)), "left")
    return joined.select(*(c for c in rows.columns if c not in values), *(F.when(F.col(ref).isNull(), F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in values))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def layer_index(names: Column, layer: Column) -> Column:
    """A layer's place by the header's names in any case, else by convention, else null."""
    low = F.lower(layer)
    own = F.array_position(F.transform(names, F.lower), low)
    known = F.array_position(F.array(*map(F.lit, LAYERS)), low)
    return F.when(own > 0, own - 1).when(known > 0, known - 1)


def coloured(pixels: DataFrame, palette: DataFrame, index: str = "idx") -> DataFrame:
    """pixels with r, g, b, a from palette (index, r, g, b, a; at most 256 rows); magenta where the palette has no such index."""
    default = {"r": 255, "g": 0, "b": 255, "a": 255}
    joined = pixels.join(palette.select(F.col(index), *(F.col(c).alias(f"_{c}") for c in "rgba")), index, "left")
    return joined.select(*pixels.columns, *(F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in default.items()))


def fallback_matches(key: Column, path: Column) -> Column:
    """A fallback's key equals a path in any case and with either slash, or ends in it after a slash."""
    a, b = F.lower(F.replace(key, F.lit("/"), F.lit("\\"))), F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    return (a == b) | F.endswith(a, F.concat(F.lit("\\"), b))


def top_by(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
