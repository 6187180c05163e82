"""Path and content predicates as columns: filter verdicts, tiers, signatures, names."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orebed.functions.pixels import hex_groups

log = logging.getLogger(__name__)

INCLUDE, EXCLUDE, SKIP = "Include", "Exclude", "Skip"
# Format signatures and entropy bounds.
PNG_SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
JPEG_SIGNATURE = bytes.fromhex("FFD8FF")
JPEG_MARKER = bytes.fromhex("FFD8")
ENTROPY_RANGE = (7.96, 7.99)
QUALITY_PREFIXES = {"sd": "SD/", "hd2": "HD2/", "hd4": ""}
ERA_TILESETS = ("badlands", "platform", "install", "jungle", "jungle", "ashworld", "ice", "twilight")
TIERS = ("HD", "HD2", "SD", "All")
FORMATS = ("Png", "Jpeg", "All")


def choice(value: str, options: Sequence[str]) -> str:
    """An option by its name in any case."""
    for option in options:
        if option.lower() == value.lower():
            return option
    raise ValueError(f"{value!r} is none of {', '.join(options)}")


def valid_patterns(patterns: Sequence[str], strict: bool = False) -> list[str]:
    """The patterns that compile; others are dropped with a warning, or an error if strict."""
    kept = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            if strict:
                raise ValueError(f"invalid pattern {p!r}: {e}") from e
            log.warning("invalid pattern %r is dropped: %s", p, e)
            continue
        kept.append(p)
    return kept


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(p) for p in patterns), F.lit(False))


def passes(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include pattern is found (or none is given) and no exclude pattern. Invalid patterns are dropped."""
    include, exclude = valid_patterns(include), valid_patterns(exclude)
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)


def verdict(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), eligible: Column | None = None) -> Column:
    """Exclude, Skip or Include, in that order of precedence; eligible: whether the tier and the format fit. Invalid patterns are errors."""
    include, exclude = valid_patterns(include, strict=True), valid_patterns(exclude, strict=True)
    out = F.when(matches_any(path, exclude), EXCLUDE)
    if eligible is not None:
        out = out.when(~F.coalesce(eligible, F.lit(False)), SKIP)
    return out.when(matches_any(path, include), INCLUDE).otherwise(SKIP) if include else out.otherwise(INCLUDE)


def tier(path: Column) -> Column:
    """HD2, HD or SD by the folder in a path, in that order of tests; else null."""
    low = F.lower(path)
    within = lambda *parts: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts))
    return F.when(within("hd2/anim/", "hd2\\anim\\"), "HD2").when(within("anim/", "anim\\"), "HD").when(within("sd/", "sd\\"), "SD")


def tier_fits(tier: Column, wanted: str) -> Column:
    wanted = choice(wanted, TIERS)
    return F.lit(True) if wanted == "All" else F.coalesce(tier == wanted, F.lit(False))


def tier_folder(tier: Column) -> Column:
    return F.coalesce(tier, F.lit("unknown"))


def has_png(content: Column) -> Column:
    return F.startswith(content, F.lit(PNG_SIGNATURE))


def has_jpeg(content: Column, marker_only: bool = False) -> Column:
    """By three bytes, or by the two-byte marker alone, as the filter does."""
    return F.startswith(content, F.lit(JPEG_MARKER if marker_only else JPEG_SIGNATURE))


def format_fits(content: Column, wanted: str) -> Column:
    """Without content only All fits."""
    wanted = choice(wanted, FORMATS)
    if wanted == "All":
        return F.lit(True)
    return F.coalesce(has_png(content) if wanted == "Png" else has_jpeg(content, marker_only=True), F.lit(False))


def found_in(path: Column, *needles: str) -> Column:
    """Every needle, in any case."""
    return reduce(lambda a, b: a & b, (F.contains(F.lower(path), F.lit(n.lower())) for n in needles))


def probed(name: Column, path: Column, needle: str) -> Column:
    """The name holds the lower-cased needle as it is, or the path in any case."""
    return F.contains(name, F.lit(needle.lower())) | F.contains(F.lower(path), F.lit(needle.lower()))


def entropy_valid(entropy: Column) -> Column:
    return entropy.between(*ENTROPY_RANGE)


def listed_size(size: Column) -> Column:
    return size >= 16


def sprite_size(size: Column) -> Column:
    return size.between(1024, 10 * 1024 * 1024)


def is_audio(path: Column, races: Sequence[str]) -> Column:
    low = F.lower(path)
    return (F.endswith(low, F.lit(".wav")) | F.endswith(low, F.lit(".ogg"))) & reduce(lambda a, b: a | b, (F.contains(low, F.lit(r)) for r in races))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def located(path: Column, locale: str) -> Column:
    """The path within a locale's folder, unless it is there."""
    prefix = f"locales\\{locale}\\"
    return F.when(F.startswith(F.lower(path), F.lit(prefix.lower())), path).otherwise(F.concat(F.lit(prefix), path))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def quality_prefix(quality: Column) -> Column:
    out = F
    for name, prefix in QUALITY_PREFIXES.items():
        out = out.when(F.lower(quality) == name, prefix)
    return out


def tileset_of(era: Column) -> Column:
    """The tileset's name of an era's low three bits."""
    return F.element_at(F.array(*map(F.lit, ERA_TILESETS)), era.bitwiseAND(F.lit(7)).cast("int") + 1)


def compressed_like(content: Column) -> Column:
    """At least 64 bytes, and over 0.8 x 256 different ones among the first 1024."""
    return F.when(F.length(content) >= 64, F.size(F.array_distinct(hex_groups(F.substring(content, 1, 1024)))) > 0.8 * 256).otherwise(False)
