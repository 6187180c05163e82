"""Mappings, configuration, baselines and target lists: small text files."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.operators.lookups import last_wins
from orebed.operators.windows import upsert

log = logging.getLogger(__name__)

BASELINE = "sprite_name string, source_file string, expected_output string, expected_metadata struct<width:long,height:long,frame_count:long,format:string>, sha256_hash string, baseline_date string, extractor_version string"
TARGETS = "output string, candidates array<string>"


def mapping(lines: DataFrame) -> DataFrame:
    """key, value of `key: value` lines (line_no, value): blank lines and # lines are skipped, later keys win, trailing comments stay."""
    rows = lines.select("line_no", F.trim("value").alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit(":")))
    parts = F.split("line", ":", 2)
    return last_wins(rows.select("line_no", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")), "key", "value", "line_no")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of one text file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def category(mapped: DataFrame, prefix: str) -> DataFrame:
    return mapped.where(F.startswith("key", F.lit(prefix)))


def names_by_id(lines: DataFrame) -> DataFrame:
    """id, name of `animations/<name>: [SD/|HD2/]anim/main_<id>.anim` lines; comments are cut, the quality prefix too; the last line of an id wins."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = lines.select("line_no", F.regexp_extract(line, r"^animations/(.+?):\s*(?:.*/)?main_(\d+)", 1).alias("name"), F.regexp_extract(line, r"main_(\d+)", 1).try_cast("int").alias("id"))
    return last_wins(rows.where("name <> '' and id is not null"), "id", "name", "line_no").select("id", "name")


def exported_map(lines: DataFrame) -> DataFrame:
    """id (with its zeros), name of `animations/<name>: anim/main_<id>.anim` lines, by number."""
    pattern = r"^animations/(.+?):\s*anim/main_(\d+)\.anim"
    rows = lines.select("line_no", F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("id")).where("id <> ''")
    return last_wins(rows, "id", "name", "line_no").orderBy(F.col("id").cast("int"))


@dataclass
class Filters:
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    max_files: int | None = None


@dataclass
class Output:
    directory: str = "extracted"
    preserve_paths: bool = True
    overwrite: str = "Always"
    png_level: int = 6
    pixels_per_unit: float = 100.0


@dataclass
class Config:
    """Everything has a default; a file may name any part."""

    filters: Filters = field(default_factory=Filters)
    output: Output = field(default_factory=Output)
    custom_settings: dict = field(default_factory=dict)


def _merged(default, given: dict):
    known = {f.name: f for f in fields(default)}
    for name, value in given.items():
        if name in known:
            own = getattr(default, name)
            if is_dataclass(own) and not isinstance(value, dict):
                raise ValueError(f"{name} is no object")
            setattr(default, name, _merged(own, value) if is_dataclass(own) else value)
    return default


def load_config(text: str | None) -> Config:
    """Defaults, with what the JSON text names; whatever is wrong with it gives a warning and the defaults alone."""
    try:
        return _merged(Config(), json.loads(text)) if text else Config()
    except (ValueError, AttributeError) as e:
        log.warning("the configuration isn't used: %s", e)
        return Config()


def dump_config(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """The baselines of a JSON array, by name; later ones win."""
    rows = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    return rows.dropDuplicates(["sprite_name"])


def registered(baselines: DataFrame, new: DataFrame) -> DataFrame:
    """baselines with new ones put in place of those of the same name."""
    return upsert(baselines, new, "sprite_name")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARGETS).option("multiLine", True).json(path)


def targets_json(targets: DataFrame) -> DataFrame:
    """One row: the targets as a JSON array, by output."""
    return targets.agg(F.to_json(F.array_sort(F.collect_list(F.struct("output", "candidates")))).alias("json"))
