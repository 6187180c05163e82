"""Archive index files as entry rows, and what entries tell: sizes, names, lookups, a report on completeness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.functions.batches import decoded_frames
from orebed.functions.pixels import hex_groups
from orebed.operators import lookups, windows
from orebed.operators.aggregates import byte_entropy

# The format's numbers, limits and expectations.
MARK, KEY_BYTES, DATA_FILES, HEADER = 7, 9, 6, 24
EXPECTED_INDEXES, EXPECTED_BYTES, TOLERANCE = 16, 5_687_091_200, 10.0
JPEG_SIZE, DENSE_SIZE, PLAIN_SIZE, LEAST_SIZE = 50_000, 32_768, 8_192, 4_096
SAMPLE_BYTES = 1024
MAX_GAP = 50_000_000

ENTRIES = "idx_file string, bucket int, version long, entry_pos int, key binary, data_file int, offset long"
PARSED = f"{ENTRIES}, error string"


def parse_index(data: bytes, name: str) -> tuple[int, int, list[tuple[bytes, int, int]]]:
    """Bucket, version and (key, data file, offset) of each entry; a cut-off key ends the list."""
    if len(data) < HEADER:
        raise ValueError("shorter than a header")
    mark, bucket, size_bytes, offset_bytes, key_bytes, header = int.from_bytes(data[8:10], "little"), data[10], data[12], data[13], data[14], data[15]
    if mark != MARK:
        raise ValueError(f"mark {mark}, not {MARK}")
    if key_bytes != KEY_BYTES:
        raise ValueError(f"keys of {key_bytes} bytes")
    at = max(header, HEADER)
    if at > len(data):
        raise ValueError("the header is cut short")
    entries = []
    while at + KEY_BYTES <= len(data):
        if size_bytes not in (1, 2, 3, 4) or offset_bytes not in (1, 2, 3, 4, 5, 6, 8):
            raise ValueError(f"numbers of {size_bytes} and {offset_bytes} bytes")
        end = at + KEY_BYTES + size_bytes + offset_bytes
        if end > len(data):
            raise ValueError("an entry is cut short")
        cut = end - offset_bytes
        offset = int.from_bytes(data[cut:end], "little")
        if offset >= 1 << 32:
            raise ValueError(f"offset {offset} has over 32 bits")
        entries.append((data[at : at + KEY_BYTES], int.from_bytes(data[at + KEY_BYTES : cut], "little") % DATA_FILES, offset))
        at = end
    stem = name.rsplit(".", 1)[0]
    version = int(stem[8:]) if len(stem) >= 10 and stem[8:].isascii() and stem[8:].isdigit() else 0
    return bucket, version, entries


def index_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of files with path and content. rejects: idx_file, error. Each file is parsed for itself."""

    def of_file(path: str, content: bytes) -> list[tuple]:
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        try:
            bucket, version, entries = parse_index(content, name)
            return [(path, bucket, version, i, *e, None) for i, e in enumerate(entries)]
        except ValueError as e:
            return [(path, None, None, None, None, None, None, str(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["idx_file", "bucket", "version", "entry_pos", "key", "data_file", "offset", "error"]
        return decoded_frames(batches, of_file, columns, {"bucket": "Int32", "version": "Int64", "entry_pos": "Int32", "data_file": "Int32", "offset": "Int64"})

    parsed = files.select("path", "content").mapInPandas(run, PARSED)
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("idx_file", "error")


def read_indexes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """index_entries of the .idx files below a path."""
    return index_entries(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.idx").load(path))


def header_size(header: Column) -> Column:
    """A size guessed from the first bytes of a file's content (null: there are none)."""
    number = lambda at: F.conv(F.hex(F.substring(header, at, 4)), 16, 10).cast("long")
    png = F.startswith(header, F.lit(bytes.fromhex("89504E470D0A1A0A"))) & (F.substring(header, 13, 4) == F.lit(b"IHDR")) & (F.length(header) >= 24)
    estimate = F.floor(number(17) * number(21) * 4 / 8) + 1024
    return (
        F.when(F.coalesce(F.length(header), F.lit(0)) < 8, LEAST_SIZE)
        .when(png & (estimate < 10_000_000), F.least(estimate, F.lit(100_000)))
        .when(F.startswith(header, F.lit(b"\xff\xd8")), JPEG_SIZE)
        .when(F.size(F.array_distinct(hex_groups(F.substring(header, 1, 16)))) > 12, DENSE_SIZE)
        .otherwise(PLAIN_SIZE)
        .cast("long")
    )


def sized(entries: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """entries with size: up to the next greater offset in the data file, else by the header (data_file, offset, header), else the least.

    Distinct offsets are sorted within ranges, not whole data files, of which an archive has few.
    """
    gap = F.col("next") - F.col("offset")
    offsets = windows.next_offsets(entries.select("data_file", "offset").distinct(), "data_file", "offset").select("data_file", "offset", F.when(gap < MAX_GAP, gap).alias("gap"))
    out = entries.join(offsets, ["data_file", "offset"])
    if headers is None:
        guess = F.lit(LEAST_SIZE).cast("long")
    else:
        out = out.join(headers.select("data_file", "offset", "header"), ["data_file", "offset"], "left")
        guess = header_size(F.col("header"))
    return out.select(*entries.columns, F.coalesce("gap", guess).alias("size"))


def listed(entries: DataFrame, sprites: bool = False) -> DataFrame:
    """Sized entries of at least 16 bytes with a name; sprites: those of 1 KiB to 10 MiB, numbered from 1 over all files.

    Files are numbered by path. The numbering of sprites counts per file in parallel; only a row for each file meets in one task.
    """
    files = entries.select("idx_file").distinct().withColumn("idx_pos", windows.ordinal("idx_file"))
    rows = entries.join(files, "idx_file").where("size >= 16")
    key = F.lower(F.hex("key"))
    if not sprites:
        return rows.withColumn("name", F.format_string("file_%03d_%05d_%s.dat", "idx_pos", "entry_pos", key))
    rows = rows.where(F.col("size").between(1024, 10_485_760)).withColumn("_n", F.row_number().over(Window.partitionBy("idx_file").orderBy("entry_pos")))
    before = rows.groupBy("idx_file", "idx_pos").agg(F.count("*").alias("_c")).withColumn("_b", F.sum("_c").over(Window.orderBy("idx_pos")) - F.col("_c")).select("idx_file", "_b")
    numbered = rows.join(before, "idx_file")
    return numbered.withColumn("name", F.format_string("sprite_candidate_%04d_%s.dat", F.col("_n") + F.col("_b"), F.substring(key, 1, 8))).drop("_n", "_b", "_c")


def by_key(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key (column key) its first entry by file and place."""
    found = entries.join(keys.select("key").distinct(), "key", "left_semi")
    return lookups.top_by(found, "key", "idx_file", "entry_pos")


def key_of_name(name: Column) -> Column:
    """The key in a listed name, which has four parts, 18 hex digits in the last, and the ending; else null. Numbered sprite names hold none."""
    parts = F.split(name, "_")
    digits = F.regexp_extract(F.get(parts, F.lit(3)), r"^([0-9a-fA-F]{18})\.dat$", 1)
    return F.when((F.size(parts) == 4) & (digits != ""), F.unhex(digits))


def analysed(files: DataFrame) -> DataFrame:
    """files (with content) with entropy, is_png and is_jpeg of the first 1 KiB."""
    head = F.substring("content", 1, SAMPLE_BYTES)
    return files.select("*", byte_entropy(head).alias("entropy"), F.startswith("content", F.lit(bytes.fromhex("89504E470D0A1A0A"))).alias("is_png"), F.startswith("content", F.lit(bytes.fromhex("FFD8FF"))).alias("is_jpeg"))


def installation_report(listing: DataFrame, entries: DataFrame, parsed_indexes: int) -> DataFrame:
    """One row: what is missing of directories, index files and data files, the data files' total size, and whether all is well.

    listing: path (relative, with slashes) and length of the files of an installation. Few names are expected, so the lists are short.
    """
    spark = listing.sparkSession
    name = F.element_at(F.split("path", "/"), -1)
    inside = listing.where(F.col("path").startswith("Data/data/")).select(name.alias("name"), "length")
    data = inside.where(F.col("name").rlike(r"^data\.") & ~F.col("name").endswith(".idx"))
    expected_idx = spark.range(EXPECTED_INDEXES).select(F.format_string("data.%03d.idx", "id").alias("name"))
    expected_data = spark.range(DATA_FILES).select(F.format_string("data.%03d", "id").alias("name"), F.col("id").cast("int").alias("data_file"))
    numbers = data.where(F.col("name").rlike(r"^data\.[0-9]+$")).select(F.substring_index("name", ".", -1).cast("int").alias("data_file")).distinct()
    missing_data = lookups.missing(expected_data, data.select("name"), "name").select("data_file").union(lookups.missing(entries.select("data_file").distinct(), numbers, "data_file")).distinct()
    folders = listing.agg(*(F.coalesce(F.bool_or(F.col("path").startswith(f"Data/{d}/")), F.lit(False)).alias(d) for d in ("data", "indices")))
    absent = F.array_compact(F.array(*(F.when(~F.col(d), f"Data/{d}") for d in ("data", "indices"))))
    gather = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias(f"missing_{c}"))
    sizes = data.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"), F.count_if(F.col("name").rlike(r"^data\.[0-9]+$")).cast("int").alias("data_file_count"))
    out = folders.select(absent.alias("missing_directories")).crossJoin(gather(lookups.missing(expected_idx, inside, "name"), "name")).crossJoin(gather(missing_data, "data_file")).crossJoin(sizes)  # rows of one each
    out = out.withColumnsRenamed({"missing_name": "missing_index_files", "missing_data_file": "missing_data_files"}).withColumn("index_file_count", F.lit(parsed_indexes))
    out = out.withColumn("size_difference", F.col("total_size") - EXPECTED_BYTES).withColumn("is_within_tolerance", 100.0 * F.abs("size_difference") / EXPECTED_BYTES <= TOLERANCE)
    none = lambda c: F.size(c) == 0
    return out.withColumn("is_valid", none("missing_directories") & none("missing_index_files") & none("missing_data_files") & F.col("is_within_tolerance") & (F.col("index_file_count") == EXPECTED_INDEXES) & (F.col("data_file_count") == DATA_FILES))
