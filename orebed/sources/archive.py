"""Archives: index files and the data files that their entries point into, opened together; ranged reads of entries on executors.

A data file is never read whole: each task opens the files of its entries, and reads their ranges in the order of offsets. Paths are
opened by pyarrow's file systems, so local and shared folders and HDFS work alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orebed.codecs import cipher
from orebed.sources import index_files

#: Bytes of a file's beginning that its size is guessed from.
HEADER_BYTES = 32
#: Entries that lie within so many bytes of a data file are read by one task; and bytes of results that a batch gathers.
STRETCH, BATCH_BYTES = 64 << 20, 16 << 20
#: Shorter blocks, and those that begin with a larger byte, aren't taken for encrypted ones.
LEAST_ENCRYPTED, MOST_FIRST = 11, 8


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """data_file, path, length of the files data.NNN below a path, without their content; of equal numbers the first path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "data.*").load(path).select("path", "length")
    number = F.regexp_extract("path", r"/data\.([0-9]{1,9})$", 1)
    rows = found.where(number != "").select(number.cast("int").alias("data_file"), "path", "length")
    return rows.groupBy("data_file").agg(F.min(F.struct("path", "length")).alias("f")).select("data_file", "f.path", "f.length")


@dataclass(frozen=True)
class Archive:
    """entries of the index files, the index files that failed (idx_file, error), and the data files."""

    entries: DataFrame
    rejects: DataFrame
    files: DataFrame


def opened(spark: SparkSession, path: str) -> Archive:
    """The archive below a path. It is an error if no index file can be read."""
    entries, rejects = index_files.read_indexes(spark, path)
    if entries.isEmpty():
        raise ValueError(f"no readable index file below {path}")
    return Archive(entries, rejects, data_files(spark, path))


def ranges(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (data_file, offset, size and others) with content: up to size bytes from the offset, fewer at the end of the file.

    Second: the rows of data files that aren't there or can't be read, with error. Empty content begins beyond the end.
    """
    found = rows.join(files.select("data_file", F.col("path").alias("_path")), "data_file", "left")
    dealt = found.withColumn("_stretch", F.floor(F.col("offset") / STRETCH)).repartition("data_file", "_stretch")
    dealt = dealt.sortWithinPartitions("data_file", "offset").drop("_stretch")
    names = [c for c in dealt.columns if c != "_path"]
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "content binary", "error string"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, opened_path, file = [], 0, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                path = row.pop("_path")
                try:
                    if path is None:
                        raise OSError("no such data file")
                    if path != opened_path:
                        system, name = fs.FileSystem.from_uri(path)
                        file, opened_path = system.open_input_file(name), path
                    room = max(0, min(row["size"], file.size() - row["offset"]))
                    row |= {"content": file.read_at(room, row["offset"]) if room else b"", "error": None}
                except OSError as e:
                    row |= {"content": None, "error": str(e)}
                held.append(row)
                size += len(row["content"] or b"")
                if size >= BATCH_BYTES or len(held) >= 1024:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    read = dealt.mapInArrow(run, schema)
    return read.where("error is null").drop("error"), read.where("error is not null").drop("content")


def sized(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries with size: up to the next offset, else guessed from the file's first bytes, which are read for those entries alone."""
    guessed = index_files.sized(entries).select("data_file", "offset", "size").distinct()
    last = entries.groupBy("data_file").agg(F.max("offset").alias("offset"))
    far = guessed.where(F.col("size") == index_files.LEAST_SIZE).select("data_file", "offset")
    asked = last.union(far).distinct().withColumn("size", F.lit(HEADER_BYTES).cast("long"))
    headers, _ = ranges(asked, files)
    return index_files.sized(entries, headers.select("data_file", "offset", F.col("content").alias("header")))


def decrypted(rows: DataFrame, keys: dict[int, bytes]) -> DataFrame:
    """rows (content) with was_encrypted; blocks that look encrypted and of which the key is there are replaced by what they hold."""
    arrow = to_arrow_schema(StructType.fromDDL(", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes), "was_encrypted boolean"])))
    at = rows.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, flags = [], []
            for block in batch.column(at).to_pylist():
                plain = None
                if block is not None and len(block) >= LEAST_ENCRYPTED and block[0] <= MOST_FIRST:
                    try:
                        plain = cipher.decrypt_block(block, 0, keys)
                    except ValueError:
                        plain = None  # not encrypted after all, or not by a key that is there: the block stays
                contents.append(block if plain is None else plain)
                flags.append(plain is not None)
            columns = [*batch.columns, pa.array(flags)]
            columns[at] = pa.array(contents, pa.binary())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes), "was_encrypted boolean"]))


def extracted(archive: Archive, keys: DataFrame, secrets: dict[int, bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """For each key (column key) the first entry's size and content, decrypted if it is encrypted by one of the secrets; and rejects.

    A key that no entry has gives no row. Sizes are told by all entries of the archive.
    """
    wanted = index_files.by_key(archive.entries, keys)
    places = wanted.select("data_file", "offset").distinct()
    sizes = sized(archive.entries, archive.files).join(places, ["data_file", "offset"], "left_semi").select("data_file", "offset", "size").distinct()
    read, rejects = ranges(wanted.join(sizes, ["data_file", "offset"]), archive.files)
    return decrypted(read, secrets or {}), rejects


def extracted_by_name(archive: Archive, names: DataFrame, secrets: dict[int, bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries whose keys are in listed names (column name); names without a key give no row."""
    keys = names.select(index_files.key_of_name(F.col("name")).alias("key")).where("key is not null")
    return extracted(archive, keys, secrets)


def sampled(archive: Archive, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each key the first SAMPLE_BYTES of its first entry, with entropy, is_png and is_jpeg; and rejects."""
    wanted = index_files.by_key(archive.entries, keys).withColumn("size", F.lit(index_files.SAMPLE_BYTES).cast("long"))
    read, rejects = ranges(wanted, archive.files)
    return index_files.analysed(read.drop("size")), rejects
