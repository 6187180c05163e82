"""A landing folder as a stream: files that arrive get a verdict and a hash, once each. Stateless, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orebed.functions import predicates

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(folder)


def judged(files: DataFrame, include: list[str] = (), exclude: list[str] = (), tier: str = "All") -> DataFrame:
    """path, length, tier, verdict, sha256. Works on batches and streams alike."""
    found = predicates.tier(F.col("path"))
    verdict = predicates.verdict(F.col("path"), include, exclude, predicates.tier_fits(found, tier))
    return files.select("path", "length", found.alias("tier"), verdict.alias("verdict"), F.sha2("content", 256).alias("sha256"))


def run(files: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet files; once: take what is there and stop."""
    writer = files.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
