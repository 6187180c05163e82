"""Progress of a job: counters that ride along with it, and names short enough to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SHOWN, KEPT = 40, 37


def shown_name(path: Column) -> Column:
    """A path of at most 40 bytes as it is, else its end after three dots."""
    return F.when(F.octet_length(path) > SHOWN, F.concat(F.lit("..."), F.right(path, F.lit(KEPT)))).otherwise(path)


def observed(df: DataFrame, ok: Column) -> tuple[DataFrame, Observation]:
    """df, and what its next action will have counted: total, ok, failed. No further pass over the data."""
    seen = Observation()
    good = F.coalesce(ok, F.lit(False))
    return df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed")), seen
