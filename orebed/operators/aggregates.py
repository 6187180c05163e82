"""Counts, rates, hashes and roll-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orebed.functions.pixels import hex_groups
from orebed.functions.predicates import EXCLUDE, INCLUDE, SKIP


def _entropy(content: bytes | str | None) -> float:
    if isinstance(content, str):
        content = content.encode()
    if not content:
        return 0.0
    counts = np.bincount(np.frombuffer(content, np.uint8))
    p = counts[counts > 0] / len(content)
    return float(-(p * np.log2(p)).sum())


@F.pandas_udf(DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes; 0 for nothing. Of a string, its UTF-8 bytes."""
    return content.map(_entropy, na_action=None)


def byte_histogram(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, byte, n: the relational form, a row for each byte value that occurs."""
    return df.select(key, F.explode(hex_groups(F.col(content))).alias("byte")).groupBy(key, "byte").agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column) -> Column:
    """In percent, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def filter_stats(df: DataFrame, verdict: str = "verdict", tier: str | None = None, formats: dict[str, Column] | None = None) -> DataFrame:
    """One row of counts over all rows, the excluded ones too, and the rates of the verdicts. formats: a condition for each name."""
    count = lambda condition, name: F.count_if(condition).alias(name)
    counts = [F.count("*").alias("total"), *(count(F.col(verdict) == v, n) for v, n in ((INCLUDE, "included"), (EXCLUDE, "excluded"), (SKIP, "skipped")))]
    if tier:
        counts += [count(F.col(tier) == t, f"tier_{t.lower()}") for t in ("HD", "HD2", "SD")] + [count(F.col(tier).isNull(), "tier_unknown")]
    counts += [count(condition, f"format_{name}") for name, condition in (formats or {}).items()]
    rates = [rate(F.col(n), F.col("total")).alias(r) for n, r in (("included", "inclusion_rate"), ("excluded", "exclusion_rate"), ("skipped", "skip_rate"))]
    return df.agg(*counts).select("*", *rates)


def tier_stats(df: DataFrame, tier: str, processed: str) -> DataFrame:
    """tier, processed, skipped: by whether the condition column holds."""
    return df.groupBy(F.coalesce(tier, F.lit("unknown")).alias("tier")).agg(F.count_if(processed).alias("processed"), F.count_if(~F.coalesce(processed, F.lit(False))).alias("skipped"))


def alpha_stats(alpha: Column) -> list[Column]:
    return [F.count_if(alpha == 0).alias("transparent"), F.count_if((alpha > 0) & (alpha < 255)).alias("semi"), F.count_if(alpha == 255).alias("opaque")]


def roll_up(df: DataFrame, passed: str = "passed") -> DataFrame:
    """total, passed, failed, pass_rate in one row. A null verdict counts as failed."""
    ok = F.coalesce(passed, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed")).select("*", rate(F.col("passed"), F.col("total")).alias("pass_rate"))


def distinct_units(text: Column, limit: int = 1024) -> Column:
    """How many different characters the first `limit` hold; 1 of an empty text."""
    return F.greatest(F.size(F.array_distinct(F.regexp_extract_all(F.substring(text, 1, limit), F.lit("(?s)."), F.lit(0)))), F.lit(1))


def fully_found(df: DataFrame, found: str, required: bool = False) -> tuple[int, int]:
    """(found, missing); an error if some are missing and all are required, or if none was found at all."""
    row = df.agg(F.count_if(found).alias("ok"), F.count_if(~F.col(found)).alias("bad")).first()
    if row["bad"] and (required or not row["ok"]):
        raise RuntimeError(f"{row['bad']} of {row['ok'] + row['bad']} are missing")
    return row["ok"], row["bad"]
