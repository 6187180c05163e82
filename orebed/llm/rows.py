"""Rows of a table picked by their content: by two 64-bit keys of it, so that texts are neither compared nor shuffled to find them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.frames import apart, row_key, second_key
from orebed.session import written

#: A list of keys (two longs a row) goes to all tasks up to so many rows; a longer one is joined by shuffling.
MAX_SENT = 1 << 19
KEYS = ("key", "key2")


def sent_if_small(keys: DataFrame) -> DataFrame:
    """keys, a written table of fixed width, marked for broadcast if it has at most MAX_SENT rows."""
    return F.broadcast(keys) if keys.limit(MAX_SENT + 1).count() <= MAX_SENT else keys


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the two keys of doc_id and text under names that don't clash, and these names."""
    names = [apart(docs, *KEYS)[k] for k in KEYS]
    return docs.withColumn(names[0], row_key("doc_id", "text")).withColumn(names[1], second_key("doc_id", "text")), names


def having(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose keys are in keys (key, key2), or aren't (left_anti). Other columns stay as they are."""
    rows, names = keyed(docs)
    return rows.join(sent_if_small(keys.toDF(*names)), names, how).select(*docs.columns)


def kept_rows(docs: DataFrame, keys: DataFrame, firsts: DataFrame) -> DataFrame:
    """docs with one row for each of the keys in firsts. keys: those of all rows, firsts: distinct ones of these.

    The shorter list decides, that of the rows that stay or of those that go. Rows that repeat as a whole, which the keys tell, are
    reduced to one; they alone are shuffled if the list is short.
    """
    firsts = written(firsts.toDF(*KEYS), "first-keys")
    counts = written(keys.groupBy(*KEYS).count().join(firsts.withColumn("stays", F.lit(True)), list(KEYS), "left"), "row-keys")
    single = F.col("stays").isNotNull() & (F.col("count") == 1)
    sizes = counts.agg(F.count_if(single).alias("stay"), F.count_if(~single).alias("go")).first()
    if sizes["go"] <= sizes["stay"]:
        once = having(docs, written(counts.where(~single).select(*KEYS), "gone-keys"), "left_anti")
    else:
        once = having(docs, written(counts.where(single).select(*KEYS), "kept-keys"))
    repeated = written(counts.where(F.col("stays") & (F.col("count") > 1)).select(*KEYS), "repeated-keys")
    if repeated.isEmpty():
        return once
    rows, names = keyed(docs)
    several = rows.join(sent_if_small(repeated.toDF(*names)), names, "left_semi").dropDuplicates(names).select(*docs.columns)
    return once.unionByName(several)
