"""Column selection and Arrow mapping shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Whatever holds a word: everything but the space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name, so that no other column can clash (of equal names the first)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    numbered = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"_{df.columns.index(n)}").alias(n) for n in names))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content; equal rows share it."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns), *(F.col(c).isNull() for c in columns))


def second_key(*columns: str) -> Column:
    """Another 64 bits, independent of row_key: the two together tell rows apart however many there are."""
    return F.xxhash64(F.lit("second"), row_key(*columns), *(F.col(c).cast("string") for c in columns), *(F.col(c).isNull() for c in columns))


def apart(df: DataFrame, *wanted: str) -> dict[str, str]:
    """For each wanted helper name one that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for name in wanted:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        names[name] = free
    return names


def give_back() -> None:
    """Return freed memory to the system; workers that wait for their next task keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_columns(df: DataFrame, fn: Callable[..., tuple[list, ...]], schema: str, rows: int = 512) -> DataFrame:
    """fn takes each input column as a list, and returns each output column as a list; it sees `rows` rows at most at once."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = out = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)
        del batch, out
        give_back()

    return df.mapInArrow(run, schema)
