"""Comparison with known-good outputs: bytes, pixels, baselines, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.codecs import images, png
from orebed.functions.pixels import hex_groups
from orebed.operators.aggregates import roll_up
from orebed.operators.lookups import baseline_status

CONTEXT, ROW = 64, 16
PASSED, FAILED, MISSING = "passed", "failed", "missing"
PAIR = "equal boolean, same_size boolean, n_differing long, percent double, hash_a long, hash_b long, distance int, error string"


def _first_difference(a: bytes | None, b: bytes | None) -> int | None:
    a, b = a or b"", b or b""
    n = min(len(a), len(b))
    at = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(at[0]) if len(at) else n if len(a) != len(b) else None


def first_difference(a: Column, b: Column) -> Column:
    """The first place where bytes differ; the shorter length if one begins the other; null if they are equal."""
    return F.pandas_udf(lambda x, y: pd.Series([_first_difference(p, q) for p, q in zip(x, y)], dtype="Int64"), "long")(a, b)


def compared_bytes(pairs: DataFrame) -> DataFrame:
    """pairs (name, a, b) with sha256_a, sha256_b, equal, size_a, size_b, first_difference (looked for only if they differ)."""
    hashed = pairs.select("name", F.sha2("a", 256).alias("sha256_a"), F.sha2("b", 256).alias("sha256_b"), F.length("a").alias("size_a"), F.length("b").alias("size_b"), "a", "b").withColumn("equal", F.col("sha256_a") == F.col("sha256_b"))
    same = hashed.where("equal").drop("a", "b").withColumn("first_difference", F.lit(None).cast("long"))
    other = hashed.where(~F.coalesce("equal", F.lit(False))).withColumn("first_difference", first_difference(F.col("a"), F.col("b"))).drop("a", "b")
    return same.unionByName(other)


def hex_dump(a: bytes, b: bytes, at: int) -> str:
    """Rows of 16 bytes of both sides around a place, with the first side's printable characters and a mark below the place."""
    start = max(0, at - CONTEXT)
    a, b = a[start : at + CONTEXT], b[start : at + CONTEXT]
    out = []
    for i in range(0, max(len(a), len(b)), ROW):
        cell = lambda x: "".join(f"{v:02X} " for v in x[i : i + ROW]).ljust(3 * ROW)  # noqa: E731, B023
        shown = "".join(chr(v) if 32 <= v <= 126 else "." for v in a[i : i + ROW]).ljust(ROW)
        out.append(f"0x{start + i:08X} | {cell(a)}| {cell(b)}| {shown}")
        if start + i <= at < start + i + ROW:
            out.append("          | " + "".join("^^ " if start + i + j == at else "   " for j in range(ROW)) + "| <-- FIRST DIFFERENCE")
    return "\n".join(out)


def compare_pictures(a: np.ndarray, b: np.ndarray) -> tuple:
    """The columns of PAIR of two pictures; a difference in size has no percentage."""
    ha, hb = images.dhash(a), images.dhash(b)
    n = images.differing(a, b)
    distance = ((ha ^ hb) & (1 << 64) - 1).bit_count()
    if n is None:
        return False, False, None, float("nan"), ha, hb, distance, None
    return n == 0, True, n, 100.0 * n / max(1, a.shape[0] * a.shape[1]), ha, hb, distance, None


def compared_pictures(pairs: DataFrame) -> DataFrame:
    """pairs (name, a, b: PNG files) with the columns of PAIR."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            try:
                out.append(compare_pictures(png.decode(bytes(x)), png.decode(bytes(y))))
            except (ValueError, TypeError) as e:
                out.append((False, False, None, float("nan"), None, None, None, str(e)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIR.split(", ")])
        return frame.astype({"n_differing": "Int64", "hash_a": "Int64", "hash_b": "Int64", "distance": "Int32"})

    return pairs.select("name", F.pandas_udf(run, PAIR)("a", "b").alias("c")).select("name", "c.*")


def difference_pictures(pairs: DataFrame, gap: int | None = None) -> DataFrame:
    """name, png: red where pixels differ, grey elsewhere (null for different sizes); with a gap the two pictures side by side."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = png.decode(bytes(x)), png.decode(bytes(y))
            out.append(png.encode(images.side_by_side(p, q, gap)) if gap is not None else png.encode(images.difference(p, q)) if p.shape == q.shape else None)
        return pd.Series(out)

    return pairs.select("name", F.pandas_udf(run, "binary")("a", "b").alias("png"))


def pixel_rows(pictures: DataFrame) -> DataFrame:
    """name, x, y, pixel (hex): the relational form of decoded pictures (name, width, height, rgba)."""
    each = pictures.select("name", "width", F.posexplode(hex_groups(F.col("rgba"), 8)).alias("pos", "pixel"))
    return each.select("name", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).alias("y"), "pixel")


def regression_status(outputs: DataFrame, baselines: DataFrame) -> DataFrame:
    """name, status, sha256, expected_sha256 of outputs (name, content) against baselines (sprite_name, sha256_hash): no baseline passes."""
    hashed = outputs.select("name", F.sha2("content", 256).alias("sha256"))
    known = baselines.select(F.col("sprite_name").alias("name"), F.col("sha256_hash").alias("expected_sha256"))
    status = F.when(F.col("expected_sha256").isNull() | (F.lower("expected_sha256") == F.col("sha256")), PASSED).otherwise(FAILED)
    return baseline_status(hashed, known, "name", status)


def validated(baselines: DataFrame, outputs: DataFrame) -> DataFrame:
    """sprite_name, status: every baseline against the output of its file name (outputs: path, content); no output is missing."""
    file_name = lambda c: F.element_at(F.split(c, r"[\\/]"), -1)
    hashed = outputs.select(file_name("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    wanted = baselines.select("sprite_name", "sha256_hash", file_name("expected_output").alias("file"))
    status = F.when(F.col("sha256").isNull(), MISSING).when(F.col("sha256") == F.lower("sha256_hash"), PASSED).otherwise(FAILED)
    return baseline_status(wanted, hashed, "file", status)


def detect_regressions(checked: DataFrame, strict: bool = True) -> DataFrame:
    """The roll-up of a status table; strict: an error if anything failed."""
    rolled = roll_up(checked.select((F.col("status") == PASSED).alias("passed")))
    if strict and (row := rolled.first())["failed"]:
        raise RuntimeError(f"{row['failed']} of {row['total']} outputs differ from their baselines")
    return rolled


def report(checked: DataFrame) -> DataFrame:
    """name and status lines, failures first."""
    name = checked.columns[0]
    return checked.select(F.when(F.col("status") == PASSED, 1).otherwise(0).alias("order"), F.concat_ws(": ", F.upper("status"), name).alias("line")).orderBy("order", "line")


def text_report(total: int, passed: int, failed: int, lines: list[str]) -> str:
    rate = 100.0 * passed / total if total else 0.0
    return "\n".join(["Regression report", "=================", f"Total: {total}", f"Passed: {passed}", f"Failed: {failed}", f"Pass rate: {rate:.1f}%", "", *lines])
