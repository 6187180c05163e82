"""What is written: files of binary rows under an overwrite policy, PNG columns, sheet metadata."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.functions.predicates import choice

POLICIES = ("Always", "Never", "IfNewer", "Backup")


def number_text(value: float) -> str:
    """A number without a needless fraction."""
    return str(int(value)) if float(value).is_integer() else repr(value)


def metadata(sprites: DataFrame, pixels_per_unit: float = 100.0) -> DataFrame:
    """sprites (name, grp_width, grp_height, texture_width, texture_height, frames) with json, in the importers' key order.

    frames: array of (index, x, y, width, height, x_offset, y_offset).
    """
    frame = lambda f: F.format_string('    {"index": %d, "x": %d, "y": %d, "width": %d, "height": %d, "offsetX": %d, "offsetY": %d}', *(f[c] for c in ("index", "x", "y", "width", "height", "x_offset", "y_offset")))
    head = F.format_string('{\n  "name": "%s",\n  "frameCount": %d,\n  "grpWidth": %d,\n  "grpHeight": %d,\n  "textureWidth": %d,\n  "textureHeight": %d,\n', F.regexp_replace("name", r"(\.anim)+$", ""), F.size("frames"), "grp_width", "grp_height", "texture_width", "texture_height")
    body = F.concat(F.lit(f'  "pixelsPerUnit": {number_text(pixels_per_unit)},\n  "frames": [\n'), F.array_join(F.transform("frames", frame), ",\n"), F.lit("\n  ]\n}"))
    return sprites.withColumn("json", F.concat(head, body))


def bottom_up_rects(frames: DataFrame, sheet_height: Column) -> DataFrame:
    """frames with y counted from below, as importers that start there want it."""
    return frames.withColumn("y_up", sheet_height - F.col("y") - F.col("height"))


def clip_times(frames: DataFrame, rate: float) -> DataFrame:
    return frames.withColumn("time", F.col("index") / F.lit(float(rate)))


def write_files(rows: DataFrame, root: str, policy: str = "Always", started: float | None = None) -> DataFrame:
    """path, written: write content to path below root, which all executors must share. Runs when the result is read.

    Never keeps files that are there, IfNewer those that were made since `started`, Backup renames them to .bak first, unless this
    run made them. A file is written aside and renamed, so a task that is run again leaves whole files, and the backup too.
    """
    policy = choice(policy, POLICIES)
    begun = time.time()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.normpath(os.path.join(root, path.replace("\\", "/").lstrip("/")))
                if not target.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"{path} leaves the folder")
                there = os.path.exists(target)
                kept = there and (policy == "Never" or policy == "IfNewer" and started is not None and os.path.getmtime(target) >= started)
                if not kept:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    if there and policy == "Backup" and os.path.getmtime(target) < begun:
                        os.replace(target, target + ".bak")
                    aside = f"{target}.{os.getpid()}.part"
                    with open(aside, "wb") as f:
                        f.write(content or b"")
                    os.replace(aside, target)
                done.append(not kept)
            yield pd.DataFrame({"path": batch["path"], "written": done})

    return rows.select("path", "content").mapInPandas(run, "path string, written boolean")
