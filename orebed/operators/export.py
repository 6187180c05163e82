"""What a layered container is exported as: pictures by layer, the raw textures on request, and a metadata file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.operators import sprites
from orebed.operators.lookups import layer_index
from orebed.sources.sinks import metadata


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.anim$", "")


def _chosen(containers: DataFrame, names: Sequence[str]) -> DataFrame:
    """path, role, dds of the named layers that are there: by the header's names in any case, else by their usual place."""
    wanted = containers.select("path", "names", "layers", F.explode(F.array(*map(F.lit, names))).alias("role"))
    at = layer_index(F.col("names"), F.col("role")).cast("int")
    found = wanted.select("path", "role", F.get("layers", at).alias("l"))
    return found.where(F.length("l.data") > 0).select("path", "role", F.col("l.data").alias("dds"))


def exported(containers: DataFrame, extra_layers: Sequence[str] = (), team_colour: bool = True, keep_dds: bool = False, level: int = 6, pixels_per_unit: float = 100.0) -> DataFrame:
    """path, content of every output of containers (sprites.layered_files); a layer that can't be decoded has none.

    The diffuse picture loses its team colours if their mask is exported beside it.
    """
    main = containers.select("path", F.get("layers", F.lit(0)).alias("l")).where(F.length("l.data") > 0).select("path", F.lit("diffuse").alias("role"), F.col("l.data").alias("dds"))
    if team_colour:
        main = main.unionByName(sprites.team_colour_layer(containers).select("path", F.lit("teamcolor").alias("role"), "dds"))
    pictures = sprites.team_coloured(main).select("path", F.col("kind").alias("role"), "width", "height", "rgba")
    if extra_layers:
        others = _chosen(containers, list(extra_layers)).select(F.to_json(F.struct("path", "role")).alias("path"), F.col("dds").alias("content"))
        decoded = sprites.dds_pixels(others)[0].withColumn("_k", F.from_json("path", "path string, role string"))
        pictures = pictures.unionByName(decoded.select("_k.path", "_k.role", "width", "height", "rgba"))
    named = lambda role, ending: F.concat(stem(F.col("path")), F.lit("_"), role, F.lit(ending))
    files = pictures.select(named(F.col("role"), ".png").alias("path"), sprites.to_png(F.col("rgba"), F.col("width"), F.col("height"), level).alias("content"))
    if keep_dds:
        raw = _chosen(containers, ["diffuse", *extra_layers])
        files = files.unionByName(raw.select(named(F.col("role"), ".dds").alias("path"), F.col("dds").alias("content")))
    first = F.get("layers", F.lit(0))
    described = metadata(
        containers.select(
            "path", F.element_at(F.split("path", r"[\\/]"), -1).alias("name"), F.col("width").alias("grp_width"), F.col("height").alias("grp_height"),
            F.coalesce(first["width"], F.lit(0)).alias("texture_width"), F.coalesce(first["height"], F.lit(0)).alias("texture_height"), "frames",
        ),
        pixels_per_unit,
    )
    return files.unionByName(described.select(F.concat(stem(F.col("path")), F.lit(".json")).alias("path"), F.encode("json", "utf-8").alias("content")))
