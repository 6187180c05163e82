"""Sprite, texture and icon decoders over rows of file bytes.

Each decoder returns rows and rejects: a file that can't be decoded is a reject with its error, and no task fails for it. Rows of
pixels are large, so a batch holds few of them; callers filter by path and length before content is read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from orebed.codecs import anim, grp, images, palette, png, textures
from orebed.functions.batches import decoded_frames
from orebed.functions.pixels import hex_groups

_ERROR = "error string"
PIXELS = "width int, height int, rgba binary"
#: The icon file's header fields.
ICON_COUNT_AT, ICON_WIDTH_AT, ICON_HEIGHT_AT = 4, 12, 14


def decoded(files: DataFrame, schema: str, decode: Callable[[bytes], list[tuple]]) -> tuple[DataFrame, DataFrame]:
    """(rows with path and the schema's columns, rejects with path and error) of files (path, content)."""
    names = [c.split()[0] for c in schema.split(", ")]
    # whole numbers keep their type beside the empty cells of rejects
    kinds = {c.split()[0]: {"int": "Int32", "long": "Int64"}[c.split()[1]] for c in schema.split(", ") if c.split()[1] in ("int", "long")}

    def of_file(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *row, None) for row in decode(content)]
        except (ValueError, struct.error) as e:
            return [(path, *([None] * len(names)), str(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return decoded_frames(batches, of_file, ["path", *names, "error"], kinds)

    both = files.select("path", "content").mapInPandas(run, f"path string, {schema}, {_ERROR}")
    return both.where("error is null").drop("error"), both.where("error is not null").select("path", "error")


def _pixels(image: np.ndarray) -> tuple[int, int, bytes]:
    return image.shape[1], image.shape[0], image.tobytes()


def as_image(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def grp_frames(files: DataFrame, colours: np.ndarray | None = None, transparent_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """frame_idx, width, height, indices, rgba: a row for each frame."""

    def decode(data: bytes) -> list[tuple]:
        sprite = grp.parse(data)
        return [(i, sprite.width, sprite.height, f.tobytes(), grp.rgba(f, colours, transparent_zero).tobytes()) for i, f in enumerate(sprite.frames)]

    return decoded(files, "frame_idx int, width int, height int, indices binary, rgba binary", decode)


def layered_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """version, names, width, height, layers, frames of high-definition containers, as JSON-free nested columns.

    layers: index, name, width, height and data (empty: the layer is absent). frames: index, x, y, x_offset, y_offset, width, height.
    """
    schema = (
        "version int, names array<string>, width int, height int, layers array<struct<index:int,name:string,width:int,height:int,data:binary>>, "
        "frames array<struct<index:int,x:int,y:int,x_offset:int,y_offset:int,width:int,height:int>>"
    )
    columns = ["version", "names", "width", "height", "layers", "frames"]

    def of_file(path: str, content: bytes) -> list[tuple]:
        try:
            a = anim.parse_layered(content)
        except ValueError as e:
            return [(path, *[None] * len(columns), str(e))]
        layers = [{"index": x.index, "name": x.name, "width": x.width, "height": x.height, "data": x.data} for x in a.layers]
        frames = [{"index": i, "x": f.x, "y": f.y, "x_offset": f.x_offset, "y_offset": f.y_offset, "width": f.width, "height": f.height} for i, f in enumerate(a.frames)]
        return [(path, a.version, a.names, a.width, a.height, layers, frames, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return decoded_frames(batches, of_file, ["path", *columns, "error"], {"version": "Int32", "width": "Int32", "height": "Int32"})

    both = files.select("path", "content").mapInPandas(run, f"path string, {schema}, {_ERROR}")
    return both.where("error is null").drop("error"), both.where("error is not null").select("path", "error")


def layers(containers: DataFrame) -> DataFrame:
    """path, layer_idx, layer_name, width, height, dds: the layers that are there."""
    each = containers.select("path", F.explode("layers").alias("l")).where(F.length("l.data") > 0)
    return each.select("path", F.col("l.index").alias("layer_idx"), F.col("l.name").alias("layer_name"), F.col("l.width").alias("width"), F.col("l.height").alias("height"), F.col("l.data").alias("dds"))


def layer_frames(containers: DataFrame) -> DataFrame:
    return containers.select("path", F.explode("frames").alias("f")).select("path", F.col("f.index").alias("frame_idx"), "f.x", "f.y", "f.x_offset", "f.y_offset", "f.width", "f.height")


def team_colour_layer(containers: DataFrame) -> DataFrame:
    """path and dds of the team-colour layer: that of the name in any case, else the third."""
    names = F.transform("names", F.lower)
    at = F.coalesce(F.nullif(F.array_position(names, anim.TEAM_COLOUR), F.lit(0)) - 1, F.lit(anim.TEAM_COLOUR_PLACE)).cast("int")
    return containers.select("path", F.get("layers", at).alias("l")).where(F.length("l.data") > 0).select("path", F.col("l.data").alias("dds"))


def standard_sprites(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sprite_idx, frame_idx, layer_idx, x, y, x_offset, y_offset, width, height, dds (on each layer's first frame only)."""

    def decode(data: bytes) -> list[tuple]:
        out = []
        for s, sprite in enumerate(anim.parse_standard(data)[1]):
            for f, parts in enumerate(sprite.frames):
                out += [(s, f, i, p.x, p.y, p.x_offset, p.y_offset, p.width, p.height, sprite.data[i] if f == 0 else None) for i, p in enumerate(parts)]
        return out

    return decoded(files, "sprite_idx int, frame_idx int, layer_idx int, x int, y int, x_offset int, y_offset int, width int, height int, dds binary", decode)


def generic_textures(files: DataFrame, colours: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """sprite_idx, reference, texture_idx, compression, pixel_format, width, height, rgba: a row for each texture of a sprite.

    A texture that can't be decoded has no rgba. References are resolved by the decoder, which knows the order of sprites.
    """

    def decode(data: bytes) -> list[tuple]:
        out = []
        for s, sprite in enumerate(anim.parse_generic(data).sprites):
            for t, texture in enumerate(sprite.textures):
                try:
                    pixels = texture.pixels(colours).tobytes()
                except ValueError:
                    pixels = None
                out.append((s, sprite.reference, t, *textures.sniff(texture.data, texture.width, texture.height), texture.width, texture.height, pixels))
        return out

    return decoded(files, "sprite_idx int, reference int, texture_idx int, compression string, pixel_format string, width int, height int, rgba binary", decode)


def generic_frames(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sprite_idx, frame_idx, ordinal, x, y, x_offset, y_offset, width, height; ordinal counts over all sprites of a file."""

    def decode(data: bytes) -> list[tuple]:
        frames = [(s, i, f) for s, sprite in enumerate(anim.parse_generic(data).sprites) for i, f in enumerate(sprite.frames)]
        return [(s, i, n, f.x, f.y, f.x_offset, f.y_offset, f.width, f.height) for n, (s, i, f) in enumerate(frames)]

    return decoded(files, "sprite_idx int, frame_idx int, ordinal int, x int, y int, x_offset int, y_offset int, width int, height int", decode)


def dds_pixels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """width, height, rgba of DDS files."""
    return decoded(files, PIXELS, lambda data: [_pixels(textures.decode_dds(data))])


def _png(rgba: pd.Series, width: pd.Series, height: pd.Series, level: int) -> pd.Series:
    return pd.Series([None if r is None else png.encode(as_image(r, int(w), int(h)), level) for r, w, h in zip(rgba, width, height)])


def to_png(rgba: Column, width: Column, height: Column, level: int = 6) -> Column:
    """A PNG file of pixels."""

    def run(r: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return _png(r, w, h, level)

    return F.pandas_udf(run, BinaryType())(rgba, width, height)


def png_or_raw(files: DataFrame) -> DataFrame:
    """files (path, content): DDS files as PNG under that name, those that can't be decoded and others as they are."""

    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for p, c in zip(path, content):
            if p.lower().endswith(".dds"):
                try:
                    p, c = p[:-4] + ".png", png.encode(textures.decode_dds(bytes(c)))
                except ValueError:
                    pass
            out.append((p, bytes(c)))
        return pd.DataFrame(out, columns=["path", "content"])

    return files.select(F.pandas_udf(run, "path string, content binary")("path", "content").alias("f")).select("f.*")


def team_coloured(layer_rows: DataFrame, names: bool = True) -> DataFrame:
    """path, kind (diffuse, mask, or diffuse alone without a mask), width, height, rgba of each container's diffuse and team-colour layers.

    layer_rows: path, role (diffuse or teamcolor), dds. A container's two layers meet in one group of two rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, path = {}, group["path"].iloc[0]
        for role, dds in zip(group["role"], group["dds"]):
            try:
                rows[role] = textures.decode_dds(bytes(dds))
            except ValueError:
                continue
        out = []
        if "diffuse" in rows:
            diffuse = rows["diffuse"]
            if "teamcolor" in rows and rows["teamcolor"].shape == diffuse.shape:
                m = images.mask(rows["teamcolor"])
                out = [(path, "diffuse", *_pixels(images.stripped(diffuse, m))), (path, "mask", *_pixels(m))]
            else:
                out = [(path, "diffuse", *_pixels(diffuse))]
        return pd.DataFrame(out, columns=["path", "kind", "width", "height", "rgba"])

    return layer_rows.select("path", "role", "dds").groupBy("path").applyInPandas(run, f"path string, kind string, {PIXELS}")


def sheets(files: DataFrame, colours: np.ndarray | None = None, columns: int = images.SHEET_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """frame_count, columns, width, height, rgba: all frames of a run-length sprite in one grid. A file is a sheet, so nothing is shuffled."""

    def decode(data: bytes) -> list[tuple]:
        sprite = grp.parse(data)
        sheet = images.sheet([grp.rgba(f, colours, True) for f in sprite.frames], sprite.width, sprite.height, columns)
        return [(len(sprite.frames), columns, *_pixels(sheet))]

    return decoded(files, f"frame_count int, columns int, {PIXELS}", decode)


def icon_slots(data: bytes) -> tuple[int, int, int, list[np.ndarray | None]]:
    """Count, cell width, cell height and the pictures of an icon file; None where one can't be decoded."""
    if len(data) < 16:
        raise ValueError("shorter than a header")
    count, width, height = (struct.unpack_from("<H", data, at)[0] for at in (ICON_COUNT_AT, ICON_WIDTH_AT, ICON_HEIGHT_AT))
    starts, at = [], data.find(textures.DDS)
    while at >= 0:
        starts.append(at)
        at = data.find(textures.DDS, at + 1)
    out: list[np.ndarray | None] = [None] * count
    for slot, start in enumerate(starts[:count]):
        part = data[start : starts[slot + 1] if slot + 1 < len(starts) else len(data)]
        if len(part) < textures.DDS_HEADER:
            continue
        h, w = struct.unpack_from("<2I", part, 12)
        size = textures.BLOCK_BYTES["DXT1"] * -(-w // 4) * -(-h // 4)
        if 0 < w <= width and 0 < h <= height and len(part) >= textures.DDS_HEADER + size:
            out[slot] = textures.decode_blocks("DXT1", part[textures.DDS_HEADER : textures.DDS_HEADER + size], w, h)
    return count, width, height, out


def icon_atlas(files: DataFrame, tint: tuple[int, int, int] | None, columns: int = images.SHEET_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """frame_count, frame_width, frame_height, columns, width, height, rgba: icons centred in their cells, tinted if a tint is given."""

    def decode(data: bytes) -> list[tuple]:
        count, width, height, icons = icon_slots(data)
        out = np.zeros((-(-count // columns) * height, columns * width, 4), np.uint8)
        for slot, icon in enumerate(icons):
            if icon is not None:
                x, y = slot % columns * width + (width - icon.shape[1]) // 2, slot // columns * height + (height - icon.shape[0]) // 2
                images.put(out, images.tinted(icon, tint) if tint else icon, x, y)
        return [(count, width, height, columns, *_pixels(out))]

    return decoded(files, f"frame_count int, frame_width int, frame_height int, columns int, {PIXELS}", decode)


def palette_rows(spark, name: str, colours: np.ndarray) -> DataFrame:
    """A palette as a table: palette_id, idx, r, g, b, a (at most 256 rows)."""
    return spark.createDataFrame([(name, i, *map(int, c)) for i, c in enumerate(palette.validated(colours))], "palette_id string, idx int, r int, g int, b int, a int")


def unpacked_pixels(frames: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, idx: the relational form of index frames, a row for each pixel."""
    return frames.select(*keys, F.posexplode(hex_groups(F.col("indices"))).alias("pos", "_hex")).select(*keys, "pos", F.conv("_hex", 16, 10).cast("int").alias("idx"))
