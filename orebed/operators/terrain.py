"""Tile maps: chunks to tiles, tiles through side tables to pictures, atlases, minimaps and walk maps.

The side tables are dimension tables of a tileset, a row for each entry; their number is bounded by 16-bit tile ids. Their
files are given as bytes, since each has a known small size. Joins stay relational; only pixels are assembled in Python, and a
map is one group there.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.codecs import images, textures
from orebed.functions.pixels import hex_groups
from orebed.functions.predicates import tileset_of
from orebed.operators import lookups, windows
from orebed.operators.sprites import PIXELS, decoded

# The tables' strides and the map's defaults.
GROUP_BYTES, GROUP_SKIP, CELLS = 52, 20, 16
TILE_PIXELS, MINI_PIXELS = 32, 8
ATLAS_HEADER, ATLAS_TILE_BYTES, ATLAS_TILE_SIDE = 148, 8192, 128
DEFAULT_ERA, DEFAULT_SIDE = 3, 128
WALKABLE_COLOUR, BLOCKED_COLOUR = (30, 60, 30, 255), (40, 35, 30, 255)
#: A side table's file is parsed on the driver: so many bytes at most.
MAX_TABLE_BYTES = 64 << 20


def parse_chunks(data: bytes) -> tuple[int, int, int, list[int]]:
    """Era, width, height, tile ids. Repeated tile chunks add up; the first chunk that overruns the end stops the scan."""
    era, width, height, tiles, at = DEFAULT_ERA, DEFAULT_SIDE, DEFAULT_SIDE, [], 0
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if at + size > len(data):
            break
        part = data[at : at + size]
        if tag == b"ERA " and size >= 2:
            era = int.from_bytes(part[:2], "little") & 7
        elif tag == b"DIM " and size >= 4:
            width, height = struct.unpack_from("<2H", part)
        elif tag == b"MTXM":
            tiles += np.frombuffer(part, "<u2", size // 2).tolist()
        at += size
    return era, width, height, tiles


def maps(files: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """era, tileset, width, height, tiles (array) of unpacked map files; whole: fewer tiles than width x height are an error."""

    def decode(data: bytes) -> list[tuple]:
        era, width, height, tiles = parse_chunks(data)
        if whole and len(tiles) < width * height:
            raise ValueError(f"{len(tiles)} tiles for {width} x {height}")
        return [(era, width, height, tiles)]

    rows, rejects = decoded(files, "era int, width int, height int, tiles array<int>", decode)
    return rows.select("path", "era", tileset_of(F.col("era")).alias("tileset"), "width", "height", "tiles"), rejects


def map_tiles(maps: DataFrame) -> DataFrame:
    """path, pos, tx, ty, mega_id: the tiles that lie in the map."""
    each = maps.select("path", "width", "height", F.posexplode("tiles").alias("pos", "mega_id")).where(F.col("pos") < F.col("width") * F.col("height"))
    return each.select("path", "pos", (F.col("pos") % F.col("width")).alias("tx"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("ty"), "mega_id")


def _table(spark: SparkSession, values: np.ndarray, *names: str) -> DataFrame:
    """Rows of (index along each axis ..., value)."""
    where = np.indices(values.shape).reshape(values.ndim, -1)
    frame = pd.DataFrame(dict(zip(names, [*where, values.reshape(-1)]))).astype("int64")
    return spark.createDataFrame(frame, ", ".join(f"{n} long" for n in names))


def _bounded(data: bytes) -> bytes:
    if len(data) > MAX_TABLE_BYTES:
        raise ValueError(f"a side table of {len(data)} bytes")
    return data


def groups(spark: SparkSession, data: bytes) -> DataFrame:
    """tile_group, sub_tile, megatile."""
    n = len(_bounded(data)) // GROUP_BYTES
    raw = np.frombuffer(data[: n * GROUP_BYTES], np.uint8).reshape(n, GROUP_BYTES)[:, GROUP_SKIP:]
    return _table(spark, np.ascontiguousarray(raw).view("<u2"), "tile_group", "sub_tile", "megatile")


def cells(spark: SparkSession, data: bytes) -> DataFrame:
    """megatile, cell, tile, flip: 16 cells of 4 bytes."""
    n = len(_bounded(data)) // (4 * CELLS)
    out = _table(spark, np.frombuffer(data[: n * 4 * CELLS], "<u4").reshape(n, CELLS), "megatile", "cell", "entry")
    return out.select("megatile", "cell", F.shiftright("entry", 1).alias("tile"), F.col("entry").bitwiseAND(F.lit(1)).alias("flip"))


def single_cells(spark: SparkSession, data: bytes) -> DataFrame:
    """megatile, tile, flip: the reading of the same file as one entry of 4 bytes for each megatile."""
    out = _table(spark, np.frombuffer(_bounded(data)[: len(data) // 4 * 4], "<u4"), "megatile", "entry")
    return out.select("megatile", F.shiftright("entry", 1).alias("tile"), F.col("entry").bitwiseAND(F.lit(1)).alias("flip"))


def flags(spark: SparkSession, data: bytes) -> DataFrame:
    """megatile, cell, flags."""
    n = len(_bounded(data)) // (2 * CELLS)
    return _table(spark, np.frombuffer(data[: n * 2 * CELLS], "<u2").reshape(n, CELLS), "megatile", "cell", "flags")


def mini_tiles(spark: SparkSession, data: bytes, colours: np.ndarray | None = None) -> DataFrame:
    """tile, rgba of 8 x 8 pixels, from indices and a palette."""
    n = len(_bounded(data)) // MINI_PIXELS**2
    index = np.frombuffer(data[: n * MINI_PIXELS**2], np.uint8).reshape(n, -1)
    table = np.zeros((256, 4), np.uint8)
    if colours is None:
        table[:] = np.arange(256, dtype=np.uint8)[:, None]
        table[:, 3] = 255
    else:
        table[: len(colours)] = colours
    return spark.createDataFrame([(i, bytes(table[row].tobytes())) for i, row in enumerate(index)], "tile long, rgba binary")


def tile_ids(tiles: DataFrame) -> DataFrame:
    """path, mega_id, atlas_index: each map's distinct ids in ascending order."""
    return tiles.select("path", "mega_id").distinct().withColumn("atlas_index", windows.ordinal("mega_id", partition=["path"]))


def megatiles(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """ids with megatile, through the id's group and place; ids without an entry drop out."""
    group, sub = lookups.split_id(F.col("mega_id"))
    return ids.withColumn("tile_group", group.cast("long")).withColumn("sub_tile", sub.cast("long")).join(groups, ["tile_group", "sub_tile"])


def cell_tiles(ids: DataFrame, cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """path, mega_id, atlas_index, cell, flip, rgba: the tiles of each id's cells. ids: with megatile."""
    return ids.join(cells, "megatile").join(tiles, "tile").select("path", "mega_id", "atlas_index", "cell", "flip", "rgba")


def direct(ids: DataFrame) -> DataFrame:
    """ids whose mega_id is the megatile itself, for maps drawn twice."""
    return ids.withColumn("megatile", F.col("mega_id").cast("long"))


def walkable(ids: DataFrame, flags: DataFrame) -> DataFrame:
    """path, mega_id, walkable: whether any cell has its lowest bit set."""
    return ids.join(flags, "megatile").groupBy("path", "mega_id").agg(F.bool_or(F.col("flags").bitwiseAND(F.lit(1)) == 1).alias("walkable"))


def walk_cells(tiles: DataFrame, ids: DataFrame, flags: DataFrame) -> DataFrame:
    """path, wx, wy: the walkable cells at four times the map's resolution."""
    on = flags.where(F.col("flags").bitwiseAND(F.lit(1)) == 1).select("megatile", "cell")
    placed = tiles.join(ids.select("path", "mega_id", "megatile"), ["path", "mega_id"]).join(on, "megatile")
    return placed.select("path", (F.col("tx") * 4 + F.col("cell") % 4).alias("wx"), (F.col("ty") * 4 + F.floor(F.col("cell") / 4)).alias("wy"))


def atlases(cell_rows: DataFrame, ids: DataFrame, side: int = TILE_PIXELS, columns: int = images.SHEET_COLUMNS, mini: int = MINI_PIXELS, smooth: bool = False, opaque: bool = False) -> DataFrame:
    """path, columns, tile_size, width, height, rgba: each map's megatiles of 4 x 4 cells in one grid.

    mini: a tile's side in pixels; smooth: resample with Lanczos-3 instead of the nearest pixel; opaque: set alpha to 255.
    Ids without cells leave blank places. A map has at most 65,536 ids of 16 cells, which bounds a group.
    """
    resize = images.lanczos if smooth else images.nearest

    def run(group: pd.DataFrame) -> pd.DataFrame:
        path, count = group["path"].iloc[0], int(group["n_ids"].iloc[0])
        out = np.zeros((-(-count // columns) * side, columns * side, 4), np.uint8)
        for at, cells in group.dropna(subset=["cell"]).groupby("atlas_index"):
            tile = np.zeros((TILE_PIXELS, TILE_PIXELS, 4), np.uint8)
            for cell, flip, rgba in zip(cells["cell"], cells["flip"], cells["rgba"]):
                part = np.frombuffer(rgba, np.uint8).reshape(mini, mini, 4)
                part = part[:, ::-1] if flip == 1 else part
                images.put(tile, part if mini == MINI_PIXELS else resize(part, MINI_PIXELS, MINI_PIXELS), int(cell) % 4 * MINI_PIXELS, int(cell) // 4 * MINI_PIXELS)
            tile = tile if side == TILE_PIXELS else resize(tile, side, side)
            if opaque:
                tile[..., 3] = 255
            images.put(out, tile, int(at) % columns * side, int(at) // columns * side)
        return pd.DataFrame([(path, columns, side, out.shape[1], out.shape[0], out.tobytes())], columns=["path", "columns", "tile_size", "width", "height", "rgba"])

    counts = ids.groupBy("path").agg(F.count("*").alias("n_ids"))
    rows = ids.select("path", "mega_id", "atlas_index").join(cell_rows.drop("atlas_index"), ["path", "mega_id"], "left").join(counts, "path")
    return rows.groupBy("path").applyInPandas(run, f"path string, columns int, tile_size int, {PIXELS}")


def minimaps(tiles: DataFrame, ids: DataFrame, atlases: DataFrame, walkable: DataFrame) -> DataFrame:
    """path, tx, ty, r, g, b, a: the centre pixel of each tile's atlas cell, or a colour by walkability for ids without one."""
    where = F.col("atlas_index")
    x = (where % F.col("columns")) * F.col("tile_size") + F.floor(F.col("tile_size") / 2)
    y = F.floor(where / F.col("columns")) * F.col("tile_size") + F.floor(F.col("tile_size") / 2)
    # an atlas is looked into once for each of its ids, not for each tile
    pixel = F.substring(F.col("rgba"), ((F.least(y, F.col("height") - 1) * F.col("width") + F.least(x, F.col("width") - 1)) * 4 + 1).cast("int"), F.lit(4))
    colours = ids.join(atlases, "path").select("path", "mega_id", F.hex(pixel).alias("pixel"))
    joined = tiles.join(colours, ["path", "mega_id"], "left").join(walkable, ["path", "mega_id"], "left")
    channel = lambda i: F.coalesce(F.conv(F.substring("pixel", 2 * i + 1, 2), 16, 10).cast("int"), F.when(F.col("walkable"), WALKABLE_COLOUR[i]).otherwise(BLOCKED_COLOUR[i])).alias("rgba"[i])
    return joined.select("path", "tx", "ty", *map(channel, range(4)))


def tile_atlas(files: DataFrame, side: int = ATLAS_TILE_SIDE, columns: int = images.SHEET_COLUMNS, max_tiles: int = 0) -> tuple[DataFrame, DataFrame]:
    """n_tiles, columns, width, height, rgba: compressed tiles of 128 x 128 after a header, in one grid; max_tiles 0: all."""

    def decode(data: bytes) -> list[tuple]:
        if len(data) < ATLAS_HEADER:
            raise ValueError("shorter than a header")
        body = data[ATLAS_HEADER:]
        count = len(body) // ATLAS_TILE_BYTES
        count = min(count, max_tiles) if max_tiles else count
        pictures = [textures.decode_blocks("DXT1", body[i * ATLAS_TILE_BYTES : (i + 1) * ATLAS_TILE_BYTES], ATLAS_TILE_SIDE, ATLAS_TILE_SIDE, strict=False) for i in range(count)]
        grid = images.sheet([p if side == ATLAS_TILE_SIDE else images.lanczos(p, side, side) for p in pictures], side, side, columns)
        return [(count, columns, grid.shape[1], grid.shape[0], grid.tobytes())]

    return decoded(files, f"n_tiles int, columns int, {PIXELS}", decode)


def alpha_stats(atlases: DataFrame) -> DataFrame:
    """path, transparent, semi, opaque: counts of pixels by alpha, by bytes of the hex form."""
    alphas = F.transform(hex_groups(F.col("rgba"), 8), lambda p: F.substring(p, 7, 2))
    count = lambda test: F.size(F.filter("_a", test)).cast("long")
    return atlases.select("path", alphas.alias("_a")).select("path", count(lambda a: a == "00").alias("transparent"), count(lambda a: (a != "00") & (a != "FF")).alias("semi"), count(lambda a: a == "FF").alias("opaque"))
