"""The files that an extraction asks for by name: data tables, menu pictures and sounds, tilesets, effects.

Listings have path, and content where it is asked for; slashes of either kind and any case are alike. Empty files count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions.predicates import slashed
from orebed.operators import sprites
from orebed.operators.lookups import top_by
from orebed.sources.listing import dds_start

# Outputs of the data tables and where each is looked for, in order.
DATA_TABLES = {
    "units.dat": ("arr\\units.dat", "arr/units.dat"),
    "upgrades.dat": ("arr\\upgrades.dat", "arr/upgrades.dat"),
    "images.dat": ("arr\\images.dat", "arr/images.dat"),
    "orders.dat": ("arr\\orders.dat", "arr/orders.dat"),
    "techdata.dat": ("arr\\techdata.dat", "arr/techdata.dat"),
    "weapons.dat": ("arr\\weapons.dat", "arr/weapons.dat"),
    "flingy.dat": ("arr\\flingy.dat", "arr/flingy.dat"),
    "sprites.dat": ("arr\\sprites.dat", "arr/sprites.dat"),
    "iscript.bin": ("scripts\\iscript.bin", "scripts/iscript.bin"),
    "images.tbl": ("arr\\images.tbl", "arr/images.tbl"),
    "stat_txt.tbl": ("rez\\stat_txt.tbl", "rez/stat_txt.tbl"),
}
# Files of the main menu and their outputs.
MENU = {
    "HD2\\glue\\title\\title.DDS": "title.dds",
    "HD2\\glue\\mainmenu\\titleframe_bg.DDS": "titleframe_bg.dds",
    "HD2\\glue\\mainmenu\\titleframe_overlay.DDS": "titleframe_overlay.dds",
    "HD2\\glue\\mainmenu\\etail.DDS": "etail.dds",
    "HD2\\glue\\mainmenu\\pintro.DDS": "pintro.dds",
    "HD2\\glue\\mainmenu\\pcredit.DDS": "pcredit.dds",
    "HD2\\glue\\mainmenu\\Lock.DDS": "lock.dds",
    "HD2\\glue\\mainmenu\\single.webm": "single.webm",
    "HD2\\glue\\mainmenu\\singleon.webm": "singleon.webm",
    "HD2\\glue\\mainmenu\\multi.webm": "multi.webm",
    "HD2\\glue\\mainmenu\\multion.webm": "multion.webm",
    "HD2\\glue\\mainmenu\\exit.webm": "exit.webm",
    "HD2\\glue\\mainmenu\\exiton.webm": "exiton.webm",
    "HD2\\glue\\mainmenu\\editor.webm": "editor.webm",
    "HD2\\glue\\mainmenu\\editoron.webm": "editoron.webm",
    "sound\\glue\\mouseover.wav": "sfx_mouseover.wav",
    "sound\\glue\\mousedown2.wav": "sfx_click.wav",
    "sound\\glue\\swishin.wav": "sfx_swishin.wav",
    "sound\\glue\\swishout.wav": "sfx_swishout.wav",
    "sound\\glue\\swishlock.wav": "sfx_swishlock.wav",
    "sound\\glue\\bnetclick.wav": "sfx_bnetclick.wav",
    "sound\\glue\\countdown.wav": "sfx_countdown.wav",
    "Music\\terran1.ogg": "music_terran.ogg",
    "Music\\zerg1.ogg": "music_zerg.ogg",
    "Music\\protoss1.ogg": "music_protoss.ogg",
}
# Names of the tilesets and effects.
TILESETS = ("badlands", "platform", "ashworld", "jungle", "desert", "ice", "twilight", "install")
EFFECTS = ("water_normal_1.dds.grp", "water_normal_2.dds.grp")


def _key(path: Column) -> Column:
    return F.lower(slashed(path))


def _wanted(spark: SparkSession, rows: list[tuple[str, str, int]], listing: DataFrame) -> DataFrame:
    """output, path, content: of each output the first file in order that is there and not empty, with null where there is none.

    Other files are filtered out before the join, so only the wanted ones are shuffled.
    """
    names = spark.createDataFrame(rows, "output string, asked string, pos int").withColumn("_key", _key(F.col("asked")))
    keys = sorted({asked.replace("\\", "/").lower() for _, asked, _ in rows})
    there = listing.where(_key(F.col("path")).isin(keys)).where(F.length("content") > 0)
    found = names.join(there.select(_key(F.col("path")).alias("_key"), "path", "content"), "_key")
    first = top_by(found, "output", "pos", "path").select("output", "path", "content")
    return names.select("output").distinct().join(first, "output", "left")


def data_tables(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """output, path, content of the data tables; path and content are null where no place has it."""
    return _wanted(spark, [(output, asked, i) for output, places in DATA_TABLES.items() for i, asked in enumerate(places)], listing)


def menu_assets(spark: SparkSession, listing: DataFrame, convert: bool = True) -> DataFrame:
    """output, content of the menu's files that are there; with convert DDS as PNG, or as it is if it can't be decoded."""
    there = _wanted(spark, [(output, asked, 0) for asked, output in MENU.items()], listing).where("content is not null")
    files = there.select(F.col("output").alias("path"), "content")
    return (sprites.png_or_raw(files) if convert else files).withColumnRenamed("path", "output")


def _with_pictures(raw: DataFrame, dds: Column) -> DataFrame:
    """output, content: raw files, and beside each a PNG of its DDS part (column dds, null without one) if that can be decoded."""
    name = F.regexp_replace("output", r"\.[^.]*$", "")
    drawn = sprites.png_or_raw(raw.select(F.concat(name, F.lit(".dds")).alias("path"), dds.alias("content")).where("content is not null"))
    return raw.unionByName(drawn.where(F.endswith("path", F.lit(".png"))).withColumnRenamed("path", "output"))


def tilesets(spark: SparkSession, listing: DataFrame, prefix: str = "", convert: bool = True) -> DataFrame:
    """output, content of the tilesets below a quality's prefix; with convert also a PNG of each, whose DDS begins within 64 bytes."""
    rows = [(f"{name}.dds.vr4", f"{prefix}tileset/{name}.dds.vr4", 0) for name in TILESETS]
    raw = _wanted(spark, rows, listing).where("content is not null").select("output", "content")
    content = F.col("content")
    return _with_pictures(raw, F.substring(content, dds_start(content) + 1, F.length(content))) if convert else raw


def effects(spark: SparkSession, listing: DataFrame, prefix: str = "", convert: bool = True) -> DataFrame:
    """output, content of the effects; with convert also a PNG: of a DDS file itself, else a sheet of a sprite file's frames."""
    raw = _wanted(spark, [(name, f"{prefix}effect/{name}", 0) for name in EFFECTS], listing).where("content is not null").select("output", "content")
    if not convert:
        return raw
    is_dds = F.hex(F.substring("content", 1, 4)) == "44445320"
    sheets, _ = sprites.sheets(raw.where(~is_dds).select(F.col("output").alias("path"), "content"))
    picture = sprites.to_png(F.col("rgba"), F.col("width"), F.col("height"))
    drawn = sheets.select(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit(".png")).alias("output"), picture.alias("content"))
    return _with_pictures(raw, F.when(is_dds, F.col("content"))).unionByName(drawn)
