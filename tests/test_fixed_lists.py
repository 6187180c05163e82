"""Lists of files that are asked for by name."""

import builders
import numpy as np

from orebed.codecs import png
from orebed.sources import fixed_lists

WHITE = bytes.fromhex("ffff0000") + bytes(4)
DDS = builders.dds("DXT1", 4, 4, WHITE)


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def by_output(df):
    return {r.output: None if r.content is None else bytes(r.content) for r in df.collect()}


def test_data_tables(spark):
    found = fixed_lists.data_tables(spark, files(spark, ("arr\\units.dat", b""), ("ARR/units.dat", b"u"), ("rez/stat_txt.tbl", b"t"), ("arr/other", b"x")))
    got = by_output(found)
    assert len(got) == 11 and got.pop("units.dat") == b"u" and got.pop("stat_txt.tbl") == b"t" and set(got.values()) == {None}


def test_menu(spark):
    listing = files(spark, ("HD2/glue/title/title.DDS", DDS), ("HD2\\glue\\mainmenu\\Lock.DDS", b"no picture"), ("Music/zerg1.ogg", b"m"), ("sound/glue/swishin.wav", b""))
    got = by_output(fixed_lists.menu_assets(spark, listing))
    assert set(got) == {"title.png", "lock.dds", "music_zerg.ogg"} and (png.decode(got["title.png"]) == 255).all()
    assert by_output(fixed_lists.menu_assets(spark, listing, convert=False))["title.dds"] == DDS
    assert len(fixed_lists.MENU) == len(set(fixed_lists.MENU.values())) == 25


def test_tilesets(spark):
    far = bytes(64) + DDS
    listing = files(spark, ("HD2/tileset/ice.dds.vr4", bytes(20) + DDS), ("HD2/tileset/jungle.dds.vr4", far), ("tileset/desert.dds.vr4", DDS))
    got = by_output(fixed_lists.tilesets(spark, listing, "HD2/"))
    assert set(got) == {"ice.dds.vr4", "ice.dds.png", "jungle.dds.vr4"} and png.decode(got["ice.dds.png"]).shape == (4, 4, 4)
    assert set(by_output(fixed_lists.tilesets(spark, listing, convert=False))) == {"desert.dds.vr4"}


def test_effects(spark):
    sprite = builders.grp([np.full((3, 4), 7, np.uint8)] * 2, 4, 3)
    got = by_output(fixed_lists.effects(spark, files(spark, ("effect/water_normal_1.dds.grp", DDS), ("effect\\water_normal_2.dds.grp", sprite))))
    assert set(got) == {f"water_normal_{i}.dds.{x}" for i in (1, 2) for x in ("grp", "png")}
    assert png.decode(got["water_normal_1.dds.png"]).shape == (4, 4, 4) and png.decode(got["water_normal_2.dds.png"])[0, 0].tolist() == [7, 7, 7, 255]
    assert by_output(fixed_lists.effects(spark, files(spark, ("x", b"y")))) == {}
