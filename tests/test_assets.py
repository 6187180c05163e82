"""Sources, decoders, terrain, comparison and the stream over files that the tests make."""

import json
import os

import builders
import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.codecs import images, palette, png
from orebed.operators import sprites, terrain, validate
from orebed.sources import index_files, listing, sinks, text_files
from orebed.streaming import landing

KEYS = [bytes([n]) * 9 for n in range(1, 6)]


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content binary")


# index files


def test_index_rows_and_rejects(spark):
    good = builders.index([(bytes(range(1, 10)), 3, 1024), (KEYS[1], 8, 4096)])
    entries, rejects = index_files.index_entries(files(spark, ("x/0000000004.idx", good), ("x/b.idx", builders.index([], mark=6)), ("x/c.idx", b"short"), ("x/d.idx", builders.index([(KEYS[0], 0, 1 << 33)], offset_bytes=5)), ("x/e.idx", good + b"abc")))
    rows = entries.where("idx_file like '%04.idx'").orderBy("entry_pos").collect()
    assert [(r.bucket, r.version, bytes(r.key), r.data_file, r.offset) for r in rows] == [(5, 4, bytes(range(1, 10)), 3, 1024), (5, 4, KEYS[1], 2, 4096)]
    assert {r.idx_file for r in rejects.collect()} == {"x/b.idx", "x/c.idx", "x/d.idx"} and entries.where("idx_file like '%e.idx'").count() == 2


def archive(spark):
    one = builders.index([(KEYS[0], 0, 100), (KEYS[1], 0, 100), (KEYS[2], 0, 5100), (KEYS[3], 1, 0)])
    two = builders.index([(KEYS[0], 0, 105), (KEYS[4], 1, 60_000_000)])
    return index_files.index_entries(files(spark, ("a.idx", one), ("b.idx", two)))[0]


def test_sizes_names_and_lookup(spark):
    sized = index_files.sized(archive(spark))
    sizes = {(r.idx_file, r.entry_pos): r.size for r in sized.collect()}
    assert sizes == {("a.idx", 0): 5, ("a.idx", 1): 5, ("b.idx", 0): 4995, ("a.idx", 2): 4096, ("a.idx", 3): 4096, ("b.idx", 1): 4096}
    names = {(r.idx_file, r.entry_pos): r.name for r in index_files.listed(sized).collect()}
    assert names[("b.idx", 0)] == f"file_001_00000_{'01' * 9}.dat" and ("a.idx", 0) not in names
    numbered = sorted(r.name for r in index_files.listed(sized, sprites=True).collect())
    assert numbered == [f"sprite_candidate_{i:04}_{k}.dat" for i, k in enumerate(["03030303", "04040404", "01010101", "05050505"], 1)]
    found = index_files.by_key(archive(spark), spark.createDataFrame([(KEYS[0],), (b"none",)], "key binary")).collect()
    assert [(r.idx_file, r.entry_pos) for r in found] == [("a.idx", 0)]
    keys = spark.createDataFrame([(names[("b.idx", 0)],), ("sprite_candidate_0001_01010101.dat",), ("x.dat",)], "n string").select(index_files.key_of_name(F.col("n")).alias("k"))
    assert [r.k and bytes(r.k) for r in keys.collect()] == [KEYS[0], None, None]


def test_header_sizes(spark):
    heads = [(None, 4096), (b"short", 4096), (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (100).to_bytes(4, "big") + (80).to_bytes(4, "big"), 5024), (b"\xff\xd8\xff\xe0" + bytes(8), 50_000), (bytes(range(16)), 32_768), (bytes(16), 8192)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i int, h binary")
    assert [r[0] for r in df.orderBy("i").select(index_files.header_size(F.col("h"))).collect()] == [n for _, n in heads]
    seen = index_files.analysed(files(spark, ("p", b"\x89PNG\r\n\x1a\n"), ("d", bytes(range(256)) * 4))).collect()
    assert seen[0].is_png and not seen[0].is_jpeg and seen[1].entropy == 8.0


def test_installation_report(spark):
    names = [(f"Data/data/data.{i:03}.idx", 10) for i in range(16)] + [(f"Data/data/data.{i:03}", 947_848_533) for i in range(6)] + [("Data/indices/x", 1)]
    entries = archive(spark)
    ok = index_files.installation_report(spark.createDataFrame(names, "path string, length long"), entries, 16).first()
    assert ok.is_valid and ok.is_within_tolerance and ok.missing_directories == [] and ok.total_size == 6 * 947_848_533
    bad = index_files.installation_report(spark.createDataFrame(names[1:17], "path string, length long"), entries, 2).first()
    assert not bad.is_valid and bad.missing_directories == ["Data/indices"] and bad.missing_index_files == ["data.000.idx"] and bad.missing_data_files == [1, 2, 3, 4, 5]


# listings


def test_listing_and_point_reads(spark, tmp_path):
    (tmp_path / "a" / "anim").mkdir(parents=True)
    (tmp_path / "a" / "anim" / "main_001.anim").write_bytes(b"12345")
    (tmp_path / "a" / "x.dat").write_bytes(b"1")
    (tmp_path / "a" / "empty").write_bytes(b"")
    found = listing.relative(listing.files(spark, str(tmp_path / "a")), str(tmp_path / "a"))
    assert listing.overview(found) == (2, ["anim/main_001.anim", "x.dat"])
    assert bytes(listing.content_of(found, "anim/main_001.anim").first().content) == b"12345"
    with pytest.raises(Exception, match="too large"):
        listing.content_of(found, "anim/main_001.anim", limit=3).collect()
    assert [r.id for r in listing.present(listing.generated(spark, 999, limit=5), found).collect()] == [1]
    assert listing.searched(found, "ANIM", "main").count() == 1
    plan = found.select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_live_then_fallback(spark):
    live = files(spark, ("locales\\enUS\\ui\\a.txt", b"live"), ("ui\\empty", b""))
    fallback = files(spark, ("assets/locales/enus/UI/b.txt", b"fb"), ("z", b"zz"))
    asked = spark.createDataFrame([("ui\\a.txt",), ("UI\\B.txt",), ("none",)], "path string")
    got = {r.path: (r.source, r.content and bytes(r.content)) for r in listing.requested(asked, live, fallback, "enUS").collect()}
    assert got == {"locales\\enUS\\ui\\a.txt": ("live", b"live"), "locales\\enUS\\UI\\B.txt": ("fallback", b"fb"), "locales\\enUS\\none": (None, None)}
    assert listing.all_or_error(listing.requested(asked, live, fallback, "enUS")) == (2, 1)
    starts = files(spark, ("a", bytes(20) + b"DDS ..."), ("b", bytes(64) + b"DDS "), ("c", b"")).select(listing.dds_start(F.col("content"))).collect()
    assert [r[0] for r in starts] == [20, None, None]


def test_installations(spark, tmp_path, monkeypatch):
    rows = [("n", p) for p in ("Data/data/1.idx", "Data/data/data.000")] + [("m", p) for p in ("Data/data/1.idx", "Data/data/data.000", "Data/Old.MPQ", "game.exe")] + [("o", p) for p in ("Data/one.mpq", "Data/two.mpq")] + [("p", "Data/one.mpq"), ("q", "Data/x")]
    layout = listing.Layout(("game.exe",), ("game.exe",), ("Data/one.mpq", "Data/two.mpq"))
    found = listing.installations(spark.createDataFrame(rows, "root string, path string"), layout)
    assert {r.root: (r.kind, r.version, r.valid) for r in found.collect()} == {"n": ("Indexed", "Newer", True), "m": ("Mixed", "Newer", True), "o": ("Packed", "Older", True), "p": ("Packed", "Older", False)}
    assert listing.best_installation(found).first().root == "m" and listing.best_installation(found.where("kind = 'Packed'")).first().root == "o"
    (tmp_path / "g" / "Data").mkdir(parents=True)
    assert listing.located_root("/x", []) == "/x" and listing.located_root(None, ["/none", str(tmp_path / "g")]) == str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        listing.located_root(None, ["/none"])


# text files


def test_mappings(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("# head\n\nanimations/terran/marine: anim/main_239.anim\nanimations/zerg/x: HD2/anim/main_007.anim # note\nanimations/marine: anim/main_239.anim\nicons/a: b: c\nicons/a: d\n")
    lines = text_files.numbered_lines(spark, str(tmp_path / "m.yaml"))
    mapped = {r.key: r.value for r in text_files.mapping(lines).collect()}
    assert mapped["icons/a"] == "d" and mapped["animations/zerg/x"].endswith("# note") and text_files.category(text_files.mapping(lines), "icons/").count() == 1
    assert {r.id: r.name for r in text_files.names_by_id(lines).collect()} == {239: "marine", 7: "zerg/x"}
    assert [tuple(r) for r in text_files.exported_map(lines).select("id", "name").collect()] == [("239", "marine")]


def test_config():
    assert text_files.load_config(None) == text_files.load_config("{bad") == text_files.load_config('{"output": 3}') == text_files.Config()
    c = text_files.load_config('{"output": {"png_level": 9}, "custom_settings": {"a": 1}, "unknown": 1}')
    assert c.output.png_level == 9 and c.output.directory == "extracted" and json.loads(text_files.dump_config(c))["custom_settings"] == {"a": 1}


def test_baselines_and_targets(spark, tmp_path):
    row = {"sprite_name": "a", "source_file": "s", "expected_output": "out/a.png", "expected_metadata": {"width": 64, "height": 64, "frame_count": 1, "format": "PNG"}, "sha256_hash": "00", "baseline_date": "2026-01-01T00:00:00Z", "extractor_version": "1"}
    (tmp_path / "b.json").write_text(json.dumps([row]))
    base = text_files.read_baselines(spark, str(tmp_path / "b.json"))
    new = base.withColumn("sha256_hash", F.lit("11")).unionByName(base.withColumn("sprite_name", F.lit("b")))
    assert {r.sprite_name: r.sha256_hash for r in text_files.registered(base, new).collect()} == {"a": "11", "b": "00"}
    (tmp_path / "t.json").write_text(json.dumps([{"output": "x", "candidates": ["a", "b"]}]))
    assert json.loads(text_files.targets_json(text_files.read_targets(spark, str(tmp_path / "t.json"))).first().json) == [{"output": "x", "candidates": ["a", "b"]}]


# sinks


def test_overwrite_policies(spark, tmp_path):
    def write(content, policy, started=None):
        return {r.path: r.written for r in sinks.write_files(files(spark, ("d/a.bin", content)), str(tmp_path), policy, started).collect()}

    target = tmp_path / "d" / "a.bin"
    assert write(b"1", "always") == {"d/a.bin": True} and write(b"2", "Never") == {"d/a.bin": False} and target.read_bytes() == b"1"
    assert write(b"3", "Backup")["d/a.bin"] and (tmp_path / "d" / "a.bin.bak").read_bytes() == b"1" and target.read_bytes() == b"3"
    assert not write(b"4", "IfNewer", os.path.getmtime(target) - 1)["d/a.bin"] and write(b"4", "IfNewer", os.path.getmtime(target) + 1)["d/a.bin"]
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_files(files(spark, ("../x", b"")), str(tmp_path)).collect()


def test_metadata(spark):
    frames = [(0, 1, 2, 3, 4, -5, 6)]
    df = spark.createDataFrame([("m.anim", 64, 32, 128, 256, frames)], "name string, grp_width int, grp_height int, texture_width int, texture_height int, frames array<struct<index:int,x:int,y:int,width:int,height:int,x_offset:int,y_offset:int>>")
    text = sinks.metadata(df).first().json
    assert json.loads(text) == {"name": "m", "frameCount": 1, "grpWidth": 64, "grpHeight": 32, "textureWidth": 128, "textureHeight": 256, "pixelsPerUnit": 100, "frames": [{"index": 0, "x": 1, "y": 2, "width": 3, "height": 4, "offsetX": -5, "offsetY": 6}]}
    assert '"pixelsPerUnit": 100,' in text and sinks.number_text(1.5) == "1.5"
    rects = sinks.bottom_up_rects(df.select(F.explode("frames").alias("f")).select("f.*"), F.lit(256)).first()
    assert rects.y_up == 250 and sinks.clip_times(df.select(F.explode("frames").alias("f")).select("f.*"), 12).first().time == 0


# sprites


def test_sprite_rows(spark):
    a, b = np.zeros((3, 4), np.uint8), np.full((3, 4), 7, np.uint8)
    rows, rejects = sprites.grp_frames(files(spark, ("g", builders.grp([a, b], 4, 3)), ("bad", b"xx")), transparent_zero=True)
    got = {r.frame_idx: r for r in rows.collect()}
    assert bytes(got[1].indices) == b.tobytes() and set(bytes(got[0].rgba)[3::4]) == {0} and rejects.first().path == "bad"
    assert sprites.unpacked_pixels(rows, "path", "frame_idx").groupBy("idx").count().orderBy("idx").collect() == [(0, 12), (7, 12)]
    sheet = sprites.sheets(files(spark, ("g", builders.grp([b] * 20, 4, 3))))[0].first()
    assert (sheet.width, sheet.height, sheet.frame_count) == (68, 6, 20)
    picture = png.decode(bytes(sprites.sheets(files(spark, ("g", builders.grp([b] * 20, 4, 3))))[0].select(sprites.to_png(F.col("rgba"), F.col("width"), F.col("height")).alias("p")).first().p))
    assert picture[5, 11].tolist() == [7, 7, 7, 255] and picture[5, 12].tolist() == [0] * 4
    assert sprites.palette_rows(spark, "p", palette.grey()).count() == 256


BLOCK = bytes.fromhex("ffff0000") + bytes(4)  # white


def test_layered_rows(spark):
    dds = builders.dds("DXT1", 4, 4, BLOCK)
    content = builders.layered([("diffuse", 4, 4, dds), ("bright", 0, 0, b""), ("TEAMCOLOR", 4, 4, dds)], [(0, 0, -1, 1, 4, 4)])
    found, rejects = sprites.layered_files(files(spark, ("h", content), ("bad", b"ANIM")))
    assert [r.layer_idx for r in sprites.layers(found).orderBy("layer_idx").collect()] == [0, 2] and rejects.count() == 1
    assert bytes(sprites.team_colour_layer(found).first().dds) == dds and sprites.layer_frames(found).first().x_offset == -1
    roles = sprites.layers(found).select("path", F.lower("layer_name").alias("role"), "dds")
    out = {r.kind: bytes(r.rgba) for r in sprites.team_coloured(roles).collect()}
    assert out["mask"] == out["diffuse"] == b"\xff" * 64
    assert {r.path for r in sprites.png_or_raw(files(spark, ("a.dds", dds), ("b.dds", b"x"), ("c.txt", b"y"))).collect()} == {"a.png", "b.dds", "c.txt"}
    assert sprites.dds_pixels(files(spark, ("a", dds), ("b", b"")))[0].first().width == 4


def test_other_containers(spark):
    f = (1, 2, -1, -2, 3, 4)
    rows = sprites.standard_sprites(files(spark, ("s", builders.standard([([[f, f], [f, f]], [b"aa", b"b"])]))))[0].orderBy("frame_idx", "layer_idx").collect()
    assert [(r.frame_idx, r.layer_idx, r.dds and bytes(r.dds)) for r in rows] == [(0, 0, b"aa"), (0, 1, b"b"), (1, 0, None), (1, 1, None)]
    pixel = bytes([128]) * 64
    content = builders.generic([(4, 4, [f, f], [(4, 4, pixel), (9, 9, b"\x78\x9cxx")]), 0])
    textures = sprites.generic_textures(files(spark, ("g", content)))[0].orderBy("sprite_idx", "texture_idx").collect()
    assert [(r.sprite_idx, r.reference, r.rgba and bytes(r.rgba)) for r in textures] == [(0, None, pixel), (0, None, None), (1, 0, pixel), (1, 0, None)]
    assert [r.ordinal for r in sprites.generic_frames(files(spark, ("g", content)))[0].orderBy("ordinal").collect()] == [0, 1, 2, 3]


def test_icons(spark):
    head = bytes(4) + (3).to_bytes(2, "little") + bytes(6) + (8).to_bytes(2, "little") * 2
    content = head + builders.dds("DXT1", 4, 4, BLOCK) + builders.dds("DXT1", 8, 8, bytes(3))
    row = sprites.icon_atlas(files(spark, ("i", content)), (255, 128, 0))[0].first()
    image = sprites.as_image(bytes(row.rgba), row.width, row.height)
    assert image[2, 2].tolist() == [255, 128, 0, 255] and image[1, 1].tolist() == [0] * 4 and row.frame_count == 3
    assert sprites.icon_atlas(files(spark, ("short", b"")), None)[1].count() == 1


# terrain


def test_terrain_chain(spark):
    tiles = [0, 1, 17, 0]
    chk = builders.chunks((b"ERA ", b"\x0c\0"), (b"DIM ", b"\x02\0\x02\0"), (b"MTXM", np.array(tiles[:2], "<u2").tobytes()), (b"MTXM", np.array(tiles[2:], "<u2").tobytes())) + b"XXXX\xff\xff\0\0"
    maps, rejects = terrain.maps(files(spark, ("m", chk), ("short", builders.chunks((b"DIM ", b"\x05\0\x05\0")))))
    row = maps.first()
    assert (row.tileset, row.width, row.height, row.tiles) == ("jungle", 2, 2, tiles) and rejects.first().path == "short"
    cv5 = b"".join(bytes(20) + np.arange(16, dtype="<u2").tobytes() for _ in range(2))  # id -> id & 15
    vx4 = np.array([[(0 << 1)] * 16, [(1 << 1 | 1)] * 16], "<u4").tobytes()
    vf4 = np.array([[0] * 16, [0, 1] + [0] * 14], "<u2").tobytes()
    vr4 = bytes([5] * 64) + bytes(range(8)) * 8
    groups, cells, flags, minis = terrain.groups(spark, cv5), terrain.cells(spark, vx4), terrain.flags(spark, vf4), terrain.mini_tiles(spark, vr4)
    each = terrain.map_tiles(maps)
    ids = terrain.tile_ids(each)
    mega = terrain.megatiles(ids, groups)
    assert {r.mega_id: (r.atlas_index, r.megatile) for r in mega.collect()} == {0: (0, 0), 1: (1, 1), 17: (2, 1)}
    walk = terrain.walkable(mega, flags)
    assert {r.mega_id: r.walkable for r in walk.collect()} == {0: False, 1: True, 17: True}
    assert sorted((r.wx, r.wy) for r in terrain.walk_cells(each, mega, flags).collect()) == [(1, 4), (5, 0)]
    atlas = terrain.atlases(terrain.cell_tiles(mega, cells, minis), ids)
    picture = atlas.first()
    image = sprites.as_image(bytes(picture.rgba), picture.width, picture.height)
    assert image[0, 0].tolist() == [5, 5, 5, 255] and image[0, 32:40, 0].tolist() == [7, 6, 5, 4, 3, 2, 1, 0] and image.shape == (32, 544, 4)
    small = {(r.tx, r.ty): (r.r, r.a) for r in terrain.minimaps(each, ids, atlas, walk).collect()}
    assert small == {(0, 0): (5, 255), (1, 0): (7, 255), (0, 1): (7, 255), (1, 1): (5, 255)}
    stats = terrain.alpha_stats(atlas).first()
    assert (stats.transparent, stats.opaque) == (14 * 1024, 3 * 1024)
    assert terrain.direct(ids).where("megatile = 17").count() == 1 and terrain.single_cells(spark, vx4).count() == 32


def test_tile_atlas(spark):
    content = bytes(148) + BLOCK * 1024 * 2 + b"rest"
    row = terrain.tile_atlas(files(spark, ("t", content)), columns=2)[0].first()
    assert (row.n_tiles, row.width, row.height) == (2, 256, 128) and bytes(row.rgba) == b"\xff" * 256 * 128 * 4
    assert terrain.tile_atlas(files(spark, ("t", content)), side=16, max_tiles=1)[0].first().n_tiles == 1


# comparison


def picture(*spots):
    out = np.full((64, 64, 4), (128, 128, 128, 255), np.uint8)
    for y, x in spots:
        out[y, x] = (255, 0, 0, 255)
    return png.encode(out)


def test_byte_comparison(spark):
    df = spark.createDataFrame([("same", b"abc", b"abc"), ("diff", b"abc", b"abd"), ("long", b"abc", b"abcd"), ("none", None, b"x")], "name string, a binary, b binary")
    got = {r.name: (r.equal, r.first_difference) for r in validate.compared_bytes(df).collect()}
    assert got == {"same": (True, None), "diff": (False, 2), "long": (False, 3), "none": (None, 0)}
    dump = validate.hex_dump(bytes(range(200)), bytes(range(199)) + b"\xff", 199)
    assert dump.splitlines()[0].startswith("0x00000087 | 87 88") and dump.splitlines()[-1].endswith("| <-- FIRST DIFFERENCE")


def test_picture_comparison(spark):
    df = spark.createDataFrame([("same", picture(), picture()), ("two", picture(), picture((10, 10), (20, 20))), ("size", picture(), png.encode(np.zeros((2, 2, 4), np.uint8))), ("bad", b"", picture())], "name string, a binary, b binary")
    got = {r.name: r for r in validate.compared_pictures(df).collect()}
    assert got["same"].equal and got["two"].n_differing == 2 and abs(got["two"].percent - 200 / 4096) < 1e-12
    assert not got["size"].same_size and got["size"].n_differing is None and got["bad"].error
    out = {r.name: r.png for r in validate.difference_pictures(df.where("name in ('two', 'size')")).collect()}
    assert out["size"] is None and images.differing(png.decode(bytes(out["two"])), png.decode(picture())) == 2
    assert png.size(bytes(validate.difference_pictures(df.where("name = 'two'"), 20).first().png)) == (148, 64)
    flat = spark.createDataFrame([("p", 2, 1, bytes([1, 2, 3, 4, 5, 6, 7, 8]))], "name string, width int, height int, rgba binary")
    assert [tuple(r) for r in validate.pixel_rows(flat).orderBy("x").collect()] == [("p", 0, 0, "01020304"), ("p", 1, 0, "05060708")]


def test_baseline_checks(spark):
    import hashlib

    good = hashlib.sha256(b"ok").hexdigest()
    baselines = spark.createDataFrame([("a", "out/a.png", good.upper()), ("b", "out\\b.png", good), ("c", "c.png", good)], "sprite_name string, expected_output string, sha256_hash string")
    outputs = files(spark, ("x/a.png", b"ok"), ("x/b.png", b"changed"))
    checked = validate.validated(baselines, outputs).select("sprite_name", "status")
    assert {r.sprite_name: r.status for r in checked.collect()} == {"a": "passed", "b": "failed", "c": "missing"}
    named = spark.createDataFrame([("a", b"ok"), ("b", b"changed"), ("new", b"z")], "name string, content binary")
    status = validate.regression_status(named, baselines)
    assert {r.name: r.status for r in status.collect()} == {"a": "passed", "b": "failed", "new": "passed"}
    with pytest.raises(RuntimeError, match="1 of 3"):
        validate.detect_regressions(status)
    assert validate.detect_regressions(status, strict=False).first().failed == 1
    lines = [r.line for r in validate.report(status.select("name", "status")).collect()]
    assert lines[0] == "FAILED: b" and "Pass rate: 66.7%" in validate.text_report(3, 2, 1, lines)


# stream


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in" / "anim").mkdir(parents=True)
    (tmp_path / "in" / "anim" / "a.anim").write_bytes(b"1")

    def run():
        landing.run(landing.judged(landing.arriving(spark, str(tmp_path / "in")), [r"\.anim$"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
        return {(r.path.rsplit("/", 1)[-1], r.verdict, r.tier) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run() == {("a.anim", "Include", "HD")}
    (tmp_path / "in" / "b.txt").write_bytes(b"2")
    assert run() == {("a.anim", "Include", "HD"), ("b.txt", "Skip", None)} and spark.read.parquet(str(tmp_path / "out")).count() == 2
